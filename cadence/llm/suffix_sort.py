"""Suffix arrays by induced sorting, and permuted longest common prefixes, on numpy arrays.

Suffixes are classed as S (less than the next suffix) or L. The leftmost S
suffixes of each S run (LMS) are sorted first: their substrings, of a few symbols
each, are sorted by keys of packed symbols and named, and where names repeat, the string of names is sorted the same
way, recursively. All other suffixes are then induced from them in two linear
scans, L types by rising and S types by falling first symbol.

A scan takes a symbol's bucket at a time: within a bucket, the part filled so far is one
array operation, and what it adds to the same bucket is the next. Strings of
many different symbols are scanned one by one. The recursion ends where no
name repeats, or most do not: a symbol that occurs once gives its suffix's
place, and the few others are told apart by the places of the suffixes that follow.
"""

from __future__ import annotations

import numpy as np

#: Fewer places a symbol, and a string of names is sorted by doubling.
_SYMBOLS = 8


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last symbol is the only smallest one."""
    n = len(t)
    at = np.flatnonzero(t[1:] != t[:-1])  # places where symbols differ: all up to one are of its type
    s = np.ones(n, bool)
    size = np.diff(at, prepend=-1)
    s[: int(at[-1]) + 1 if len(at) else 0] = np.repeat(t[at + 1] > t[at], size)
    return s


def _append(sa: np.ndarray, fill: np.ndarray, pos: np.ndarray, sym: np.ndarray, sign: int) -> None:
    """Put positions into their symbols' buckets in the given order, at ``fill`` and on (sign 1) or back (-1)."""
    order = np.argsort(sym, kind="stable")
    sym = sym[order]
    edge = np.concatenate([[0], np.flatnonzero(sym[1:] != sym[:-1]) + 1, [len(sym)]])
    new, size = edge[:-1], edge[1:] - edge[:-1]
    first = fill[sym[new]]
    sa[np.repeat(first - sign * new, size) + sign * np.arange(len(sym))] = pos[order]
    fill[sym[new]] = first + sign * size


def _extend(sa: np.ndarray, fill: np.ndarray, batch: np.ndarray, before: np.ndarray, sign: int) -> None:
    """Put the positions before those of ``batch`` into their buckets, where ``before`` has a symbol (not -1) for them."""
    sym = before[batch]
    keep = sym >= 0
    if keep.any():
        _append(sa, fill, batch[keep] - 1, sym[keep], sign)


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array from LMS positions in order (by whole suffix)."""
    n = len(t)
    count = np.bincount(t, minlength=sigma)
    end = np.cumsum(count)
    start = end - count
    if sigma * 48 > n:
        return _induce_singly(t, s, lms, start, end)
    sa = np.full(n, -1, np.int64)
    fill = end - 1
    _append(sa, fill, lms[::-1], t[lms[::-1]], -1)
    seeds = [(fill[c] + 1, end[c]) for c in range(sigma)]  # LMS part of each bucket
    head = start.copy()
    # symbol of the position before, where that is of the scan's type; the last entry answers for empty places
    before = np.full(n + 1, -1, t.dtype)
    before[1:n] = np.where(s[:-1], -1, t[:-1])
    for c in np.flatnonzero(count):
        p = start[c]
        while True:
            q = head[c]
            batch = sa[p:q] if p < q else None
            if batch is None:
                break
            p = q
            _extend(sa, head, batch, before, 1)
        a, b = seeds[c]
        if a < b:
            _extend(sa, head, sa[a:b], before, 1)
    tail = end - 1
    for a, b in seeds:
        sa[a:b] = -1
    sa[0] = n - 1  # the last symbol's suffix is S, alone in the first bucket
    tail[t[-1]] -= 1
    before[1:n] = np.where(s[:-1], t[:-1], -1)
    for c in np.flatnonzero(count)[::-1]:
        p = end[c] - 1
        while p > tail[c]:
            q = tail[c]
            batch = sa[q + 1 : p + 1][::-1]
            p = q
            _extend(sa, tail, batch, before, -1)
        _extend(sa, tail, sa[start[c] : head[c]][::-1], before, -1)  # the L part
    return sa


def _induce_singly(t: np.ndarray, s: np.ndarray, lms: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The two scans one by one, over plain lists; a scan sees what it has put further on."""
    n = len(t)
    sa, tail = [-1] * n, (end - 1).tolist()
    for p, c in zip(lms[::-1].tolist(), t[lms[::-1]].tolist(), strict=True):
        sa[tail[c]] = p
        tail[c] -= 1
    seeds = np.flatnonzero(np.array(sa) >= 0).tolist()
    # symbol of the position before, where that is of the scan's type; the last entry answers for empty places
    before = np.full(n + 1, -1, np.int64)
    before[1:n] = np.where(s[:-1], -1, t[:-1])
    sym, head = before.tolist(), start.tolist()
    for p in sa:
        c = sym[p]
        if c >= 0:
            h = head[c]
            sa[h] = p - 1
            head[c] = h + 1
    for x in seeds:
        sa[x] = -1
    sa[0] = n - 1  # the last symbol's suffix, alone in the first bucket
    before[1:n] = np.where(s[:-1], t[:-1], -1)
    sym, tail = before.tolist(), (end - 1).tolist()
    for p in reversed(sa):
        c = sym[p]
        if c >= 0:
            h = tail[c]
            sa[h] = p - 1
            tail[c] = h - 1
    return np.array(sa, np.int64)


def _few_ties(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of a string in which most symbols occur once: ties are split by the ranks 1, 2, 4 ... symbols on."""
    n = len(t)
    count = np.bincount(t, minlength=sigma)
    rank = (np.cumsum(count) - count)[t]
    tied, h = np.flatnonzero(count[t] > 1), 1
    while len(tied):
        first = rank[tied]
        second = np.where(tied + h < n, rank[np.minimum(tied + h, n - 1)], -1)
        order = np.argsort(first * (n + 1) + second)  # equal ones share a rank, whatever their order
        tied, first, second = tied[order], first[order], second[order]
        group = np.concatenate([[True], first[1:] != first[:-1]])
        part = group | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(tied))
        rank[tied] = first + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        alone = part & np.append(part[1:], True)
        tied, h = tied[~alone], 2 * h
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


def _substring_ranks(t: np.ndarray, s: np.ndarray, lms: np.ndarray, size: np.ndarray, sigma: int) -> np.ndarray:
    """For each LMS substring, how many are less: as many (symbol, type) pairs at once as a 64-bit key holds, then the next ones of those that tie.

    Of two substrings that agree as far as the shorter goes, both end there: the types make its last symbol an LMS one in the other.
    """
    bits = (2 * sigma + 1).bit_length()
    step = 62 // bits
    v = 2 * t.astype(np.int64) + s + 1  # 0 stands behind a substring's end
    rank = np.zeros(len(lms), np.int64)
    tied, k = np.arange(len(lms)), 0
    while len(tied):
        key = np.zeros(len(tied), np.int64)
        at, left = lms[tied] + k, size[tied] - k
        for j in range(step):
            key = (key << bits) | np.where(left > j, v[np.minimum(at + j, len(v) - 1)], 0)
        first = rank[tied]
        order = np.lexsort((key, first)) if k else np.argsort(key)  # equal ones share a rank, whatever their order
        tied, first, key, left = tied[order], first[order], key[order], left[order]
        group = np.concatenate([[True], first[1:] != first[:-1]])
        part = group | np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(tied))
        rank[tied] = first + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        alone = part & np.append(part[1:], True)
        tied, k = tied[~alone & (left > step)], k + step
    return rank


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of ``t`` (symbols 0 .. sigma - 1); its last symbol is 0 and occurs only there."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    if _SYMBOLS * sigma > n:
        return _few_ties(t, sigma)
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(lms) <= 1:
        return _induce(t, s, lms, sigma)
    size = np.append(np.diff(lms) + 1, 1)  # an LMS substring ends with the next LMS symbol
    less = _substring_ranks(t, s, lms, size, sigma)
    begins = np.zeros(len(lms), np.int64)
    begins[less] = 1
    names = (np.cumsum(begins) - 1).astype(np.int32)[less]
    if begins.sum() < len(lms):
        rank = suffix_array(names, int(begins.sum()))
    else:
        rank = np.empty(len(lms), np.int64)
        rank[less] = np.arange(len(lms))
    return _induce(t, s, lms[rank], sigma)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, most: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``(plcp, phi)``: for each position, the position before it in the suffix array and the length of their common prefix.

    Only irreducible values -- where the symbols before the two positions
    differ -- are found by comparison; any other is one less than its left
    neighbour's. ``most`` bounds the values; ones under ``least`` may be told as less than they are.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    first = np.ones(n, bool)
    first[1:] = (phi[1:] <= 0) | (t[:-1] != t[phi[1:] - 1])
    irr = np.flatnonzero(first & (phi >= 0))
    # eight symbols a step, from a copy padded with different ends
    raw = np.concatenate([t.astype(np.uint16), np.zeros(8, np.uint16)])
    words = np.ndarray((n + 5,), "<u8", raw.tobytes(), 0, (2,))  # four symbols from every position
    a, b = irr, phi[irr]
    got = np.zeros(len(irr), np.int64)
    left, k = np.arange(len(irr)), 0
    if least >= 4:  # one look at the last symbols of a prefix of ``least`` settles most
        left = left[np.maximum(a, b) + least <= n]
        left = left[words[a[left] + least - 4] == words[b[left] + least - 4]]
    while len(left) and k < most:
        left = left[np.maximum(a[left], b[left]) + k < n]
        ok = words[a[left] + k] == words[b[left] + k]
        stop = left[~ok]
        diff = words[a[stop] + k] ^ words[b[stop] + k]
        same = np.zeros(len(stop), np.int64)
        for j in (3, 2, 1):
            same[(diff & np.uint64((1 << (16 * j)) - 1)) == 0] += 1
        got[stop] = k + same
        left, k = left[ok], k + 4
        got[left] = k
    plcp = np.zeros(n, np.int64)
    if len(irr):  # from one irreducible value to the next, each is one less
        plcp[irr[0] :] = np.maximum(np.repeat(got + irr, np.diff(np.append(irr, n))) - np.arange(irr[0], n), 0)
    plcp[phi < 0] = 0
    return plcp, phi

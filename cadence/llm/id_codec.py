"""Token ids in a compact binary form: adaptive context mixing drives an arithmetic coder.

A *segment* holds the ids of whole documents, end to end, cut into blocks of
``BLOCK`` ids. Every block has its own coder, models and checksum, so any block
can be read alone, with the segment's number table: ids by falling count, so that the
commonest have the smallest numbers, and the shares that order 0 starts with. Blocks code these numbers. numpy runs all blocks of a segment in step, one lane a block.

For each id three predictions mix:

* order 2, the id that last followed these two ids, and order 1, that followed
  the last one: each is a point forecast with a run of past hits;
* order 0, adaptive frequencies: the segment's shares, then the block's ids so far.

One arithmetic-coding step says which forecast holds (order 2, order 1, none).
Its chances mix two adaptive estimates, one by the forecasts' runs of hits and one by
the block's last outcomes; the mixing weight is the Bayesian posterior of the
two and so follows whichever predicts better. Only where no forecast holds, a second step
codes the id by order 0: numbers under 1024 are symbols of their own, larger ones
share a symbol by bit length and five leading bits and send the rest plain.

The coder is a carry-less range coder with 48-bit state and 16-bit output words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TIC2"
BLOCK = 2048
#: Blocks that run in step, at most.
LANES = 4096
_OWN_BITS, _LEAD = 10, 5
_HASH_BITS = 11
_TOTAL = 1 << 16
_LOW48 = np.uint64((1 << 48) - 1)
_LOW32 = np.uint64((1 << 32) - 1)
_BOTTOM = np.uint64(1 << 32)
_S16, _S32 = np.uint64(16), np.uint64(32)
_HASH1, _HASH2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
#: Symbols that a search looks through at once.
_GROUP = 32
_ADAPT = 4  # an estimate moves by 1 / 2**_ADAPT of its error
#: What a block's order 0 starts with counts as this many ids of its own, and an id seen as this many.
_START, _SEEN = 1500, 1


class _Coder:
    """lo and range of every lane; a range under 2**32 lets 16 bits go."""

    def __init__(self, lanes: int):
        self.lo = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 1 << 48, np.uint64)

    def _settle(self, who: np.ndarray) -> np.ndarray:
        """Lanes with too small a range; where the interval straddles a word's border, only its lower part stays."""
        lo, r = self.lo[who], self.range[who]
        split = (lo >> _S32) != ((lo + r - np.uint64(1)) >> _S32)
        self.range[who] = np.where(split, _BOTTOM - (lo & _LOW32), r)
        return who


class _Writer(_Coder):
    def __init__(self, lanes: int, room: int):
        super().__init__(lanes)
        self.out = np.zeros((lanes, room), "<u2")
        self.at = np.zeros(lanes, np.int64)

    def code(self, who, low: np.ndarray, width: np.ndarray, shift: int = 16) -> None:
        """Code [low, low + width) of 2**shift for the lanes ``who`` (a slice or an index array)."""
        r = self.range[who] >> np.uint64(shift)
        self.lo[who] += r * low.astype(np.uint64)
        self.range[who] = r * width.astype(np.uint64)
        self._emit()

    def _emit(self) -> None:
        while len(who := np.flatnonzero(self.range < _BOTTOM)):
            self._settle(who)
            lo = self.lo[who]
            self.out[who, self.at[who]] = (lo >> _S32).astype(np.uint16)
            self.at[who] += 1
            self.lo[who] = (lo << _S16) & _LOW48
            self.range[who] <<= _S16

    def end(self) -> list[bytes]:
        """Three words tell the last interval's lower end."""
        rows = np.arange(len(self.at))
        for s in (32, 16, 0):
            self.out[rows, self.at] = (self.lo >> np.uint64(s)).astype(np.uint16)
            self.at += 1
        return [self.out[i, :n].tobytes() for i, n in enumerate(self.at.tolist())]


class _Reader(_Coder):
    def __init__(self, blocks: list[bytes]):
        super().__init__(len(blocks))
        self.data = np.zeros((len(blocks), max(map(len, blocks)) // 2 + 4), np.uint64)
        for i, b in enumerate(blocks):
            self.data[i, : len(b) // 2] = np.frombuffer(b, "<u2")
        self.at = np.full(len(blocks), 3)
        self.value = self.data[:, 0] << _S32 | self.data[:, 1] << _S16 | self.data[:, 2]

    def place(self, who, shift: int = 16) -> np.ndarray:
        """Where in [0, 2**shift) each lane's value lies."""
        self.unit = self.range[who] >> np.uint64(shift)
        return np.minimum((self.value[who] - self.lo[who]) // self.unit, np.uint64((1 << shift) - 1)).astype(np.int64)

    def code(self, who, low: np.ndarray, width: np.ndarray) -> None:
        """Take the step that ``place`` (called just before) found."""
        self.lo[who] += self.unit * low.astype(np.uint64)
        self.range[who] = self.unit * width.astype(np.uint64)
        while len(few := np.flatnonzero(self.range < _BOTTOM)):
            self._settle(few)
            self.lo[few] = (self.lo[few] << _S16) & _LOW48
            self.range[few] <<= _S16
            at = np.minimum(self.at[few], self.data.shape[1] - 1)
            self.value[few] = (self.value[few] << _S16) & _LOW48 | self.data[few, at]
            self.at[few] += 1


def _classes(bits: int) -> int:
    """Symbols that larger numbers share."""
    return max(0, bits - _OWN_BITS) << _LEAD


class _Models:
    """What coder and decoder learn alike; one row a lane. ``bits``: bit length of the largest number, ``start``: what order 0 starts with."""

    def __init__(self, lanes: int, bits: int, start: np.ndarray):
        self.lane = np.arange(lanes, dtype=np.int32)
        size = 1 << _HASH_BITS
        self.table = np.full((2, lanes * size), -1, np.int32)  # forecast << 2 | run of hits (0 .. 3), by order
        self.home = self.lane * size
        self.last = np.zeros((2, lanes), np.uint32)
        self.chance = np.full((2, 2, lanes * 16), 0.25, np.float32)  # order, estimate (by runs, by past)
        self.weight = np.full(lanes, 0.5, np.float32)  # of the estimates by runs
        self.past = np.zeros(lanes, np.int32)
        # order 0: shares in the segment for the start, then counts of the block itself
        own = 1 << _OWN_BITS
        classes = _classes(bits)
        share = start.astype(np.float64) + 0.05
        self.count = np.tile((share * (_START / share.sum())).astype(np.float32), (lanes, 1))
        self.symbols = own + classes  # a multiple of _GROUP
        self.offset = self.lane * np.int32(_TOTAL)  # 2**12 lanes of 2**16: 28 bits
        self.rebuild()

    def rebuild(self) -> None:
        """Frequencies (each at least 1, all of them 2**16) from the counts."""
        scale = np.float32(_TOTAL - self.symbols - 1) / self.count.sum(axis=1, dtype=np.float64).astype(np.float32)
        self.cum = np.zeros((len(self.count), self.symbols + 1), np.int32)
        np.cumsum((self.count * scale[:, None]).astype(np.int32) + 1, axis=1, out=self.cum[:, 1:])
        self.cum[:, -1] = _TOTAL
        self.groups = self.cum[:, :-1].reshape(len(self.count), -1, _GROUP)
        self.coarse = (self.groups[:, :, 0] + self.offset[:, None]).ravel()

    def find(self, who: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Symbol of each lane in ``who`` whose frequencies cover ``place``: its group first, then in the group."""
        group = np.searchsorted(self.coarse, (place + self.offset[who]).astype(np.int32), side="right") - 1 - who * self.groups.shape[1]
        return group * _GROUP + (self.groups[who, group] <= place[:, None]).sum(axis=1) - 1

    def forecast(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of the first ``n`` lanes' orders 2 and 1, and what they hold."""
        h = self.last[0, :n] * _HASH1
        top = np.uint32(32 - _HASH_BITS)
        self.rows = (self.home[:n] + ((h + self.last[1, :n] * _HASH2) >> top).view(np.int32), self.home[:n] + (h >> top).view(np.int32))
        e2, e1 = self.table[0][self.rows[0]], self.table[1][self.rows[1]]
        self.entry = (e2, e1)
        g2, g1 = e2 >> 2, e1 >> 2
        g1 = np.where(g1 == g2, -1, g1)
        ctx = (e2 & 3) << 2 | (e1 & 3)
        at = self.lane[:n] * 16
        self.at = (at + ctx, at + self.past[:n])
        c = self.chance
        self.est = [[c[o, k][self.at[k]] for k in (0, 1)] for o in (0, 1)]
        w = self.weight[:n]
        # mixed chances of (order 2 holds) and (order 1 holds, given that order 2 does not), as places in 2**16
        p2 = w * self.est[0][0] + (1 - w) * self.est[0][1]
        p1 = w * self.est[1][0] + (1 - w) * self.est[1][1]
        p2 = np.where(g2 < 0, np.float32(0), p2)
        p1 = np.where(g1 < 0, np.float32(0), p1)
        cut2 = (p2 * np.float32(65000)).astype(np.int32) + (g2 >= 0)
        cut1 = cut2 + (p1 * (65000 - cut2).astype(np.float32)).astype(np.int32) + (g1 >= 0)
        self.cuts = (cut2, cut1)
        return g2, g1

    def learn(self, n: int, ids: np.ndarray, kind: np.ndarray, g2: np.ndarray, g1: np.ndarray) -> None:
        """``kind``: 0 order 2 held, 1 order 1, 2 neither."""
        hit2, hit1 = (kind == 0).astype(np.float32), (kind == 1).astype(np.float32)
        like = []
        for k in (0, 1):
            a, b = self.est[0][k], self.est[1][k]
            like.append(np.where(kind == 0, a, (1 - a) * np.where(kind == 1, b, 1 - b)))
        w = self.weight[:n] * like[0]
        self.weight[:n] = np.clip(w / (w + (1 - self.weight[:n]) * like[1] + np.float32(1e-9)), 0.02, 0.98)
        step = np.float32(1 / (1 << _ADAPT))
        has2, has1 = g2 >= 0, (g1 >= 0) & (kind != 0)
        for k in (0, 1):
            at = self.at[k]
            self.chance[0, k][at] = self.est[0][k] + step * has2 * (hit2 * np.float32(0.998) + np.float32(0.001) - self.est[0][k])
            self.chance[1, k][at] = self.est[1][k] + step * has1 * (hit1 * np.float32(0.998) + np.float32(0.001) - self.est[1][k])
        self.past[:n] = (self.past[:n] << 2 & 15) | kind
        for o in (0, 1):
            e = self.entry[o]
            held = (e >> 2) == ids
            self.table[o][self.rows[o]] = ids << 2 | np.where(held, np.minimum((e & 3) + 1, 3), 0)
        self.last[1, :n] = self.last[0, :n]
        self.last[0, :n] = ids

    @staticmethod
    def symbol(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each id and how many plain bits follow."""
        long = ids >> _OWN_BITS > 0
        size = np.where(long, np.frexp(ids.astype(np.float64))[1], 0)
        plain = np.where(long, size - 1 - _LEAD, 0)
        own = 1 << _OWN_BITS
        return np.where(long, own + ((size - 1 - _OWN_BITS) << _LEAD) + ((ids >> plain) & ((1 << _LEAD) - 1)), ids), plain

    def opened(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest id of each symbol, and how many plain bits follow."""
        own = 1 << _OWN_BITS
        k = np.maximum(symbol - own, 0)
        long = symbol >= own
        plain = np.where(long, (k >> _LEAD) + _OWN_BITS - _LEAD, 0)
        return np.where(long, ((1 << _LEAD) + (k & ((1 << _LEAD) - 1))) << plain, symbol), plain


def _due(t: int) -> bool:
    """Order 0 is rebuilt at steps 16, 32, 64 ... 512, and then every 512."""
    return t >= 16 and (t & (t - 1) == 0 if t < 512 else t % 512 == 0)


def _encode_lanes(grid: np.ndarray, n: np.ndarray, bits: int, start: np.ndarray) -> list[bytes]:
    m, coder = _Models(len(n), bits, start), _Writer(len(n), BLOCK * 4 + 64)
    for t in range(grid.shape[1]):
        k = int(np.searchsorted(-n, -t))  # only the last lanes may be short
        if _due(t):
            m.rebuild()
        ids = grid[:k, t]
        g2, g1 = m.forecast(k)
        cut2, cut1 = m.cuts
        kind = np.where(ids == g2, 0, np.where(ids == g1, 1, 2)).astype(np.int32)
        low = np.where(kind == 0, 0, np.where(kind == 1, cut2, cut1))
        high = np.where(kind == 0, cut2, np.where(kind == 1, cut1, _TOTAL))
        coder.code(slice(0, k), low, high - low)
        who = np.flatnonzero(kind == 2)
        if len(who):
            some = ids[who]
            symbol, plain = m.symbol(some)
            low = m.cum[who, symbol]
            coder.code(who, low, m.cum[who, symbol + 1] - low)
            m.count[who, symbol] += _SEEN
            on = np.flatnonzero(plain)
            if len(on):
                coder.code(who[on], (some[on] & ((1 << plain[on]) - 1)) << (24 - plain[on]), np.int64(1) << (24 - plain[on]), 24)
        m.learn(k, ids, kind, g2, g1)
    return coder.end()


def _decode_lanes(blocks: list[bytes], n: np.ndarray, bits: int, start: np.ndarray) -> np.ndarray:
    m, coder = _Models(len(n), bits, start), _Reader(blocks)
    grid = np.zeros((len(n), int(n.max())), "<u4")
    for t in range(grid.shape[1]):
        k = int(np.searchsorted(-n, -t))
        if _due(t):
            m.rebuild()
        g2, g1 = m.forecast(k)
        cut2, cut1 = m.cuts
        v = coder.place(slice(0, k))
        kind = (v >= cut2).astype(np.int32) + (v >= cut1)
        low = np.where(kind == 0, 0, np.where(kind == 1, cut2, cut1))
        high = np.where(kind == 0, cut2, np.where(kind == 1, cut1, _TOTAL))
        coder.code(slice(0, k), low, high - low)
        ids = np.where(kind == 0, g2, g1)
        who = np.flatnonzero(kind == 2)
        if len(who):
            v = coder.place(who)
            symbol = m.find(who, v)
            low = m.cum[who, symbol]
            coder.code(who, low, m.cum[who, symbol + 1] - low)
            m.count[who, symbol] += _SEEN
            some, plain = m.opened(symbol)
            on = np.flatnonzero(plain)
            if len(on):
                rest = coder.place(who[on], 24) >> (24 - plain[on])
                coder.code(who[on], rest << (24 - plain[on]), np.int64(1) << (24 - plain[on]))
                some[on] += rest
            ids[who] = some
        grid[:k, t] = ids
        m.learn(k, ids, kind, g2, g1)
    return grid


def encode(ids: np.ndarray) -> bytes:
    """A segment: magic, number of ids, block size, size and checksum of the number table; that table; length and ids' checksum of each block; the blocks.

    Ids are unsigned and below 2**24.
    """
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> 24:
        raise ValueError("an id of 2**24 or more")
    seen = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    known = np.argsort(-seen, kind="stable")[: np.count_nonzero(seen)].astype("<u4")  # ids by falling count: their numbers
    number = np.zeros(len(seen), np.int32)
    number[known] = np.arange(len(known))
    bits = _bits(known)
    start = np.bincount(_Models.symbol(np.arange(len(known)))[0], seen[known], (1 << _OWN_BITS) + _classes(bits))
    start = np.ceil(start * (65535 / max(1, start.max()))).astype("<u2")
    head = zlib.compress(struct.pack("<I", len(known)) + known.tobytes() + start.tobytes())
    parts = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    coded: list[bytes] = []
    for first in range(0, len(parts), LANES):
        some = parts[first : first + LANES]
        n = np.array([len(p) for p in some])
        grid = np.zeros((len(some), int(n.max())), np.int32)
        for i, p in enumerate(some):
            grid[i, : len(p)] = number[p]
        coded += _encode_lanes(grid, n, bits, start)
    table = b"".join(struct.pack("<II", len(c), zlib.crc32(p.tobytes())) for c, p in zip(coded, parts, strict=True))
    return MAGIC + struct.pack("<QIII", len(ids), BLOCK, len(head), zlib.crc32(head)) + head + table + b"".join(coded)


def _bits(known: np.ndarray) -> int:
    return max(0, len(known) - 1).bit_length()


def decode(data: bytes, blocks: range | None = None) -> np.ndarray:
    """The ids of a segment, or of some of its blocks; checks every block it reads."""
    if data[:4] != MAGIC:
        raise ValueError("not a token-id segment")
    total, size, length, crc = struct.unpack_from("<QIII", data, 4)
    head = data[24 : 24 + length]
    if zlib.crc32(head) != crc:
        raise ValueError("number table: checksum differs")
    head = zlib.decompress(head)
    known = np.frombuffer(head, "<u4", struct.unpack_from("<I", head)[0], 4)
    start, bits = np.frombuffer(head, "<u2", -1, 4 + known.nbytes), _bits(known)
    count = -(-total // size)
    table = np.frombuffer(data, "<u4", 2 * count, 24 + length).reshape(-1, 2).astype(np.int64)
    at = 24 + length + 8 * count + np.concatenate([[0], np.cumsum(table[:, 0])])
    which = list(blocks if blocks is not None else range(count))
    out = []
    for first in range(0, len(which), LANES):
        some = which[first : first + LANES]
        n = np.array([min(size, total - size * b) for b in some])
        grid = _decode_lanes([data[at[b] : at[b + 1]] for b in some], n, bits, start)
        for i, b in enumerate(some):
            ids = known[np.minimum(grid[i, : n[i]], len(known) - 1)]  # a damaged block may name any number
            if zlib.crc32(ids.tobytes()) != table[b, 1]:
                raise ValueError(f"block {b}: checksum differs")
            out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, "<u4")

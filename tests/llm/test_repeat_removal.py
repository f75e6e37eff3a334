"""Removal of repeated strings against brute force; suffix arrays and common prefixes against sorting."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from cadence.llm import repeat_removal, suffix_sort
from cadence.llm.common import table
from cadence.llm.suffix_sort import permuted_lcp, suffix_array


def brute(rows, length: int = 200) -> list[tuple]:
    seen = Counter(b[i : i + length] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(0)
    for it in range(250):
        n, sigma = int(rng.integers(1, 60 if it % 4 else 1500)), int(rng.integers(1, 6))
        body = rng.integers(1, sigma + 1, n)
        if it % 3 == 0:
            body = np.tile(body[: int(rng.integers(1, 7))], int(rng.integers(1, 12)))
        t = np.append(body, 0)
        text = t.tolist()
        sa = suffix_array(t, sigma + 1)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: text[i:])  # noqa: B023
        plcp, phi = permuted_lcp(t, sa, 10**9)
        for x in range(1, len(sa)):
            i, j, k = int(sa[x]), int(sa[x - 1]), 0
            while max(i, j) + k < len(text) and text[i + k] == text[j + k]:
                k += 1
            assert phi[i] == j and plcp[i] == k


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(w[2] for w in want) > 1000
    assert got(repeat_removal.removed(docs)) == want


def planted(rng: random.Random) -> list[tuple]:
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    long, edge, short = prose(120), prose(45), prose(20)
    rows = [(i, prose(rng.randrange(1, 60)) + rng.choice([long, edge, short, " "]) + prose(rng.randrange(0, 40))) for i in range(120)]
    rows += [(500, "ab" * 300), (501, "x" * 199), (502, "x" * 200), (503, "x" * 201), (504, "y" * 600), (505, long * 3)]
    rows += [(600 + i, rows[i % 3][1]) for i in range(40)] + [(700, long[:-1]), (701, long[1:]), (None, long), (700, None), (7, ""), (8, prose(3000))]
    return rows


def test_passages_copies_periods_and_hot_edges(spark, monkeypatch):
    rows = planted(random.Random(6))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, s int, key string").repartition(3)
    want = brute(rows)
    assert got(repeat_removal.removed(docs)) == want
    monkeypatch.setattr(repeat_removal, "HOT", 3)
    monkeypatch.setattr(repeat_removal, "SHARD_BYTES", 2000)
    monkeypatch.setattr(repeat_removal, "_BROADCAST_ROWS", 0)
    kept = repeat_removal.removed(docs, with_kept=True)
    assert got(kept) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in kept.collect())
    assert repeat_removal.removed(docs.limit(0)).count() == 0


def test_other_lengths(spark):
    rows = planted(random.Random(9))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(repeat_removal.removed(docs, length=60, gram=20)) == brute(rows, 60)


def test_anchors_do_not_depend_on_the_slice():
    """Equal windows get equal anchors, also where the upper bits of hashes tie and slices differ in size."""
    rng = np.random.default_rng(3)
    for bits in (3, 8, 34, 64):
        block = rng.integers(0, 1 << 62, 400, dtype=np.uint64) << np.uint64(64 - bits) if bits < 64 else rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        small = repeat_removal._least(block, 153)
        for before, after in ((0, 1), (1 << 16, 5), (7, 1 << 20), (1 << 20, 1 << 20)):
            h = np.concatenate([rng.integers(0, 1 << 63, before, dtype=np.uint64), block, rng.integers(0, 1 << 63, after, dtype=np.uint64)])
            assert (repeat_removal._least(h, 153)[before : before + len(small)] - before).tolist() == small.tolist()


def test_a_shard_tells_repeats_from_texts_alone():
    rng = random.Random(4)
    for _ in range(400):
        raws = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(6, 40))).encode() for _ in range(rng.randrange(1, 12))})
        rng.shuffle(raws)
        raws += rng.sample(raws, rng.randrange(len(raws) + 1))
        seen = Counter(r[i : i + 6] for r in raws for i in range(len(r) - 5))
        got = {(i, k) for i, a, b in zip(*(x.tolist() for x in repeat_removal.repeated_runs(raws, 6)), strict=True) for k in range(a, b + 1)}
        assert got == {(i, k) for i, r in enumerate(raws) for k in range(len(r) - 5) if seen[r[k : k + 6]] > 1}


def test_suffixes_of_repetitive_strings_and_prefixes_of_a_least_length():
    rng = np.random.default_rng(5)
    for sigma in (3, 5, 40, 300):
        for _ in range(6):
            piece = rng.integers(1, sigma, rng.integers(2, 90))
            t = np.concatenate([piece, piece, rng.integers(1, sigma, 200), piece, np.repeat(piece[:1], 30), [0]]).astype(np.int16)
            sa = suffix_array(t, sigma)
            assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
            full, phi = permuted_lcp(t, sa, len(t))
            for least in (4, 20, 60):
                some, same = permuted_lcp(t, sa, len(t), least)
                assert (same == phi).all() and (some <= full).all() and (some[full >= least] == full[full >= least]).all()


def test_induction_looks_once_at_the_symbol_before(monkeypatch):
    """A scan sorts only positions that it places: none for empty places, the first position or the other type."""
    seen: list[int] = []
    append = suffix_sort._append

    def counted(sa, fill, pos, sym, sign):
        assert len(pos) == len(sym) and (pos >= 0).all()
        seen.append(len(pos))
        append(sa, fill, pos, sym, sign)

    monkeypatch.setattr(suffix_sort, "_append", counted)
    rng = np.random.default_rng(5)
    t = np.append(np.tile(rng.integers(1, 5, 300), 4), 0).astype(np.int16)
    sa = suffix_array(t, 5)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert min(seen) > 0
    plcp, phi = permuted_lcp(t, sa, len(t))
    for i in range(0, len(t), 7):
        n = 0
        while phi[i] >= 0 and max(i, phi[i]) + n < len(t) and t[i + n] == t[phi[i] + n]:
            n += 1
        assert plcp[i] == n

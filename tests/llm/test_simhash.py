"""SimHash against brute force: fingerprints bit by bit, components over all pairs, dealt buckets, defined cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from cadence.llm import simhash
from cadence.llm.common import table

LOW = {i: i + 32 for i in range(65, 91)}


def plain_fingerprint(text: str | None, k: int = 4) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps: list[int], ids: list, distance: int = 4) -> list:
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    u = sorted(up)
    a = np.array(u, np.uint64)
    for i, f in enumerate(u):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= distance):
            up[find(u[i + 1 + int(j)])] = find(f)
    least: dict = {}
    for f, i in zip(fps, ids, strict=True):
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [least.get(find(f)) for f in fps]


def want(rows) -> list[tuple]:
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components(fps, [i for i, _ in rows])
    return sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comp, strict=True)), key=str)


def got(df) -> list[tuple]:
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    expected = want([(r.doc_id, r.text) for r in docs.collect()])
    assert len({c for _, _, c in expected}) < len(expected)
    assert got(simhash.report(docs)) == expected


def test_defined_cases(spark):
    long = " ".join(f"Wörd{i % 977}" for i in range(70_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (4, "one"), (None, "ONE x two"), (5, "a b c"), (6, "a  b\tC"), (7, "ab c"), (8, long),
            (9, long.replace(" ", "\n")), (None, long), (10, "x y z w " * 300), (11, "É é É é É"), (12, "a\x85b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "'q' AS fingerprint", "2 AS component_id", "3 AS t", "4 AS way")
    expected = want(rows)
    assert ("0" * 16) in {f for _, f, _ in expected}
    assert got(simhash.report(docs)) == expected
    assert simhash.report(docs.where("false")).collect() == []
    named = simhash.report(docs.selectExpr("concat('d', doc_id) AS doc_id", "text"))  # identifiers of any type
    assert {r.component_id for r in named.collect() if r.doc_id in ("d8", "d9")} == {"d8"}


@pytest.mark.parametrize("m", [None, 5, 6, 8])
def test_components_of_dense_clusters(spark, monkeypatch, m):
    """Chains and balls of close fingerprints, in buckets that are dealt in parts."""
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        for _ in range(80):  # a ball whose members are up to 12 bits apart
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))))
        for _ in range(40):  # a chain, 4 or 5 bits a step
            c ^= sum(1 << b for b in rng.sample(range(64), rng.choice([4, 4, 4, 5])))
            fps.add(c)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = spark.createDataFrame([(f,) for f in signed for _ in range(2)], "fp long")
    from cadence.llm.components import components

    root = {r.id: r.root for r in components(simhash.links(found, blocks=m)).collect()}
    comp = [root.get(f, f) for f in signed]
    expected = plain_components(fps, signed)
    assert len(set(comp)) < len(comp) - 200
    assert comp == expected


def test_spanning_links_is_a_forest():
    rng = np.random.Generator(np.random.PCG64(1))
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fp = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) for b in base]))
    a, b = simhash.spanning_links(fp, 4)
    assert len(a) == len(fp) - 5
    assert (np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= 4).all()


def test_bit_majority_of_long_runs():
    rng = np.random.Generator(np.random.PCG64(2))
    bounds = np.array([0, 0, 1, 3, 258, 258, 1500, 4000])
    h = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h[1500:4000] &= rng.integers(0, 1 << 63, 1, dtype=np.uint64)
    expected = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[lo:hi]) > hi - lo) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    assert simhash.bit_majority(h, bounds).tolist() == expected


def test_block_masks():
    for m in (5, 6, 7, 8):
        masks = [x & (2**64 - 1) for x in simhash.block_masks(m, 4)]
        rng = random.Random(m)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not diff & x for x in masks)

"""Hard negatives against brute force on integers: whole table, many blocks, sound intervals, defined cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.llm import hard_negatives as hn
from cadence.llm.common import table

VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])


def plain(rows, moved=True):
    use = []
    for i, v, lab in rows:
        if lab is None or v is None or not v or any(e is None or not math.isfinite(e) for e in v):
            continue
        if moved and i is not None and i % 7 == 0:
            lab = (lab + 1) % 10
        use.append((i, [math.floor(256 * e) for e in v], lab))
    key = lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0)
    out = []
    for a, (ai, av, al) in enumerate(use):
        if ai is None or ai % 100:
            continue
        scored = [(sum(p * q for p, q in zip(av, v, strict=True)), i, lab) for n, (i, v, lab) in enumerate(use) if n != a]
        for p, pi, _ in sorted((s for s in scored if s[2] == al), key=key)[:5]:
            neg = sorted((s for s in scored if s[2] != al and 80 * p <= 100 * s[0] <= 100 * p), key=key)[:5]
            out += [(ai, pi, r, ni, p, n) for r, (n, ni, _) in enumerate(neg, 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


@pytest.mark.parametrize("least", [1 << 10, 40])
def test_whole_table(spark, monkeypatch, least):
    monkeypatch.setattr(hn, "_LEAST", least)
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    expected = plain([(r.vec_id, list(r.embedding), r.label) for r in df.collect()])
    assert expected and got(hn.report(df)) == expected


def clustered(n, dims, seed, labels=4):
    rng = np.random.Generator(np.random.PCG64(seed))
    centre = rng.standard_normal((12, dims))
    lab = rng.integers(0, labels, n)
    v = centre[rng.integers(0, 12, n)] + 0.35 * rng.standard_normal((n, dims))
    return [(i, v[i].tolist(), int(lab[i])) for i in range(n)]


@pytest.mark.parametrize("dims", [3, 70])
def test_close_scores_ties_and_copies(spark, monkeypatch, dims):
    """Many negatives in the bands, a hot vector, one hot label, repeated and null identifiers; blocks smaller than a batch."""
    monkeypatch.setattr(hn, "BLOCK", 150)
    monkeypatch.setattr(hn, "_CELLS", 700)
    rows = clustered(500, dims, dims)
    rows += [(1000 + i, rows[0][1], i % 4) for i in range(200)]  # equal scores
    rows += [(100, rows[5][1], 1), (100, rows[5][1], 1), (None, rows[5][1], 1), (None, rows[5][1], 2)]
    df = spark.createDataFrame(rows, VEC).repartition(5)
    expected = plain(rows)
    assert len(expected) > 100
    assert got(hn.report(df)) == expected


def test_intervals_hold_and_filter():
    rng = np.random.Generator(np.random.PCG64(3))
    for dims in (1, 5, 64, 100):
        x = rng.integers(-300, 300, (400, dims))
        x[:5] = 0
        x[5:10] *= 100_000
        q = np.concatenate([x[:20], rng.integers(-5, 5, (10, dims)), np.full((1, dims), 7)])
        words, align = hn.encode(x)
        mid, half = hn.intervals(q, hn.Codes(words, align, hn.norms(x)))
        true = q.astype(object) @ x.T.astype(object)
        assert (np.abs(true.astype(float) - mid) <= half).all()
    # a close pair is told from a far one
    base = rng.standard_normal((1, 64)) * 200
    x = np.floor(np.concatenate([base + rng.standard_normal((50, 64)) * 20, rng.standard_normal((500, 64)) * 200])).astype(np.int64)
    words, align = hn.encode(x)
    mid, half = hn.intervals(np.floor(base).astype(np.int64), hn.Codes(words, align, hn.norms(x)))
    bar = np.sort((x @ np.floor(base).astype(np.int64)[0]))[-5]
    assert ((mid + half)[0] >= bar).sum() < 250


def test_defined_cases(spark):
    nan = float("nan")
    good = [(0, [1.0, 0.5], 0), (100, [0.9, 0.6], 0), (1, [1.0, 0.4], 0), (2, [0.8, 0.5], 1), (3, [0.9, 0.45], 2), (200, [-1.0, -1.0], 5), (300, [0.0, 0.0], 6), (301, [0.0, 1.0], 6), (None, [0.8, 0.5], 3)]
    bad = [(4, None, 0), (5, [], 0), (6, [nan, 1.0], 0), (8, [1.0, None], 1), (9, [1.0, 1.0], None), (10, [1.0], 1), (11, [1.0, 1.0, 1.0], 1)]
    df = spark.createDataFrame(good + bad, VEC).selectExpr("*", "1 AS id", "'x' AS rid", "2 AS block", "3 AS score", "4 AS anchor")
    assert got(hn.report(df)) == plain(good)
    assert hn.report(df.where("false")).collect() == []
    assert hn.report(df.where("label IS NULL")).collect() == []
    assert hn.report(df.where("vec_id = 0")).collect() == []


def test_general_interface(spark):
    rows = clustered(60, 4, 9, labels=2)
    df = spark.createDataFrame([(f"v{i:03}", v, "red" if lab else "blue") for i, v, lab in rows], "key string, v array<double>, colour string")
    out = hn.mine(df, id_col="key", vec_col="v", label=F.col("colour"), anchor=F.col("key") < "v005", positives=2, negatives=3, num=50, den=100)
    assert {r.anchor_id for r in out.collect()} <= {f"v{i:03}" for i in range(5)}
    assert out.where("100 * negative_score > 100 * positive_score OR 50 * positive_score > 100 * negative_score OR rank > 3").count() == 0


def test_large_components(spark):
    rows = [(i, [1e30 if i % 2 else 3e5, float(i)], i % 3) for i in range(12)]
    out = hn.mine(spark.createDataFrame(rows, VEC), anchor=F.col("vec_id") == 0)
    assert out.columns and out.collect() is not None

"""The exact Jaccard join against brute force: whole table, dense random sets, hot shards in blocks, defined cases."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np

from cadence.llm import common, jaccard_join
from cadence.llm import components as graph
from cadence.llm.common import table
from cadence.llm.components import components

LOW = {i: i + 32 for i in range(65, 91)}


def shingles(t: str | None, k: int = 4) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, num=85, den=100) -> list[tuple]:
    sets = [shingles(t) for _, t in rows]
    home = defaultdict(list)
    for x, s in enumerate(sets):
        for e in s:
            home[e].append(x)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, s in enumerate(sets):
        common = defaultdict(int)
        for e in s:
            for y in home[e]:
                if y < x:
                    common[y] += 1
        for y, c in common.items():
            if den * c >= num * (len(s) + len(sets[y]) - c):
                up[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        r = find(x)
        if i is not None and (least.get(r) is None or i < least[r]):
            least[r] = i
    return sorted(((i, len(s), i if not s else least.get(find(x))) for x, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df) -> list[tuple]:
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len({w[2] for w in want}) < len(want) - 50
    assert got(jaccard_join.report(docs)) == want


def edited(rng: random.Random, base: list[str], edits: int) -> list[str]:
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def test_chains_near_the_threshold_and_hot_passages(spark, monkeypatch):
    rng = random.Random(2)
    hot = [f"h{i}" for i in range(30)]
    rows, k = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(8):
            base = edited(rng, base, rng.choice([0, 1, 2, len(base) // 60]))  # a chain whose ends need not link
            rows.append((k := k + 1, " ".join(base)))
        rows.append((k := k + 1, " ".join(base + hot)))
    for _ in range(150):  # one passage that many documents share
        rows.append((k := k + 1, " ".join([f"u{rng.randrange(10**6)}" for _ in range(rng.choice([5, 20, 200]))] + hot)))
    near = [f"n{i}" for i in range(200)]
    for _ in range(150):  # one large group of near copies
        rows.append((k := k + 1, " ".join(edited(rng, near, 2))))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert got(jaccard_join.report(docs)) == want
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert got(jaccard_join.report(docs)) == want
    one = jaccard_join.one_each(docs)
    assert sorted(r.doc_id for r in one.collect()) == sorted({w[2] for w in want})


def test_defined_cases(spark):
    schema = "doc_id long, text string, n int, token string, root int"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A\tB"), (6, "a b c"), (7, "a b c d"), (8, "a b c d"), (None, "A b C d"), (9, "x y z w v"),
            (9, "x y z w v"), (9, "other words in here now"), (None, "only null here at all"), (10, "é É b c d"), (11, "long one " * 30000)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], schema)
    assert got(jaccard_join.report(docs)) == brute(rows)
    one = jaccard_join.one_each(docs)
    assert one.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in one.collect()) == [0, 1, 2, 3, 4, 6, 7, 9, 9, 10, 11]
    assert jaccard_join.report(docs.limit(0)).count() == 0


def test_tree_loses_no_pair():
    rng = np.random.default_rng(7)
    for _ in range(20):
        base = [rng.integers(0, 2**63, rng.integers(3, 400)).astype(np.uint64) for _ in range(6)]
        sets = []
        for _ in range(60):
            s = base[rng.integers(6)].copy()
            hit = rng.random(len(s)) < rng.choice([0, 0.02, 0.1, 0.5])
            s[hit] = rng.integers(0, 2**63, int(hit.sum()))
            sets.append(np.unique(s))
        sets.sort(key=len)
        n = np.array([len(s) for s in sets])
        bits = np.frombuffer(b"".join(jaccard_join.bitmap(s).tobytes() for s in sets), np.uint64).reshape(len(sets), -1)
        pairs = {(int(a), int(b)) for x, y in jaccard_join.Tree(bits, n).pairs(85, 100, np.arange(60)) for a, b in zip(x, y, strict=True)}
        for a in range(60):
            for b in range(a + 1, 60):
                c = len(np.intersect1d(sets[a], sets[b]))
                if 100 * c >= 85 * (n[a] + n[b] - c):
                    assert (a, b) in pairs


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 199), (199, 200)]
    got_ = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got_ == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 199: 199, 200: 199}


def _roots(edges) -> dict:
    up: dict = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


def test_sketch_reaches_the_driver_in_small_parts(spark, monkeypatch):
    """However few tasks summed it: no result that the driver takes at once holds much of the sketch."""
    kept = {}

    def record(df, name):
        kept[name] = common.materialize(df, name)
        return kept[name]

    monkeypatch.setattr(jaccard_join, "materialize", record)
    docs = spark.createDataFrame([(i, f"a b c d e{i // 2}") for i in range(20)], "doc_id long, text string")
    assert len({w[2] for w in got(jaccard_join.report(docs))}) == 10
    parts = kept["jaccard-sketch"]
    rows = [sum(1 for _ in p) for p in parts.select("chunk").rdd.glom().collect()]
    assert sum(rows) == (1 << jaccard_join._SKETCH) // jaccard_join._CHUNK
    assert max(rows) * jaccard_join._CHUNK <= 12 << 20


def test_small_components_need_no_round(spark, monkeypatch):
    """The edges of one task are stars when they are written: no plan of joins follows."""
    written = []

    def record(df, name):
        written.append(name)
        return common.materialize(df, name)

    monkeypatch.setattr(graph, "materialize", record)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 199), (199, 200), (3, 35)]
    found = [(r.id, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(found) == len(dict(found)) and dict(found) == _roots(edges)
    assert written == ["edges"]


def test_components_contracted_in_pieces(spark, monkeypatch):
    """Edges that several tasks hold, each contracted a few at a time; and an empty table."""
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    monkeypatch.setattr(graph, "EDGES", 3)
    try:
        rng = random.Random(8)
        x = [rng.randrange(-(2**62), 2**62) for _ in range(90)]
        edges = list(zip(x[:40], x[1:41], strict=True)) + [(x[50], y) for y in x[51:70]] + [(rng.choice(x[70:]), rng.choice(x[70:])) for _ in range(12)]
        found = [(r.id, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
        assert len(found) == len(dict(found)) and dict(found) == _roots(edges)
        assert components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sets_inside_others_at_other_thresholds(spark):
    rng = random.Random(21)
    rows = []
    for x in range(12):  # a text and its beginning: sets of 100 and 99, and of other sizes next to a multiple of 50
        w = [f"w{x}x{i}" for i in range(400)]
        for n in (103, 102) if x < 6 else (rng.randrange(49, 56) + 100, rng.randrange(49, 56) + 100):
            rows.append((len(rows), " ".join(w[:n])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for num, den in ((99, 100), (1, 50)):
        want = brute(rows, num, den)
        assert len({w[2] for w in want}) < len(want) - 5
        assert got(jaccard_join.report(docs, num=num, den=den)) == want


def test_links_of_a_large_group_do_not_grow_with_its_pairs(spark, monkeypatch):
    words = [f"p{i}" for i in range(203)]  # sets of 180 to 200 shingles lie in two size bands, so near copies become two groups
    rows = [(i, " ".join([*words[: 181 + i % 20], *(f"u{i}x{j}" for j in range(6))])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 80)
    assert len({w[2] for w in want}) == 1
    for words_at_once in (jaccard_join._EXACT_WORDS, 0):  # bitmaps of a meeting's tokens, and pair by pair
        monkeypatch.setattr(jaccard_join, "_EXACT_WORDS", words_at_once)
        assert got(jaccard_join.report(docs, num=80)) == want
    _, edges = jaccard_join.links(docs, num=80)
    assert edges.count() <= 4 * len(rows)


def test_the_sketch_reaches_the_driver_in_a_few_jobs(spark):
    chunks = {0: [200, 100], 1: [3], 7: [1, 1], 2000: [255, 255, 255]}  # counts of the parts of each chunk's sum
    rows = [(c, bytearray(np.full(jaccard_join._CHUNK, n, np.uint8).tobytes())) for c, parts in chunks.items() for n in parts]
    seen = spark.createDataFrame(rows, "chunk int, counts binary")
    conf, sc = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "128m"}, spark.sparkContext
    was = {k: spark.conf.get(k) for k in conf}
    sc.setJobGroup("sketch", "sketch")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        level = jaccard_join._levels(seen)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
        for k in ("spark.jobGroup.id", "spark.job.description"):
            sc.setLocalProperty(k, None)
    assert len(sc.statusTracker().getJobIdsForGroup("sketch")) <= 16  # was one for each shuffle partition
    by_chunk = level.reshape(-1, jaccard_join._CHUNK)
    for c in range(len(by_chunk)):
        assert set(by_chunk[c].tolist()) == {min(sum(chunks.get(c, [0])), 255)}

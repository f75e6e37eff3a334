"""Columns named like the operators' own pass through unchanged; very long inputs end soon."""

from __future__ import annotations

import time

from cadence.llm import jaccard_join, pii, quality, stream_dedup, url_lists

OWN = "*, 'f' AS __file, 7 AS __row, 'l' AS __loc, 'h' AS __host, 'p' AS __pattern, 'a' AS __at, 'x' AS __action, 't' AS __t, 0 AS __c0, 'k' AS __kept"


def docs(spark):
    rows = [(1, "a b c d e f g h"), (2, "a  b c d e f g h"), (3, "quite another text of some words"), (4, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr(OWN.split(", ", 1)[0], *OWN.split(", ")[1:])


def test_user_columns_survive(spark):
    d = docs(spark)
    want = {r.doc_id: tuple(r) for r in d.collect()}
    for got in (stream_dedup.deduplicated(d), jaccard_join.one_each(d, k=5, num=80, den=100)):
        assert got.columns == d.columns
        kept = got.collect()
        assert {r.doc_id for r in kept} == {1, 3, 4} and all(tuple(r) == want[r.doc_id] for r in kept)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    long = d.selectExpr("doc_id", "concat_ws(' ', transform(sequence(1, 30 * doc_id), i -> concat('w', i))) AS text", *d.columns[2:])
    got = quality.kept_documents(long, labels)
    assert got.columns == long.columns and sorted(map(str, got.collect())) == sorted(map(str, long.collect()))


def test_url_columns_survive(spark):
    c = spark.createDataFrame([("http://a.b.c/x", "2024-05-01"), ("http://z.c/", "2024-05-01"), (None, "2024-05-01")], "url string, fetched string").selectExpr("*", *OWN.split(", ")[1:])
    e = spark.createDataFrame([("b.c", "block", "2024-01-01"), ("a.b.c", "allow", "2024-06-01")], "pattern string, action string, since string").selectExpr("pattern", "action", "CAST(since AS DATE) AS since")
    got = url_lists.allowed(c, e)
    assert got.columns == c.columns and sorted(map(str, got.collect())) == sorted(str(r) for r in c.collect() if r.url != "http://a.b.c/x")
    told = url_lists.verdicts(c, e, prefix="v_").collect()
    assert {r.url: r.v_pattern for r in told} == {"http://a.b.c/x": "b.c", "http://z.c/": None, None: None}
    assert all(r.__getitem__("__pattern") == "p" for r in told)


def test_host_of_very_many_labels(spark):
    host = ".".join(["x"] * 100_000) + ".b.c"
    c = spark.createDataFrame([(f"http://{host}/", "2024-05-01"), ("http://c/", "2024-05-01")], "url string, fetched string")
    e = spark.createDataFrame([("b.c", "block"), ("c", "allow")], "pattern string, action string").selectExpr("*", "DATE'2024-01-01' AS since")
    t = time.time()
    got = url_lists.verdicts(c, e).collect()
    assert {len(r.url) > 100: r.__getitem__("__pattern") for r in got} == {True: "b.c", False: "c"}
    assert time.time() - t < 60


def test_very_many_disguises():
    text = " ".join(f"name{i} at host{i} dot com," for i in range(200_000))
    t = time.time()
    base = pii.detect(text)
    more = pii.disguised(text, base)
    assert len(more["email"]) == 200_000 and time.time() - t < 120


def test_cover_against_plain():
    import random

    rng = random.Random(6)
    for _ in range(300):
        spans = [(a, a + rng.randrange(1, 9)) for a in (rng.randrange(40) for _ in range(rng.randrange(12)))]
        cover = pii.Cover(spans)
        assert cover.starts == sorted(set(cover.starts)) and cover.ends == sorted(set(cover.ends))
        for _ in range(40):
            a = rng.randrange(40)
            s = (a, a + rng.randrange(1, 9))
            assert (s in cover) == any(x <= s[0] and s[1] <= y for x, y in spans)

"""Streaming exact deduplication against a plain grouping; forced digest collisions; deliveries; defined cases."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from cadence.llm import stream_dedup
from cadence.llm.common import scratch_path, table

SF = "/root/testdata/sf0.001"


def norm(t: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected(rows) -> list[tuple]:
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        known = [x for x in g if x is not None]
        out.append((i, min(known) if known else None, len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


def test_whole_table_and_colliding_digests(spark):
    docs = table(spark, SF, "documents")
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    plain = stream_dedup.report(docs)
    assert got(plain) == want
    assert sorted(r.doc_id for r in plain.filter("kept").collect()) == sorted({w[1] for w in want})
    weak = stream_dedup.report(docs, key_of=lambda sha: F.substring(F.hex(sha), 1, 1))
    assert got(weak) == want  # sixteen keys: nearly every hit is a collision, told apart by full bytes
    assert weak.filter("kept").count() == plain.filter("kept").count()


def test_defined_cases(spark):
    schema = "doc_id long, text string, id string, file string, `key` int, n int"
    rows = [(1, None), (2, ""), (3, " "), (4, "\t\n "), (None, "a  b"), (7, "a b"), (7, "a\x0bb"), (None, None), (9, "a\x85b"), (8, "long " * 50000), (6, "long\n" * 50000)]
    docs = spark.createDataFrame([(i, t, "x", None, 1, 2) for i, t in rows], schema)
    rep = stream_dedup.report(docs)
    assert got(rep) == expected(rows)
    kept = stream_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 7, 9]  # of the two equal rows 7 one stays
    assert stream_dedup.report(docs.limit(0)).count() == 0
    assert stream_dedup.deduplicated(docs.limit(0)).count() == 0


def test_state_goes_on_with_a_later_delivery(spark):
    landing, state, path = (scratch_path(spark, x) for x in ("landing", "state", "docs"))
    first = spark.createDataFrame([(5, "a"), (6, "b")], "doc_id long, text string")
    first.coalesce(1).write.parquet(path)
    one = spark.read.parquet(path)
    assert got(stream_dedup.report(one, landing=landing, state=state)) == expected([(5, "a"), (6, "b")])
    new = scratch_path(spark, "docs")
    spark.createDataFrame([(3, "a"), (9, "c"), (10, "b ")], "doc_id long, text string").coalesce(1).write.parquet(new)
    spark.read.parquet(new).write.mode("append").parquet(path)
    rows = stream_dedup.decisions(spark.read.parquet(new), landing=landing, state=state, files_per_trigger=1)
    by = {(r.id, r.keep_id, r.n) for r in rows.collect()}
    assert {(3, 3, 2), (9, 9, 1), (5, 3, 2)} <= by


def test_no_python_in_the_plans(spark):
    plan = stream_dedup.report(table(spark, SF, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

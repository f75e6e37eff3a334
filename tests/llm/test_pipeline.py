"""Every pipeline stage, on all its predecessor kept, against a plain model of it."""

from __future__ import annotations

import duckdb
from tokenizers import Tokenizer

import corpus_pipeline
from cadence.llm import mixing, quality
from cadence.llm.common import materialize, table
from cadence.llm.tokens import default_tokenizer

from .test_jaccard_join import shingles
from .test_packing import check
from .test_stream_dedup import norm

SF = "/root/testdata/sf0.001"


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_plain_models(spark):
    docs = table(spark, SF, "documents")
    kept = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = materialize(stage(spark, at, SF), f"test-{name}")
        kept[name] = at
        if name != "pack_sequences":
            assert at.columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]

    # quality: the report's verdicts, and clean documents stay
    verdict = {r.doc_id: r.kept for r in quality.report(docs, table(spark, SF, "labels")).collect()}
    assert rows_of(kept["quality_rules"]) == rows_of(docs.filter(docs.doc_id.isin([i for i, k in verdict.items() if k])))
    good = {r.doc_id for r in table(spark, SF, "labels").filter("quality = 1").collect()}
    stay = {r.doc_id for r in kept["quality_rules"].collect()}
    long_enough = {r.doc_id for r in docs.collect() if len((r.text or "").split()) >= 20}
    assert len(good & stay) >= 0.97 * len(good & long_enough)

    # exact: the least identifier of each normalised text
    least: dict[str, int] = {}
    for r in kept["quality_rules"].collect():
        least[norm(r.text)] = min(r.doc_id, least.get(norm(r.text), r.doc_id))
    assert sorted(r.doc_id for r in kept["exact_dedup"].collect()) == sorted(least.values())

    # near: the least identifier of each component of links of 0.8 over five words
    rows = sorted((r.doc_id, shingles(r.text, 5)) for r in kept["exact_dedup"].collect())
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, s) in enumerate(rows):
        for j, t in rows[:x]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in kept["near_dedup"].collect()) == sorted({find(i) for i, _ in rows})

    # mixing: the SQL oracle over the stage's input
    con = duckdb.connect()
    frame = kept["near_dedup"].toPandas()  # noqa: F841  read by name
    con.execute("CREATE TABLE documents AS FROM frame")
    want = sorted(x[0] for x in con.execute(f"SELECT doc_id FROM ({mixing.ORACLE})").fetchall())
    assert sorted(r.doc_id for r in kept["mix_sources"].collect()) == want and want

    # packing: every id of every document taken, once
    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    expect: dict[int, list[list[int]]] = {}
    for r in kept["mix_sources"].collect():
        expect.setdefault(r.doc_id, []).append(t.encode(r.text or "", add_special_tokens=False).ids + [0])
    check(kept["pack_sequences"].collect(), expect, 1024)
    assert corpus_pipeline.run(spark, SF).count() == kept["pack_sequences"].count()


def test_stages_on_an_empty_table_and_odd_rows(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "", 0), (1, "a b " * 30, "xx", None, 3)], docs.schema)
    for start in (docs.limit(0), odd):
        at = materialize(start, "test-odd")
        for name, stage in corpus_pipeline.STAGES:
            at = materialize(stage(spark, at, SF), f"test-{name}")
        at.count()

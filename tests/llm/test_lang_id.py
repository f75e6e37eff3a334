"""Compression language identification: held-out accuracy, learning only from the rows it may, defined cases."""

from __future__ import annotations

import zlib

import xxhash
import zstandard

from cadence.llm import lang_id
from cadence.llm.common import table

SF = "/root/testdata/sf0.01"


def out(i) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy_and_columns(spark):
    docs = table(spark, SF, "documents")
    want = {r.doc_id: r.lang for r in docs.collect()}
    got = lang_id.report(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    unseen = [r.lang_pred == want[r.doc_id] for r in got if r.held_out and want[r.doc_id]]
    assert sum(unseen) >= 0.96 * len(unseen)
    sure = [r.lang_pred == want[r.doc_id] for r in got if r.held_out and want[r.doc_id] and not r.rejected]
    assert sum(sure) >= 0.98 * len(sure)


def test_held_out_rows_and_their_labels_teach_nothing(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(lang_id.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = lang_id.learn(docs), lang_id.learn(other)
    assert a == b and "xx" not in a
    assert [tuple(r) for r in lang_id.predict(docs, a).orderBy("doc_id").collect()] == [tuple(r) for r in lang_id.predict(other, a).orderBy("doc_id").collect()]


def test_defined_cases(spark):
    schema = "doc_id long, text string, lang string, held_out string, score string"
    rows = [(0, "the of and " * 40, "en", "", None), (1, "der die das " * 40, "de", "", None), (None, None, None, None, None), (3, "", "en", None, None),
            (5, "12 ... _ ²", "en", None, None), (5, "DER DIE DAS " * 900, None, None, None), (7, "漢字", None, None, None)]
    got = lang_id.report(spark.createDataFrame(rows, schema)).collect()
    by = sorted((r.doc_id is not None, r.doc_id or 0, r.lang_pred, r.score == 0) for r in got)
    assert by[0] == (False, 0, "und", True) and (True, 3, "und", True) in by and (True, 5, "und", True) in by
    assert (True, 5, "de", False) in by and len(got) == 7
    assert [r.lang_pred for r in got if r.doc_id == 7][0] in ("en", "de")
    empty = spark.createDataFrame([], schema)
    assert lang_id.report(empty).count() == 0
    assert {r.lang_pred for r in lang_id.predict(spark.createDataFrame(rows, schema), {}).collect()} == {"und"}


def plain(rows, docs_per_lang: int, doc_chars: int) -> dict[str, bytes]:
    """The dictionaries by their definition."""
    least: dict[tuple, str] = {}
    count: dict[str, int] = {}
    for i, text, lang in rows:
        if text is not None and lang is not None and not out(i):
            h = xxhash.xxh64_intdigest(str(i).encode() if i is not None else b"", seed=42) & ((1 << 63) - 1) if i is not None else 42
            least[lang, h] = min(text, least.get((lang, h), text), key=lambda s: s.encode())
            count[lang] = count.get(lang, 0) + 1
    got = {}
    for lang in sorted(count, key=lambda x: (-count[x], x)):
        best = sorted((h, t) for (g, h), t in least.items() if g == lang)[:docs_per_lang]
        at = [(h % max(len(t) - doc_chars + 1, 1), t) for h, t in best]
        got[lang] = b"\n".join(t[a : a + doc_chars].lower().encode() for a, t in at)
    return {k: v for k, v in got.items() if len(v) >= 8}


def compressed(body: bytes, raw: bytes) -> int:
    d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(lang_id.LEVEL, dict_size=len(body), write_content_size=False, write_dict_id=False), dict_data=d)
    return sum(len(c.compress(raw[i : i + lang_id.PIECE])) for i in range(0, len(raw), lang_id.PIECE))


def test_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    dictionaries = lang_id.learn(docs)
    assert dictionaries == plain(rows, lang_id.DOCS, lang_id.DOC_CHARS) and list(dictionaries) == list(plain(rows, lang_id.DOCS, lang_id.DOC_CHARS))
    got = {r.doc_id: r for r in lang_id.predict(docs, dictionaries).collect()}
    agree = 0
    for i, text, _ in rows[:300]:
        if not text or not lang_id.has_letter(text):
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        totals = [compressed(d, text.lower().encode()) for d in dictionaries.values()]
        best, second = sorted(totals)[:2]
        assert abs(got[i].margin - (second - best) / second) < 0.05
        agree += got[i].lang_pred == list(dictionaries)[totals.index(best)] or (second - best) / second < 0.02
    assert agree >= 297


def test_a_repeated_identifier_teaches_once_and_few_texts_move(spark):
    rows = [(7, f"copy {i % 5} of the same", "en") for i in range(900)] + [(i, f"text number {i} ☃ of the rest", "en") for i in range(8, 4000)]
    rows += [(i, f"der {i}. Text", "de") for i in range(5000, 5040)] + [(None, "kein Name", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for n, chars in ((30, 9), (400, 512)):
        assert lang_id.learn(docs, docs_per_lang=n, doc_chars=chars) == plain(rows, n, chars)
    some, _ = lang_id._teachers(docs, "doc_id", "text", "lang", 30)
    assert some.groupBy("lang").count().filter("count > 30").count() == 0

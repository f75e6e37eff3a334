"""Language identification by compression.

For each language a raw-content dictionary is put together from a bounded sample of labelled documents:
one piece of each, from a place in its whole text that a hash of its identifier gives. A
lower-cased text is compressed in pieces of ``PIECE`` bytes with every dictionary; the
language whose total is smallest is predicted. ``score`` grows with the margin
between the best and the second total, and a prediction with a margin below
``NARROW`` is marked as rejected. Pieces keep the dictionaries decisive in
texts of any length; the whole text counts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
equal totals go to the language with the most teaching documents; without any labelled
document every text is ``und``; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_slices, pick, ship_package

#: Documents that teach a language at most, and characters of the piece that each gives: a dictionary of about 112 KiB.
DOCS, DOC_CHARS = 224, 512
PIECE = 4096
LEVEL = 6
#: A best total that is not this share below the second one is rejected.
NARROW = 0.02
#: Margin at which the score is 0.5.
HALF = 0.03


def held_out(id_col: Column) -> Column:
    """Documents that teach nothing: crc32 of the identifier as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "utf-8")), F.lit(4)) == 2, F.lit(False))


def _teachers(docs: DataFrame, id_col: str, text_col: str, lang_col: str, n: int) -> tuple[DataFrame, list]:
    """``lang, h, t``: per language the texts with the ``n`` smallest identifier hashes (the least text of an identifier); and its rows by language."""
    lang, text = pick(docs, lang_col).cast("string"), pick(docs, text_col).cast("string")
    rows = docs.filter(lang.isNotNull() & text.isNotNull() & ~held_out(pick(docs, id_col))).select(
        lang.alias("lang"), F.xxhash64(pick(docs, id_col).cast("string")).bitwiseAND(F.lit((1 << 63) - 1)).alias("h"), text.alias("t")
    )
    # leading zeros of the hash: about 2**-z of a language's identifiers have z or more, however often each is repeated
    rows = rows.withColumn("z", F.lit(63) - F.length(F.bin("h")))
    levels = rows.groupBy("lang", "z").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("h").alias("ids")).collect()  # 63 rows a language at most
    least: dict[str, int] = {}
    for r in sorted(levels, key=lambda r: -r.z):
        if sum(x.ids for x in levels if x.lang == r.lang and x.z > r.z) < 2 * n:  # 2: the counts are near, not exact
            least[r.lang] = r.z
    limits = docs.sparkSession.createDataFrame(list(least.items()), "lang string, z0 int")  # one row a language
    some = rows.join(F.broadcast(limits), "lang").filter("z >= z0").groupBy("lang", "h").agg(F.min("t").alias("t"))
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= n).drop("k")
    return some, levels


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS, doc_chars: int = DOC_CHARS) -> dict[str, bytes]:
    """Dictionary of each language, from at most ``docs_per_lang`` documents of it (a bounded sample) and ``doc_chars`` characters of each.

    Of the documents of a language that are not held out, those with the
    smallest hashes of the identifier teach, one row of an identifier. A piece starts where the hash says, anywhere in the
    whole text, and a text of fewer characters is a piece. Which hashes are small enough is known from counts before texts
    move, so no task gets more than a few times ``docs_per_lang`` texts of a language. Languages come by falling number of teaching rows.
    """
    some, levels = _teachers(docs, id_col, text_col, lang_col, docs_per_lang)
    places = F.greatest(F.char_length("t") - doc_chars + 1, F.lit(1))
    piece = F.substring(F.col("t"), (F.col("h") % places + 1).cast("int"), F.lit(doc_chars))
    pieces: dict[str, list[bytes]] = {}
    for r in some.select("lang", "h", piece.alias("t")).orderBy("lang", "h").collect():
        pieces.setdefault(r.lang, []).append(r.t.lower().encode())
    count = {name: sum(x["rows"] for x in levels if x.lang == name) for name in pieces}
    out = {name: b"\n".join(pieces[name]) for name in sorted(pieces, key=lambda name: (-count[name], name))}
    return {name: body for name, body in out.items() if len(body) >= 8}


class Judge:
    """Compressors of all languages."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.by = []
        for name in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def totals(self, raw: bytes) -> list[int]:
        parts = [raw] if len(raw) <= PIECE else [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.by]

    def __call__(self, raw: bytes) -> tuple[str, float, float]:
        """Language, score, margin."""
        text = raw.decode("utf-8", "replace")
        if not self.by or not has_letter(text):
            return "und", 0.0, 0.0
        got = self.totals(text.lower().encode())
        if len(got) == 1:
            return self.langs[0], 0.5, 0.0
        order = sorted(range(len(got)), key=got.__getitem__)
        best, second = got[order[0]], got[order[1]]
        margin = (second - best) / second
        return self.langs[order[0]], margin / (margin + HALF), margin


_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Does a text hold a letter of any script."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def predict(docs: DataFrame, dictionaries: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, margin, rejected`` of every document."""
    ship_package(docs.sparkSession)
    rows = docs.select(pick(docs, id_col).alias("doc_id"), held_out(pick(docs, id_col)).alias("held_out"), pick(docs, text_col).cast("string").alias("t"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = Judge(dictionaries)
        for part, t in doc_slices(batches, "t"):
            lang, score, margin = zip(*(j(t.raw(i)) for i in range(len(t))), strict=True)
            margin = np.array(margin)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["held_out"], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin), pa.array(margin < NARROW)],
                names=["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"],
            )

    schema = rows.drop("t").schema.add("lang_pred", "string").add("score", "double").add("margin", "double").add("rejected", "boolean")
    return rows.mapInArrow(judge, schema)


def report(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs))

"""Quality rules: fixed base rules, then boosted trees over document statistics.

Statistics of whole texts come from vectorised passes over Arrow batches. The
base rules fail texts of under 20 words or with over 30 % of words in repeated
8-word windows. Rows with a quality label teach monotone boosted trees; the
sample is bounded (``sample``: the labelled rows with the smallest hash of the
identifier; of an identifier's several rows the one with the smallest features
teaches, so one identifier counts once). A document is kept when it passes the base rules and scores 0.5 or more.

Defined cases: a null text has no words and fails the base rules; unlabelled
or contradictory labels (the smaller counts) are no error; without labels, or
with one class only, the base rules alone decide; an empty table gives an empty
result; other columns are passed through by ``kept_documents`` and ignored by ``report``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .bytes_np import RangeHash, Words, mix, per_doc_sum, repeats, window_hash
from .common import Text, doc_slices, pick, ship_package
from .gbt import Trees, train

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of the trees with their constraint on the score (-1: more is never better, 0: free).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_lines": -1, "repeat_words": -1, "adjacent_same": -1,
    "upper_bytes": -1, "bangs_per_word": -1, "bars_per_word": -1, "digit_bytes": 0, "distinct_words": 0, "stop_marks": 0,
}
#: Labelled rows that teach the trees, at most.
SAMPLE = 20_000


def statistics(t: Text) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of each text of a slice, as the columns COUNTS and FEATURES say."""
    data, off, n = t.data, t.offsets, len(t)
    w = Words(t)
    hashed = RangeHash(data)
    word = hashed(w.start, w.end)
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))  # equal content of two documents is no repeat

    lead = (data & 0xC0) != 0x80
    bytes_of = lambda mask: per_doc_sum(mask, off)
    word_chars = bytes_of(w.inside & lead)
    symbols = bytes_of(SYMBOLS[data])

    # lines with a word that equal an earlier line of their text
    brk = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([off[:-1], brk + 1]))
    doc = np.searchsorted(off, start, side="right") - 1
    # a break that ends a text opens an empty line at the next text's start; it has no word, or is that text's first line
    end = np.minimum(np.append(start[1:], len(data)), off[np.minimum(doc + 1, n)])
    stop = np.where((end > start) & (end <= len(data)) & (data[np.maximum(end - 1, 0)] == 10) if len(data) else False, end - 1, end)
    has = np.searchsorted(w.start, stop) > np.searchsorted(w.start, start)
    start, stop, doc = start[has], stop[has], doc[has]
    lines = np.bincount(doc, minlength=n)
    _, later = repeats(hashed(start, stop) ^ salt[doc])
    dup_lines = np.bincount(doc[later], minlength=n)

    # words inside an 8-word window that occurs twice or more
    many = np.zeros(0, bool)
    win = window_hash(word, WINDOW)
    own = w.doc[: len(win)] == w.doc[WINDOW - 1 :] if len(win) else np.zeros(0, bool)
    at = np.flatnonzero(own)
    many, _ = repeats(win[at] ^ salt[w.doc[at]])
    cover = np.zeros(len(word) + 1, np.int64)
    np.add.at(cover, at[many], 1)
    np.add.at(cover, at[many] + WINDOW, -1)
    repeat_words = per_doc_sum(np.cumsum(cover)[:-1] > 0, w.at)

    _, seen = repeats(word ^ salt[w.doc])
    same = np.zeros(len(word), bool)
    if len(word):
        same[1:] = (word[1:] == word[:-1]) & (w.doc[1:] == w.doc[:-1])
    words = w.per_doc
    per_word, size = np.maximum(words, 1), np.maximum(np.diff(off), 1)
    counts = np.stack([words, word_chars, symbols, dup_lines, repeat_words], axis=1).astype(np.int64)
    features = np.stack([
        np.log1p(words), word_chars / per_word, symbols / per_word, dup_lines / np.maximum(lines, 1), repeat_words / per_word,
        per_doc_sum(same, w.at) / per_word, bytes_of((data >= 65) & (data <= 90)) / size, bytes_of(data == 33) / per_word,
        bytes_of(data == 124) / per_word, bytes_of((data >= 48) & (data <= 57)) / size,
        1 - per_doc_sum(seen, w.at) / per_word, bytes_of((data == 46) | (data == 44)) / per_word,
    ], axis=1)
    return counts, features


def base_failed(counts: np.ndarray) -> np.ndarray:
    words, repeat_words = counts[:, 0], counts[:, 4]
    return (words < 20) | (100 * repeat_words > 30 * words)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` labelled rows."""
    ship_package(docs.sparkSession)
    taught = (
        labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("__y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # at most `sample` pairs of numbers: a broadcast of bounded size
    rows = docs.select(pick(docs, id_col).alias("doc_id"), pick(docs, text_col).cast("string").alias("__t")).join(F.broadcast(taught), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in doc_slices(batches, "__t"):
            x = statistics(t)[1]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("__y").cast(pa.int32()), *(pa.array(x[:, k]) for k in range(x.shape[1]))],
                names=["doc_id", "y", *FEATURES],
            )

    schema = "doc_id long, y int, " + ", ".join(f"{f} double" for f in FEATURES)
    # one row of each identifier, chosen before the rows leave the executors: at most `sample` reach the driver
    one = rows.mapInArrow(measure, schema).groupBy("doc_id").agg(F.min(F.struct("y", *FEATURES)).alias("r"))
    got = one.select("doc_id", "r.*").toPandas().sort_values("doc_id", kind="stable")
    return train(got[list(FEATURES)].to_numpy(float), (got["y"] > 0).to_numpy(float), list(FEATURES.values()))


def measured(docs: DataFrame, trees: Trees, *, text_col: str = "text", keep: list[str] | None = None, only_kept: bool = False) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all), then the counts, ``base_failed``, ``score`` and ``kept``; ``only_kept``: of the kept rows."""
    ship_package(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    kept_cols = [pick(docs, c).alias(f"__c{i}") for i, c in enumerate(keep)]
    # a text that is kept as it is goes to the workers once
    own = text_col in keep and isinstance(docs.schema[text_col].dataType, StringType)
    of = f"__c{keep.index(text_col)}" if own else "__t"
    rows = docs.select(*kept_cols, *([] if own else [pick(docs, text_col).cast("string").alias("__t")]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in doc_slices(batches, of):
            counts, x = statistics(t)
            failed = base_failed(counts)
            score = trees.score(x)
            kept = ~failed & ((score >= 0.5) | (len(trees.root) == 0))
            out = pa.RecordBatch.from_arrays(
                [*part.columns[: len(keep)], *(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.array(failed), pa.array(score), pa.array(kept)],
                names=schema.names,
            )
            yield out.filter(out.column(len(schema.names) - 1)) if only_kept else out

    schema = rows.drop("__t").schema
    for c in COUNTS:
        schema = schema.add(f"__{c}", "long")
    for c, kind in (("base_failed", "boolean"), ("score", "double"), ("kept", "boolean")):
        schema = schema.add(f"__{c}", kind)
    return rows.mapInArrow(judge, schema)


def report(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``score`` of every document."""
    got = measured(docs, fit(docs, labels, sample=sample), keep=["doc_id"])
    return got.select(F.col("__c0").alias("doc_id"), *(F.col(f"__{c}").alias(c) for c in (*COUNTS, "base_failed", "kept", "score")))


def kept_documents(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    got = measured(docs, fit(docs, labels, sample=sample), only_kept=True)  # rejected texts do not come back from the workers
    return got.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))

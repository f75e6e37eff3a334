"""Token-id files: documents in ascending identifier order, as segments of adaptively coded blocks.

A data set is a folder of Parquet files, so any Hadoop file system holds it and
a lost task is simply run again. A row is one segment: ``part`` and ``seg`` give
its place, ``doc_ids`` and ``n_tokens`` its documents in order, ``payload`` the
coded ids (see ``id_codec``). Parts rise with the identifier.

Defined cases: a null text is an empty one (its end id only); null identifiers
come first; rows with equal identifiers are separate documents, ordered by text;
an empty table gives an empty data set; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import id_codec
from .common import doc_slices, pick, ship_package
from .tokens import default_tokenizer, encoder

#: Ids of a segment, about; it holds whole documents.
SEGMENT = id_codec.BLOCK * id_codec.LANES
SCHEMA = "part long, seg long, doc_ids array<long>, n_tokens array<long>, payload binary"


def write_ids(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, segment: int = SEGMENT) -> None:
    """Tokenise every whole text, append ``end_id``, and write the data set."""
    ship_package(docs.sparkSession)
    tok = tokenizer or default_tokenizer()
    rows = docs.select(pick(docs, id_col).cast("long").alias("id"), pick(docs, text_col).cast("string").alias("t"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, end = TaskContext.get().partitionId(), encoder(tok), np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        size = seg = 0

        def out() -> pa.RecordBatch:
            payload = id_codec.encode(np.frombuffer(b"".join(ids), "<u4"))
            cols = [[part], [seg], [doc_ids], [[len(x) // 4 for x in ids]], [payload]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "seg", "doc_ids", "n_tokens", "payload"])

        for batch, _ in doc_slices(batches, "t"):
            coded = enc.encode([x or "" for x in batch["t"].to_pylist()])
            for i, x in zip(batch["id"].to_pylist(), coded, strict=True):
                if ids and size + len(x) // 4 + 1 > segment:
                    yield out()
                    ids, doc_ids, size, seg = [], [], 0, seg + 1
                ids.append(x + end)
                doc_ids.append(i)
                size += len(ids[-1]) // 4
        if ids:
            yield out()

    by = [F.col("id"), F.xxhash64("t"), F.col("t")]
    rows.repartitionByRange(*by[:2]).sortWithinPartitions(*by).mapInArrow(code, SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files; ``with_ids`` adds the ids (little-endian unsigned 32-bit)."""
    ship_package(spark)
    segments = spark.read.schema(SCHEMA).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                raw = memoryview(id_codec.decode(row["payload"]).tobytes())
                n = np.array(row["n_tokens"], np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                cut = [raw[4 * x : 4 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                cols = [
                    pa.array(np.full(len(n), row["part"])), pa.array(np.full(len(n), row["seg"])), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(at[:-1]), pa.array(n), pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                ]
                names = ["part", "seg", "doc_id", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([bytes(x) for x in cut], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    docs = segments.select("part", "seg", "doc_ids", "n_tokens", "payload").mapInArrow(
        decode, "part long, seg long, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    )
    # ids before each segment: sums of parts (as many as tasks), then of a part's own segments
    sizes = segments.select("part", "seg", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_at"))
    in_part = F.sum("n").over(Window.partitionBy("part").orderBy("seg")) - F.col("n")
    offsets = sizes.withColumn("seg_at", in_part).join(parts, "part").select("part", "seg", (F.col("seg_at") + F.col("part_at")).alias("before"))
    out = docs.join(offsets, ["part", "seg"])
    return out.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)

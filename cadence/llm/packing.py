"""Sequence packing along a space-filling curve.

A document's vector is the mean of its words' hashed random signs in a few
dimensions, so documents that share words lie close. Each coordinate is squashed to a
grid and the cell's Hilbert index is the document's sort key. Rows are
range-partitioned by (key, identifier), which also splits groups of equal keys,
sorted, tokenised, and laid end to end: a sequence is the next 1024 ids of the
partition's stream, so neighbours on the curve share sequences. What is left at
a partition's end is cut at powers of two, which need no padding.

Defined cases: a null text is an empty one (its end id only); rows with equal
or null identifiers are separate documents; an empty table gives no pieces;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import RangeHash, Words, per_doc_sum
from .common import Text, doc_slices, give_back, pick, ship_package
from .tokens import KEEP, default_tokenizer, encoder

DIMS, BITS = 3, 10
#: Coordinates are means over words; this many times a mean is one unit of the squashed scale.
SPREAD = 3.0
#: Parts that a worker keeps, and text bytes that it takes at once, where memory is short: a tenth of the usual table.
_KEEP_FEW, _SLICE = 100_000, 1 << 19


def coordinates(t: Text) -> np.ndarray:
    """Grid cell (0 .. 2**BITS - 1 in each of DIMS dimensions) of each text."""
    w = Words(t)
    word = RangeHash(t.data)(w.start, w.end)
    mean = np.stack([
        per_doc_sum(((word >> np.uint64(20 + d)) & np.uint64(1)).astype(np.int8) * 2 - 1, w.at) / np.maximum(w.per_doc, 1)
        for d in range(DIMS)
    ], axis=1)
    return np.minimum(((np.tanh(SPREAD * mean) + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each row of ``cells``; neighbours on the curve are neighbouring cells."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the rotations and reflections of each level of the curve
        low = bit - 1
        for d in range(dims):
            on = (x[d] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[d] ^= np.where(on, 0, swap) if d else 0
        bit >>= 1
    for d in range(1, dims):  # Gray code across the dimensions
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[dims - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def lay(starts: np.ndarray, total: int, at: int, size: int) -> np.ndarray:
    """Piece starts in a stream at place ``at``: where documents start and where sequences end."""
    marks = np.arange(-at % size, total, size)
    return np.union1d(starts, marks).astype(np.int64)


def pack(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, tokenizer: str | None = None,
    end_id: int = 0, with_ids: bool = False, partitions: int | None = None, release: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``with_ids`` adds the ids themselves (``ids``, little-endian unsigned 32-bit). ``release``: workers keep a small table of
    the tokenizer's parts and give it back at a task's end, for other stages beside it; parts are learnt anew more often.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path = tokenizer or default_tokenizer()
    rows = docs.select(pick(docs, id_col).cast("long").alias("id"), pick(docs, text_col).cast("string").alias("t"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in doc_slices(batches, "t", 1 << 19):  # arrays of a pass that stay near a core
            yield pa.RecordBatch.from_arrays([part["id"], part["t"], pa.array(hilbert(coordinates(t)))], names=["id", "t", "key"])
        if release:
            give_back()

    def cut_and_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from cut(batches)
        finally:
            encoder(path).forget()
            give_back()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        enc = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        at, held = 0, []  # pieces of the open sequence wait, as it may turn out to be the last

        def out(p: dict) -> pa.RecordBatch:
            cols = [pa.array(p["doc"], pa.int64())] + [pa.array(np.asarray(p[k], np.int64)) for k in ("start", "length", "crc", "tokens", "seq", "offset")]
            return pa.RecordBatch.from_arrays(cols + [pa.array(p["ids"], pa.binary())] * with_ids, names=names)

        for part, _ in doc_slices(batches, "t", _SLICE) if release else doc_slices(batches, "t"):
            ids = [x + end for x in enc.encode([x or "" for x in part["t"].to_pylist()], _KEEP_FEW if release else KEEP)]
            flat = b"".join(ids)
            length = np.array([len(x) // 4 for x in ids])
            starts = np.concatenate([[0], np.cumsum(length)])
            total = int(starts[-1])
            begin = lay(starts[:-1], total, at, size)
            stop = np.append(begin[1:], total)
            doc = np.searchsorted(starts, begin, side="right") - 1
            doc_ids = part["id"].to_pylist()
            view = memoryview(flat)
            pieces = {
                "doc": [doc_ids[d] for d in doc.tolist()], "start": begin - starts[doc], "length": stop - begin,
                "crc": [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)],
                "tokens": length[doc], "seq": first + (at + begin) // size, "offset": (at + begin) % size,
                "ids": [bytes(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)] if with_ids else [],
            }
            at += total
            open_from = int(np.searchsorted(pieces["seq"], first + at // size)) if at % size else len(begin)
            if open_from and held:
                yield out(_joined(held))
                held = []
            if open_from:
                yield out({k: v[:open_from] for k, v in pieces.items()})
            if open_from < len(begin):
                bytes_of = [bytes(view[4 * a : 4 * b]) for a, b in zip(begin[open_from:].tolist(), stop[open_from:].tolist(), strict=True)]
                held.append({k: v[open_from:] for k, v in pieces.items()} | {"raw": bytes_of})
        if held:
            yield out(_tail(_joined(held), first + (at // size)))

    keyed = rows.mapInArrow(place, "id long, t string, key long")
    by = [F.col("key"), F.col("id"), F.xxhash64("t")]
    ranged = keyed.repartitionByRange(partitions, *by) if partitions else keyed.repartitionByRange(*by)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return ranged.sortWithinPartitions(*by).drop("key").mapInArrow(cut_and_release if release else cut, schema)


def _joined(parts: list[dict]) -> dict:
    return {k: [x for p in parts for x in p[k]] for k in parts[0] if k in parts[-1]}


def _tail(p: dict, seq: int) -> dict:
    """The pieces of a partition's last, unfilled sequence, dealt to sequences of power-of-two lengths."""
    left, need = sum(int(x) for x in p["length"]), []
    while left:
        need.append(1 << (left.bit_length() - 1))
        left -= need[-1]
    out: dict = {k: [] for k in ("doc", "start", "length", "crc", "tokens", "seq", "offset", "ids")}
    place = 0
    for i, raw in enumerate(p["raw"]):
        done, n = 0, int(p["length"][i])
        while done < n:
            take = min(n - done, need[0] - place)
            some = raw[4 * done : 4 * (done + take)]
            row = (p["doc"][i], int(p["start"][i]) + done, take, zlib.crc32(some), int(p["tokens"][i]), seq, place, some)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
            done, place = done + take, place + take
            if place == need[0]:
                need.pop(0)
                seq, place = seq + 1, 0
    return out

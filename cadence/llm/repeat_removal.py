"""Removal of repeated byte strings, with suffix arrays over shards.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere
goes. Work is split so that equal strings meet in one shard:

1. Each window (start of a ``LENGTH``-byte string) has an *anchor*: of its
   ``GRAM``-byte substrings the one with the least hash, the leftmost of equals. Runs of windows with one
   anchor form a region: the bytes that the run covers. Equal windows have equal anchors.
2. Anchors seen once need nothing more. Of regions under the other anchors each
   different text goes on, from two of its places if it has several.
3. A shard holds the regions of some anchors, end to end. Its suffix array is sorted by
   induction (``suffix_sort``), permuted common prefixes follow, and a window is repeated if its
   suffix shares ``LENGTH`` bytes with a neighbour.
4. An anchor with more than ``HOT`` different regions (the edge of a passage that very many documents
   share) is split: its windows meet one by one under the anchor and their own hash, and those with several places go on as
   regions of one window, dealt to shards by that hash.
5. Repeated windows meet their documents again, and the bytes they cover go.

Hashes (64-bit, of a gram, and of a region or window) only decide what meets, the suffix array decides what repeats. Places
of equal hashes take the verdict of two of them; two different regions under one anchor agree with chance 2**-64.

Defined cases: a null text is empty; texts under ``LENGTH`` bytes keep
everything; rows with equal or null identifiers are separate documents; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import RangeHash, mix
from .common import Text, doc_slices, materialize, pick, ship_package
from .stream_dedup import file_backed, located
from .suffix_sort import permuted_lcp, suffix_array

LENGTH, GRAM = 200, 48
#: Different regions of an anchor that one shard sorts; anchors with more are split.
HOT = 4096
#: Region bytes of one suffix array, about; its arrays should stay in a core's cache.
SHARD_BYTES = 256 << 10
#: Text bytes whose anchors are found at once, likewise (a longer text is taken whole).
ANCHOR_BYTES = 64 << 10
#: Rows (of 16 to 32 bytes) that may be broadcast; more go through a shuffled join.
_BROADCAST_ROWS = 50_000


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost least of each ``w`` consecutive values (by their upper 32 bits, in slices of any size)."""
    n = len(h)
    low = np.uint64((1 << 32) - 1)  # a slice has fewer places: texts of a batch stay below 2 GB
    key = (h & ~low) | np.arange(n, dtype=np.uint64)
    pad = -n % w
    grid = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(back[: n - w + 1], ahead[w - 1 : n])
    return (best & low).astype(np.int64)


def anchored_runs(t: Text, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: ``doc``, first window ``s`` (in the document), ``m`` more windows, ``key``, ``body`` hash."""
    data, off = t.data, t.offsets
    n = len(data)
    none = {k: np.zeros(0, np.int64) for k in ("doc", "s", "m", "key", "body")}
    if n < length:
        return none
    hashed = RangeHash(data)
    at = np.arange(n - gram + 1)
    grams = hashed(at, at + gram)
    anchor = _least(grams, length - gram + 1)  # of the window at each place, also across texts
    size = np.diff(off)
    doc = np.repeat(np.arange(len(t)), np.maximum(size - length + 1, 0))
    if not len(doc):
        return none
    count = np.maximum(size - length + 1, 0)
    first = np.cumsum(count) - count
    start = np.arange(len(doc)) - np.repeat(first, count) + np.repeat(off[:-1], count)  # windows inside one text
    a = anchor[start]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(new[1:], len(a)) - 1
    s, e = start[new], start[last]
    # the least gram by upper bits is one of equals; the gram's own hash is what equal windows share
    return {
        "doc": doc[new], "s": s - off[doc[new]], "m": e - s, "key": grams[a[new]].view(np.int64),
        "body": (hashed(s, e + length) ^ mix((e - s).astype(np.uint64))).view(np.int64),
    }


def _anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in doc_slices(batches, "t", ANCHOR_BYTES):
            r = anchored_runs(t, length, gram)
            loc = part["loc"].to_numpy()[r["doc"]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (loc, r["s"].astype(np.int32), r["m"].astype(np.int32), r["key"], r["body"])], names=["loc", "s", "m", "key", "body"])

    return rows.mapInArrow(run, "loc long, s int, m int, key long, body long")


def _small(df: DataFrame, n: int | None = None) -> DataFrame:
    """``df`` marked for broadcast when its checked number of rows is small, else as it is."""
    return F.broadcast(df) if (df.count() if n is None else n) <= _BROADCAST_ROWS else df


def _with_texts(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Rows with the list ``at`` of their ``places`` (columns ``loc`` and others); as long as a document's own runs."""
    others = [c for c in places.columns if c != "loc"]
    listed = materialize(places.groupBy("loc").agg(F.collect_list(F.struct(*others)).alias("at")), "repeat-places")
    return rows.join(_small(listed, places.count()), "loc")


def _region_texts(rows: DataFrame, regions: DataFrame, length: int) -> DataFrame:
    """``shard, key, body, again, raw`` of each region, from one of its places, and from another one (``again``) if it has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in doc_slices(batches, "t"):
            out: list[tuple] = []
            for i, at in enumerate(part["at"].to_pylist()):
                raw = t.raw(i)
                out += [(x["shard"], x["key"], x["body"], x["again"], raw[x["s"] : x["s"] + x["m"] + length]) for x in at]
            cols = zip(*out, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "key", "body", "again", "raw"])

    first = regions.select("rep.loc", "rep.s", "rep.m", "shard", "key", "body", F.lit(False).alias("again"))
    second = regions.filter("n > 1").select("other.loc", "other.s", "other.m", "shard", "key", "body", F.lit(True).alias("again"))
    got = _with_texts(rows, first.unionByName(second))
    return got.select("t", "at").mapInArrow(run, "shard long, key long, body long, again boolean, raw binary")


def repeated_runs(raws: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(region, a, b)``: runs of repeated windows of each region, by the suffix array of all regions; fast where equal regions are neighbours."""
    sizes = np.array([len(r) for r in raws])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    t = np.frombuffer(b"".join(r + b"\0" for r in raws) + b"\0", np.uint8).astype(np.int16) + np.int16(2)
    t[begin + sizes] = 1  # between regions
    t[-1] = 0
    sa = suffix_array(t, 258)
    left = np.repeat(begin + sizes, sizes + 1) - np.arange(len(t) - 1)  # bytes to the region's end
    left = np.append(left, 0)
    plcp, phi = permuted_lcp(t, sa, len(t), length)  # no bound: regions that come again in the same order share long prefixes
    hit = (np.minimum(np.minimum(plcp, left), left[phi]) >= length) & (phi >= 0)
    again = np.zeros(len(t), bool)
    again[hit] = True
    again[phi[hit]] = True
    # a hit has ``length`` bytes to its region's end, so runs of different regions do not touch
    edge = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))
    a, b = edge[::2], edge[1::2] - 1
    region = np.searchsorted(begin, a, side="right") - 1
    return region, a - begin[region], b - begin[region]


def _sorted_shards(texts: DataFrame, length: int) -> DataFrame:
    """``key, body, a, b``: runs of repeated windows of each region (a to b, in the region)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple]) -> pa.RecordBatch:
            region, a, b = repeated_runs([h[4] for h in held], length)
            key, body, second = (np.array([h[c] for h in held])[region] for c in (1, 2, 3))
            first = ~second.astype(bool)  # its region's other place tells the same
            cols = (key[first].astype(np.int64), body[first].astype(np.int64), a[first].astype(np.int32), b[first].astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "body", "a", "b"])

        held: list[tuple] = []
        size, last = 0, None
        for b in batches:  # a suffix array takes whole shards
            for row in zip(*(b[c].to_pylist() for c in ("shard", "key", "body", "again", "raw")), strict=True):
                if size >= SHARD_BYTES and row[0] != last:
                    yield out(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held:
            yield out(held)

    # equal regions side by side: a common prefix then ends within three regions
    return texts.repartition("shard").sortWithinPartitions("shard", "key", "body").mapInArrow(run, "key long, body long, a int, b int")


def _single_windows(rows: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """``loc, s, m, key, body`` of every window of the given runs by itself (m is 0); body is the window's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in doc_slices(batches, "t"):
            hashed = RangeHash(t.data)
            loc = part["loc"].to_numpy()
            for i, at in enumerate(part["at"].to_pylist()):
                s = np.concatenate([np.arange(x["s"], x["s"] + x["m"] + 1) for x in at])
                key = np.repeat(np.array([x["key"] for x in at], np.int64), [x["m"] + 1 for x in at])
                h = hashed(s + t.offsets[i], s + t.offsets[i] + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(s), loc[i])), pa.array(s.astype(np.int32)), pa.array(np.zeros(len(s), np.int32)), pa.array(key), pa.array(h.view(np.int64))],
                    names=["loc", "s", "m", "key", "body"],
                )

    return _with_texts(rows, runs).select("loc", "t", "at").mapInArrow(run, "loc long, s int, m int, key long, body long")


def _regions(runs: DataFrame, shard: str) -> DataFrame:
    """Different regions: ``key, body, n`` places, two of them, and the column whose values are dealt to shards."""
    place = F.struct("loc", "s", "m")
    found = runs.groupBy("key", "body").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("rep"), F.max(place).alias("other"))
    return found.withColumn("shard", F.col(shard))


def covers(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``loc, a, b``: byte ranges to remove (overlapping ones too) from ``rows (loc, t)``."""
    runs = materialize(_anchors(rows, length, gram), "repeat-runs")
    # anchors with two places or more; the count of a hot one arrives as one row a task
    many = materialize(runs.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "repeat-anchors")
    shared = materialize(runs.join(_small(many), "key"), "repeat-shared")
    regions = materialize(_regions(shared, "key"), "repeat-regions")
    hot = materialize(regions.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT).select("key"), "repeat-hot")
    if not hot.isEmpty():  # both ways give the same windows; only the split differs
        single = materialize(_single_windows(rows, shared.join(_small(hot), "key").select("loc", "s", "m", "key"), length), "repeat-windows")
        again = _regions(single, "body").filter("n > 1")
        regions = materialize(regions.join(_small(hot), "key", "left_anti").unionByName(again), "repeat-regions")
        shared = shared.join(_small(hot), "key", "left_anti").select(single.columns).unionByName(single)
    found = materialize(_sorted_shards(_region_texts(rows, regions, length), length), "repeat-found")
    return shared.join(_small(found), ["key", "body"]).select("loc", (F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b") + length).alias("b"))


def _cut(raw: bytes, at: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and what is left."""
    keep, removed, spans, last = [], 0, 0, 0
    for a, b in sorted(at):
        if a > last or (spans == 0):
            keep.append(raw[last:a])
            spans += 1
            removed += b - a
            last = b
        elif b > last:
            removed += b - last
            last = b
    keep.append(raw[last:])
    return removed, spans, b"".join(keep)


def removed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_kept: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row; ``with_kept`` adds the remaining bytes."""
    ship_package(docs.sparkSession)
    src = located(file_backed(docs))
    rows = src.select(F.xxhash64("__file", "__row").alias("loc"), F.coalesce(pick(src, text_col).cast("string"), F.lit("")).alias("t"), pick(src, id_col).alias("doc_id"))
    ranges = materialize(covers(rows.select("loc", "t"), length, gram), "repeat-covers")
    listed = materialize(ranges.groupBy("loc").agg(F.collect_list(F.struct("a", "b")).alias("at")), "repeat-lists")
    few = _small(listed, ranges.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in doc_slices(batches, "t"):
            got = []
            for i, at in enumerate(part["at"].to_pylist()):
                raw = t.raw(i)
                gone, spans, left = _cut(raw, [(x["a"], x["b"]) for x in at])
                got.append((len(raw), gone, spans, hashlib.sha256(left).hexdigest(), left))
            cols = [pa.array(c, k) for c, k in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *cols][: 5 + with_kept], names=names[: 5 + with_kept])

    schema = rows.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if with_kept:
        schema = schema.add("kept", "binary")
    touched = rows.join(few, "loc").select("doc_id", "t", "at").mapInArrow(run, schema)
    raw = F.encode("t", "utf-8")
    whole = rows.join(few, "loc", "left_anti").select(
        "doc_id", F.octet_length("t").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(raw, 256).alias("kept_sha256"), *[raw.alias("kept")] * with_kept,
    )
    return touched.unionByName(whole)

"""SimHash near-duplicates: fingerprints, blocks that close pairs must share, verified Hamming distances, components.

1. A text's words (A-Z lower-cased) give its k-word shingles, repeats included, joined by single spaces; a
   text of fewer words is one shingle. A shingle's hash is XXH64 (UTF-8, seed 42). A fingerprint bit
   is 1 if it is set in over half of the hashes.
2. Equal fingerprints count once from here on.
3. Pigeonhole: a fingerprint is cut into ``m`` blocks of bits. Two that differ in at most ``distance`` bits agree in
   ``m - distance`` blocks at least, so they share the value of one such choice of blocks: a bucket. More
   blocks give longer keys and more copies; ``m`` follows from the number of fingerprints and changes the work only.
4. In a bucket every pair that is not yet in one group is compared by the count of differing bits: a group grows from one
   fingerprint, against those that no group has taken. A group of g members gives g - 1 links, never all pairs. A
   bucket of more than ``BLOCK`` fingerprints is dealt in pairs of parts, each a task's work.
5. Components of the links.

Nothing is capped or left out.

Defined cases: null and empty texts and texts without words have fingerprint 0, which links like
any other; repeated and null identifiers are separate rows (a component's id is its least known
identifier, null if it has none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import LOWER, Words
from .common import Text, doc_slices, few, materialize, pick, ship_package
from .components import components

SEED = 42
#: Fingerprints of one bucket that one task compares; larger buckets are dealt in pairs of parts.
BLOCK = 8192
#: Cells of one comparison table.
_CELLS = 1 << 20

#: For every byte, its bits in the eight bytes of a word (most significant bit first).
_SPREAD = np.array([int.from_bytes(bytes((b >> (7 - i)) & 1 for i in range(8)), "little") for b in range(256)], np.uint64)


def _single_spaced(t: Text, w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Lower-cased words of a slice, one space after each, with each word's start and end."""
    size = w.end - w.start
    start = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    shift = np.repeat(start - w.start, size)
    source = np.flatnonzero(w.inside)
    out[source + shift] = LOWER[t.data[source]]
    return out.tobytes(), start, start + size


def bit_majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes between ``bounds``: bits set in over half of a run."""
    n = np.diff(bounds)
    # runs in pieces of at most 255, so that a byte holds every count
    pieces = -(-n // 255)
    owner = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = bounds[:-1][owner] + 255 * nth
    ones = np.zeros((len(n), 64), np.int64)
    if len(begin):
        raw = h.astype(">u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            sums = np.add.reduceat(_SPREAD[raw[:, byte]], begin).view(np.uint8).reshape(-1, 8)
            np.add.at(ones[:, 8 * byte : 8 * byte + 8], owner, sums)
    return np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(t: Text, k: int) -> np.ndarray:
    """Fingerprint of each text of a slice."""
    w = Words(t)
    data, start, end = _single_spaced(t, w)
    per = w.per_doc
    shingles = np.where(per >= k, per - k + 1, np.minimum(per, 1))
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    doc = np.repeat(np.arange(len(t)), shingles)
    first = w.at[:-1][doc] + np.arange(len(doc)) - bounds[:-1][doc]
    last = first + np.minimum(per, k)[doc] - 1
    digest = xxhash.xxh64_intdigest
    h = [digest(data[a:b], SEED) for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True)]
    return bit_majority(np.array(h, np.uint64), bounds)


def fingerprinted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """``doc_id, fp`` (a signed long) of every row."""
    ship_package(docs.sparkSession)
    rows = docs.select(pick(docs, id_col).alias("doc_id"), pick(docs, text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in doc_slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(fingerprints(t, k).view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def block_count(n: int, distance: int) -> int:
    """Number of blocks with the least copies and (for evenly spread fingerprints) candidate pairs."""

    def cost(m: int) -> float:
        ways = comb(m, distance)
        return ways * n + ways * n * n / 2 ** (64 * (m - distance) / m + 1)

    return min(range(distance + 1, distance + 5), key=lambda m: (cost(m), m))


def block_masks(m: int, distance: int) -> list[int]:
    """Bit masks of every choice of ``m - distance`` of ``m`` blocks; as signed 64-bit numbers."""
    edge = [64 * i // m for i in range(m + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return [x - (1 << 64) if (x := sum(c)) >> 63 else x for c in combinations(block, m - distance)]


def spanning_links(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links ``a, b`` that connect what pairs of at most ``distance`` differing bits connect; one fewer than a group's members."""
    fp = fp.view(np.uint64)
    left = np.arange(len(fp))
    a_out, b_out = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, _CELLS // len(left))
            now, front = front[:step], front[step:]
            near = np.bitwise_count(fp[now][:, None] ^ fp[left][None, :]) <= distance
            hit = near.any(axis=0)
            if hit.any():
                new = left[hit]
                a_out.append(fp[now[near[:, hit].argmax(axis=0)]])
                b_out.append(fp[new])
                left, front = left[~hit], np.concatenate([front, new])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a_out]).view(np.int64), np.concatenate([none, *b_out]).view(np.int64)


def _bucket_links(buckets: DataFrame, distance: int) -> DataFrame:
    """Links in rows ``way, key, i, j, fp`` that share the first four; rows come sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.flatnonzero((x[:4, 1:] != x[:4, :-1]).any(axis=0)) + 1
            found = [spanning_links(x[4, lo:hi], distance) for lo, hi in zip([0, *new.tolist()], [*new.tolist(), x.shape[1]], strict=True)]
            a, b = (np.concatenate(e) for e in zip(*found, strict=True))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            x = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("way", "key", "i", "j", "fp")])
            last = np.flatnonzero((x[:4] != x[:4, -1:]).any(axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if cut:
                yield from out(np.concatenate([*held, x[:, :cut]], axis=1))
                held = []
            elif held and (held[-1][:4, -1] != x[:4, 0]).any():
                yield from out(np.concatenate(held, axis=1))
                held = []
            held.append(x[:, cut:])
        if held:
            yield from out(np.concatenate(held, axis=1))

    return buckets.mapInArrow(run, "a long, b long")


def links(found: DataFrame, *, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """Links ``a, b`` between different fingerprints of ``found`` (column ``fp``) that give the components of all close pairs."""
    ship_package(found.sparkSession)
    fps = materialize(found.select("fp").distinct(), "simhash-fingerprints")
    m = blocks or block_count(fps.count(), distance)
    masks = F.array(*[F.lit(x).cast("long") for x in block_masks(m, distance)])
    keyed = fps.select("fp", F.posexplode(masks).alias("way", "mask")).select("way", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    sizes = keyed.groupBy("way", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = sizes.select("way", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    dealt = keyed.join(sizes, ["way", "key"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("way", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "fp")
    return _bucket_links(dealt.repartition("way", "key", "i", "j").sortWithinPartitions("way", "key", "i", "j"), distance).distinct()


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4, distance: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    found = materialize(fingerprinted(docs, id_col=id_col, text_col=text_col, k=k), "simhash")
    roots = materialize(components(links(found, distance=distance)), "simhash-roots")
    least = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    grouped = least.join(few(roots.withColumnRenamed("id", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    grouped = materialize(grouped, "simhash-groups")
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    per_fp = materialize(grouped.join(named, "root").select("fp", "component_id"), "simhash-components")
    return found.join(few(per_fp), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Hard negatives by rotated one-bit codes, deterministic score intervals and integer scores.

1. A component c becomes the integer floor(scale * c); a score is an integer inner product.
2. Stored code of a vector x: y = R x for a seeded rotation R; the signs of y are d bits, b is the unit vector
   of those signs, and the alignment a = <y, b> is stored with |x|**2. So y = a b + r with r orthogonal to b, |r|**2 = |x|**2 - a**2.
3. An anchor q, rotated, is rounded to ``QUERY_BITS`` bits a component; bit planes against codes give an
   estimate p of t = <Rq, b> by popcounts, wrong by at most e, the length of the rounding error (b is a unit vector).
   Then <q, x> = a t + <Rq, r>, and by Cauchy-Schwarz |<Rq, r>| <= sqrt(|q|**2 - t**2) |r|. So the score lies in
   a p +- (|a| e + sqrt(|q|**2 - max(0, |p| - e)**2) |r|), widened for rounding of doubles.
4. Pairs whose interval cannot matter are dropped, all others are scored as integers; only those scores decide.
   Positives: the interval must reach the ``positives``-th best integer score among the best estimates. Negatives: it must meet a positive's band.
5. Rows are dealt in blocks of about ``BLOCK`` by a hash of their number, whatever their label; each block is one task's
   memory, and all anchors stream past it. A block gives its best few of each anchor (and band), the
   best of all blocks are the answer.

Every pair of an anchor and a row is estimated: work is anchors times rows, in blocks; nothing is sampled or capped.

Defined cases: rows with a null label or a null or empty vector, with a null, NaN or infinite component, or with another
length than most (the greater of equally frequent ones) take no part; repeated identifiers are separate rows, of
equal scores the smaller identifier comes first, null ones last; an anchor is never its own positive, a copy of it may be; a
component beyond +-sqrt(2**62 / d) stays at that limit, so that every score is a long; a band of a negative
positive score is empty; an anchor without positives or with empty bands gives no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, pick, ship_package
from .vectors import is_finite, matrix, same_length

#: Rows of one block, at most about; with few rows blocks are smaller, down to ``_LEAST``, so that all tasks have work.
BLOCK, _LEAST = 1 << 16, 1 << 10
QUERY_BITS = 4
SEED = 20240613
#: Cells of one table of anchors by rows.
_CELLS = 1 << 20
#: Best estimates of an anchor that are scored first, for each positive wanted.
_FIRST = 4


# ---------------------------------------------------------------- vectors, codes, intervals

def integers(c: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * c), at most sqrt(2**62 / d) in size."""
    most = isqrt((1 << 62) // c.shape[1])
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c * scale), -float(most), float(most)).astype(np.int64).clip(-most, most)


@lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    """A seeded orthogonal matrix."""
    g = np.random.Generator(np.random.PCG64(SEED)).standard_normal((dims, dims))
    q, r = np.linalg.qr(g)
    return q * np.sign(np.diagonal(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words (zeros at the end)."""
    raw = np.packbits(bits, axis=1)
    out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.view(np.uint64)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the rotated rows as words, and their alignments."""
    y = x.astype(np.float64) @ rotation(x.shape[1]).T
    return _packed(y > 0), np.abs(y).sum(axis=1) / np.sqrt(x.shape[1])


@dataclass
class Codes:
    """Stored codes of the rows of a block."""

    words: np.ndarray  # (rows, words)
    align: np.ndarray
    size: np.ndarray  # |x|

    @property
    def rest(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.size**2 - self.align**2, 0))

    def part(self, at: slice) -> Codes:
        return Codes(self.words[at], self.align[at], self.size[at])


def intervals(q: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Middle and half width (anchors, rows) of intervals that hold the inner products."""
    dims = q.shape[1]
    y = q.astype(np.float64) @ rotation(dims).T
    low = y.min(axis=1)
    step = (y.max(axis=1) - low) / ((1 << QUERY_BITS) - 1)
    step = np.where(step > 0, step, 1.0)
    u = np.rint((y - low[:, None]) / step[:, None]).astype(np.int64)
    error = np.sqrt(((low[:, None] + step[:, None] * u - y) ** 2).sum(axis=1))
    ones = np.bitwise_count(codes.words).sum(axis=1, dtype=np.int32)
    both = np.zeros((len(q), len(ones)), np.int32)
    for bit in range(QUERY_BITS):
        plane = _packed((u >> bit & 1).astype(bool))
        for w in range(plane.shape[1]):
            both += np.bitwise_count(plane[:, w, None] & codes.words[None, :, w]).astype(np.int32) << bit
    # <rounded q, b>: signs are 2 * bit - 1
    p = (step[:, None] * (2 * both - u.sum(axis=1)[:, None]) + low[:, None] * (2 * ones - dims)[None, :]) / np.sqrt(dims)
    size = norms(q)
    sure = np.maximum(np.abs(p) - error[:, None], 0)
    across = np.sqrt(np.maximum((size**2)[:, None] - sure**2, 0))
    half = codes.align * error[:, None] + across * codes.rest
    slack = 1e-9 * size[:, None] * (codes.size + 1) + 1e-6
    return p * codes.align, half + slack


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with one integer vector."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * len(q)
    if most < 1 << 53:  # every partial sum is an integer that a double holds
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


# ---------------------------------------------------------------- one block against anchors

@dataclass
class Block:
    """Rows of one block, sorted by label."""

    x: np.ndarray
    codes: Codes
    rid: np.ndarray
    id_rank: np.ndarray  # rows by identifier, nulls last
    labels: dict[str, slice]

    def others(self, label: str | None) -> list[slice]:
        at = self.labels.get(label)
        n = len(self.rid)
        return [slice(0, n)] if at is None else [s for s in (slice(0, at.start), slice(at.stop, n)) if s.start < s.stop]


def _best(block: Block, rows: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` rows by falling score, then identifier."""
    if len(rows) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        rows, score = rows[score >= least], score[score >= least]
    order = np.lexsort((block.id_rank[rows], -score))[:k]
    return rows[order], score[order]


def best_positives(block: Block, at: slice, q: np.ndarray, rid: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(anchor, rows, scores)``: the first ``k`` other rows of the slice for each anchor."""
    x, own = block.x[at], block.rid[at]
    mid, half = intervals(q, block.codes.part(at))
    top = mid + half
    for a in range(len(q)):
        upper, centre = top[a], mid[a]
        mine = own == rid[a]
        if mine.any():
            upper = np.where(mine, -np.inf, upper)
            centre = np.where(mine, -np.inf, centre)
        first = min(_FIRST * k, len(x))
        seeds = np.argpartition(centre, len(x) - first)[len(x) - first :]
        seeds = seeds[~mine[seeds]]
        if len(seeds) >= k:
            known = scores(x[seeds], q[a])
            bar = np.partition(known, len(known) - k)[len(known) - k]
        else:
            bar = -np.inf
        left = np.flatnonzero((upper >= bar) & ~mine)
        yield a, *_best(block, left + at.start, scores(x[left], q[a]), k)


def best_negatives(
    block: Block, at: slice, q: np.ndarray, bands: list[list[tuple[int, int]]], k: int
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(anchor, band, rows, scores)``: the first ``k`` rows of the slice whose score lies in each anchor's bands."""
    x = block.x[at]
    mid, half = intervals(q, block.codes.part(at))
    for a, mine in enumerate(bands):
        low, high = mid[a] - half[a], mid[a] + half[a]
        left = np.flatnonzero((high >= min(b[0] for b in mine)) & (low <= max(b[1] for b in mine)))
        score = scores(x[left], q[a])
        for n, (lo, hi) in enumerate(mine):
            inside = (score >= lo) & (score <= hi)
            if inside.any():
                yield a, n, *_best(block, left[inside] + at.start, score[inside], k)


# ---------------------------------------------------------------- distributed passes

def _encoded(df: DataFrame, id_col: str, vec_col: str, label: Column, anchor: Column, scale: int) -> tuple[DataFrame, int]:
    """``rid, id, label, anchor, x, code, align`` of the rows that take part, written once; and their number."""
    vec = pick(df, vec_col)
    rows = df.where(label.isNotNull() & is_finite(vec)).select(
        pick(df, id_col).alias("id"), label.cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.transform(vec, lambda x: x.cast("double")).alias("c"),
    )
    rows, dims, n = same_length(rows, "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = integers(matrix(b["c"], dims), scale)
                words, align = encode(x)
                raw = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, words)]
                yield pa.RecordBatch.from_arrays([b["id"], b["label"], b["anchor"], raw[0], raw[1], pa.array(align)], names=["id", "label", "anchor", "x", "code", "align"])

    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, label string, anchor boolean, x binary, code binary, align double")
    return materialize(made.withColumn("rid", F.monotonically_increasing_id()), "negatives-codes"), n


def _blocks(df: DataFrame, n: int) -> int:
    """Blocks by the number of rows: of ``BLOCK`` rows, or smaller ones as long as they give idle tasks work."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-n // BLOCK), min(tasks, -(-n // _LEAST)))


def _meet(rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Rows and anchors by block: first the block's rows, then all anchors by label."""
    dealt = rows.select(F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "rid", "id", "label", "x", "code", "align", F.lit(None).cast("array<long>").alias("bands"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "rid", F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "label", "x", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("align"), "bands")
    return dealt.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind", "label")


def _vectors(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.int64).reshape(len(col), -1)


def _make_block(t: pa.Table) -> tuple[Block, pa.ChunkedArray]:
    """The block of rows sorted by label, and their identifiers in that order."""
    x = _vectors(t["x"])
    words = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint64).reshape(len(x), -1)
    label = t["label"].to_pylist()
    cut = [0, *(i for i in range(1, len(label)) if label[i] != label[i - 1]), len(label)]
    rank = np.empty(len(x), np.int64)
    rank[pa.compute.sort_indices(t["id"], null_placement="at_end").to_numpy()] = np.arange(len(x))
    return Block(x, Codes(words, t["align"].to_numpy(), norms(x)), t["rid"].to_numpy(), rank, {label[a]: slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)}), t["id"]


def _past_blocks(met: DataFrame, ask: Callable, out: T.StructType) -> DataFrame:
    """Run ``ask(block, anchors)`` on each block with its anchors, in batches of one label; memory holds one block and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block, ids = None, [], None, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            key = t["block"].to_numpy().astype(np.int64) * 2 + t["kind"].to_numpy()
            new = np.flatnonzero(key[1:] != key[:-1]) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(t)], strict=True):
                if lo == hi:
                    continue
                part, (number, kind) = t.slice(lo, hi - lo), divmod(int(key[lo]), 2)
                if number != at:
                    at, held, block = number, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if block is None:
                    if not held:  # no row fell into this block
                        continue
                    (block, ids), held = _make_block(pa.concat_tables(held)), []
                label = part["label"].to_pylist()
                cut = [0, *(i for i in range(1, len(label)) if label[i] != label[i - 1]), len(label)]
                step = max(1, _CELLS // len(block.rid))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    for i in range(a, b, step):
                        some = part.slice(i, min(step, b - i))
                        found = list(ask(block, label[a], _vectors(some["x"]), some["rid"].to_numpy(), some["bands"]))
                        if found:
                            rids, bands, rows, got = zip(*found, strict=True)
                            count = [len(r) for r in rows]
                            took = np.concatenate(rows)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.repeat(rids, count), pa.int64()), pa.array(np.repeat(bands, count), pa.int64()),
                                 ids.take(pa.array(took)).combine_chunks(), pa.array(np.concatenate(got), pa.int64())],
                                names=out.names,
                            )

    return met.mapInArrow(run, out)


def _first(df: DataFrame, k: int, *group: str) -> DataFrame:
    """The first ``k`` rows of each group by falling score, then identifier; with their ``rank``."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(
    df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None, anchor: Column | None = None,
    positives: int = 5, negatives: int = 5, num: int = 80, den: int = 100, scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``label`` (default: the column ``label``) and ``anchor`` (a condition; default: every row is one) are expressions of ``df``'s columns. Negatives of a
    positive with score p are rows of other labels with num * p <= den * score <= den * p.
    """
    ship_package(df.sparkSession)
    label = pick(df, "label") if label is None else label
    anchor = F.lit(True) if anchor is None else anchor
    rows, n = _encoded(df, id_col, vec_col, label, anchor, scale)
    kind = rows.schema["id"].dataType
    out = T.StructType([T.StructField("rid", T.LongType()), T.StructField("band", T.LongType()), T.StructField("id", kind), T.StructField("score", T.LongType())])
    blocks = _blocks(rows, n)
    anchors = rows.where("anchor").select("rid", "id", "label", "x")

    def ask_positives(block, of, q, rid, _):
        if of in block.labels:
            for a, at, score in best_positives(block, block.labels[of], q, rid, positives):
                yield rid[a], 0, at, score

    met = _meet(rows, anchors.withColumn("bands", F.lit(None).cast("array<long>")), blocks)
    near = materialize(_first(_past_blocks(met, ask_positives, out), positives, "rid"), "negatives-positives")

    # the distinct positive scores of an anchor that can have negatives
    bands = near.where("score >= 0").groupBy("rid").agg(F.sort_array(F.collect_set("score")).alias("bands"))  # at most `positives` numbers

    def ask_negatives(block, of, q, rid, bands):
        bounds = [[(-(-num * p // den), p) for p in b] for b in bands.to_pylist()]
        for at in block.others(of):
            for a, b, row, score in best_negatives(block, at, q, bounds, negatives):
                yield rid[a], bounds[a][b][1], row, score

    met = _meet(rows, anchors.join(bands, "rid"), blocks)
    far = _first(_past_blocks(met, ask_negatives, out), negatives, "rid", "band")
    far = far.select("rid", F.col("band").alias("positive_score"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    named = near.select("rid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors.select("rid", F.col("id").alias("anchor_id")), "rid")
    return named.join(far, ["rid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def report(df: DataFrame) -> DataFrame:
    """The registered query: anchors are rows whose identifier is divisible by 100; every seventh row has the next label."""
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(df, label=moved, anchor=vec_id % 100 == 0)


#: The registered query in DuckDB SQL: every score, then ranks.
ORACLE = """
WITH used AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.rid, a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score
  FROM used a JOIN used r ON a.rid <> r.rid
  WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS place
  FROM scored WHERE same QUALIFY place <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.rid, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.rid = p.rid AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""

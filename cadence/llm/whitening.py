"""Whitening of embeddings from exact integer scatter matrices.

1. An entry c becomes the integer x = floor(SCALE * c) + OFFSET.
2. Bit-sliced scatter: a block of rows is shifted to the block's least value of each
   dimension; bit plane a of dimension i, packed across rows into 64-bit words, is P(i, a).
   The block's products are sum over a, b of 2**(a+b) * popcount(P(i, a) & P(j, b)), moved back by the shift.
   All sums are exact: decimals of 38 digits between tasks, Python integers on the driver.
3. Centred as integers: n * C - S S' is divided by n**2 once, correctly rounded, before ``eigh``.
4. Rows are projected on the components; the covariance of the whitened values is measured over all rows.

The driver gets d * (d + 1) / 2 + d numbers for vectors of d dimensions, whatever the number of rows.

Defined cases: rows whose vector is null or empty, holds a null, NaN or infinite entry, or has
another length than most (the greater of equally frequent lengths) are left out of fit and result;
repeated and null identifiers are separate rows; an integer beyond +-2**62 stays at that limit, and sums beyond 38
digits are an error; a ``deviation`` that does not fit a long is null (``deviation_exact`` has 38 digits); a
component without variance has null whitened values, and ``identity_error`` covers the others (null if there are none);
the sign of a component is such that its entry of greatest size is positive; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, pick, ship_package
from .vectors import is_finite, matrix, same_length

SCALE, OFFSET = 1024, 100_000
#: Entries (rows times dimensions) of one block of bit planes, and its most rows.
_BLOCK_ENTRIES, _BLOCK_ROWS = 1 << 22, 1 << 14
_WIDE = T.DecimalType(38, 0)
_LIMIT = 2.0**62


def integers(c: np.ndarray, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    """floor(scale * c) + offset as 64-bit integers."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c * scale), -_LIMIT, _LIMIT).astype(np.int64) + offset


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(planes, dim, bit)`` of non-negative integers y (rows, dims): packed planes that are needed, with their dimension and bit."""
    rows, dims = y.shape
    widths = [max(1, int(m).bit_length()) for m in y.max(axis=0)]
    dim = np.repeat(np.arange(dims), widths)
    bit = np.concatenate([np.arange(w) for w in widths])
    planes = np.zeros((len(dim), -(-rows // 64)), np.uint64)
    raw = planes.view(np.uint8)
    for k, (i, a) in enumerate(zip(dim.tolist(), bit.tolist(), strict=True)):
        packed = np.packbits(((y[:, i] >> np.uint64(a)) & np.uint64(1)).astype(np.uint8))
        raw[k, : len(packed)] = packed
    return planes, dim, bit


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums (dims) and cross-products (dims, dims) of an integer block, as Python integers in object arrays."""
    rows, dims = x.shape
    least = x.min(axis=0)
    planes, dim, bit = bit_planes((x - least).view(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], dim[1:] != dim[:-1]]))
    # 2**(a + b) * count, exact in 64 bits where the widest product of a block stays below 2**62
    small = 2 * (int(bit.max()) + 1) + rows.bit_length() < 62
    kind = np.int64 if small else object
    weight = np.array([1 << int(a) for a in bit], kind)
    s = np.add.reduceat(np.bitwise_count(planes).sum(axis=1, dtype=np.int64) * weight, first).astype(object)
    c = np.zeros((dims, dims), kind)
    for k, i in enumerate(dim.tolist()):  # dimension i against itself and the later ones
        f = first[i]
        counts = np.bitwise_count(planes[f:] & planes[k]).sum(axis=1, dtype=np.int64)
        c[i, i:] += weight[k] * np.add.reduceat(counts * weight[f:], first[i:] - f)
    c = (np.triu(c) + np.triu(c, 1).T).astype(object)
    low = least.astype(object)  # x = y + low
    c = c + np.outer(low, s) + np.outer(s, low) + rows * np.outer(low, low)
    return s + rows * low, c


@dataclass(frozen=True)
class Whitening:
    dims: int
    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # (k, dims), unit rows, by falling eigenvalue
    eigenvalues: np.ndarray  # (k,)
    trace: float
    live: np.ndarray  # (k,) components with variance
    scale: int = SCALE
    offset: int = OFFSET


def _rows(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, int]:
    vec = pick(df, vec_col)
    kept = df.where(is_finite(vec)).select(pick(df, id_col).alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("c"))
    return same_length(kept, "c")


def _fit(rows: DataFrame, dims: int, n: int, k: int, scale: int, offset: int) -> Whitening:
    upper = np.triu_indices(dims)
    most = max(64, min(_BLOCK_ROWS, _BLOCK_ENTRIES // dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, c = np.zeros(dims, object), np.zeros((dims, dims), object)
        for b in batches:
            x = integers(matrix(b.column(0), dims), scale, offset)
            for at in range(0, len(x), most):
                more_s, more_c = scatter(x[at : at + most])
                s, c = s + more_s, c + more_c
        i = np.concatenate([np.arange(dims), upper[0]])
        j = np.concatenate([np.full(dims, -1), upper[1]])
        v = pa.array([Decimal(int(e)) for e in [*s, *c[upper]]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), v], names=["i", "j", "v"])

    parts = rows.select("c").mapInArrow(run, T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("v", _WIDE)]))
    total = parts.groupBy("i", "j").agg(F.try_sum("v").alias("v")).collect()  # dims * (dims + 1) / 2 + dims rows
    if any(r.v is None for r in total):
        raise OverflowError("sums of products leave 38 digits")
    got = {(r.i, r.j): int(r.v) for r in total}
    s = [got[i, -1] for i in range(dims)]
    v = np.zeros((dims, dims))
    for i, j in zip(*(x.tolist() for x in upper), strict=True):
        v[i, j] = v[j, i] = (n * got[i, j] - s[i] * s[j]) / (n * n)  # one rounding of an exact fraction
    e, q = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:k]
    q, e = q[:, order].T, e[order]
    q *= np.sign(q[np.arange(len(q)), np.abs(q).argmax(axis=1)])[:, None]
    trace = float(np.trace(v))
    return Whitening(dims, n, tuple(s), q, e, trace, e > trace * dims * 2.0**-50, scale, offset)


def fit(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, scale: int = SCALE, offset: int = OFFSET) -> Whitening | None:
    """The first ``k`` components of all rows that take part; None if there are none."""
    ship_package(df.sparkSession)
    rows, dims, n = _rows(df, id_col, vec_col)
    return _fit(rows, dims, n, k, scale, offset) if n else None


def _whitened(rows: DataFrame, m: Whitening) -> DataFrame:
    to = np.where(m.live, 1 / np.sqrt(np.where(m.live, m.eigenvalues, 1)), 0)[:, None] * m.components
    big = max(abs(s) for s in m.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = integers(matrix(b.column(1), m.dims), m.scale, m.offset)
            if m.n * max(abs(int(x.min())), abs(int(x.max()))) + big < 1 << 62:
                off = m.n * x - np.array(m.sums, np.int64)
            else:
                off = m.n * x.astype(object) - np.array(m.sums, object)
            if off.dtype != object and m.dims * int(np.abs(off).max()) ** 2 >= 1 << 63:
                square = (off.astype(object) ** 2).sum(axis=1)
            else:
                square = (off**2).sum(axis=1)
            whole = [int(v) for v in square]
            w = (off / m.n).astype(np.float64) @ to.T
            w = pa.array(w.ravel(), pa.float64(), mask=np.tile(~m.live, len(w)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([v if v < 1 << 63 else None for v in whole], pa.int64()),
                 pa.array([Decimal(v) if v < 10**38 else None for v in whole], pa.decimal128(38, 0)),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, len(w) + 1, len(to)), pa.int32()), w)],
                names=["id", "deviation", "deviation_exact", "w"],
            )

    out = T.StructType([rows.schema["id"], T.StructField("deviation", T.LongType()), T.StructField("deviation_exact", _WIDE), T.StructField("w", T.ArrayType(T.DoubleType()))])
    return rows.select("id", "c").mapInArrow(run, out)


def transform(df: DataFrame, model: Whitening, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, deviation, deviation_exact, w``: the whitened values of every row of the model's length."""
    ship_package(df.sparkSession)
    vec = pick(df, vec_col)
    rows = df.where(is_finite(vec) & (F.size(vec) == model.dims))
    return _whitened(rows.select(pick(df, id_col).alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("c")), model)


def identity_error(wide: DataFrame, model: Whitening) -> float | None:
    """Greatest entry, by size, of the whitened values' covariance minus the identity; over components with variance."""
    live = np.flatnonzero(model.live).tolist()
    pairs = [(i, j) for i in live for j in live if i <= j]
    if not pairs:
        return None
    got = wide.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(got, pairs, strict=True))


def report(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact``: a row of each vector and component."""
    spark = df.sparkSession
    ship_package(spark)
    rows, dims, n = _rows(df, id_col, vec_col)
    kind = rows.schema["id"].dataType.simpleString()
    if not n:
        return spark.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
        )
    m = _fit(rows, dims, n, k, scale, offset)
    wide = materialize(_whitened(rows, m), "whitened")
    error = identity_error(wide, m)
    shares = F.array(*[F.lit(float(e / m.trace) if m.trace else None).cast("double") for e in m.eigenvalues])
    long = wide.select(F.col("id").alias("vec_id"), "deviation", "deviation_exact", F.posexplode("w").alias("at", "whitened"))
    return long.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_exact",
    )

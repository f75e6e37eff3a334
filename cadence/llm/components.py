"""Connected components of an edge table, by alternating large and small stars.

Every round is joins and minimum aggregates on the edge table, written to the
shared folder (a side of few rows, by the known count, is broadcast). What a round writes is
first contracted where it lies: the edges of one task, ``EDGES`` at a time, become stars around the least node
that they reach. So most small tables are settled before any round, and rounds grow with the logarithm of the longest
path at most. Nothing of the graph reaches the driver but two counts a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, give_back, materialize, ship_package

#: Edges that a task contracts at once.
EDGES = 500_000


def _large(e: DataFrame, n: int) -> DataFrame:
    """Greater neighbours of each node move to its least neighbour (or itself)."""
    down = e.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    ends = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return down.join(few(least, 2 * n), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small(e: DataFrame, n: int) -> DataFrame:
    """Lesser neighbours of each node, and the node, move to the least of them."""
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(few(least, n), "u").select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges but the least of its component, and that least one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while len(x):
        p, q = label[x], label[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def _contracted(e: DataFrame) -> DataFrame:
    """Edges with the same components: those of a task become stars, ``EDGES`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate([h[c].to_numpy() for h in held]) for c in ("a", "b"))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in stars(a, b)], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= EDGES:
                yield out()
        if held:
            yield out()
        give_back()

    return e.mapInArrow(run, "a long, b long")


def _state(e: DataFrame) -> tuple[int, int]:
    """Edges ``a, b`` (a the greater), and nodes that keep them from being stars: with several lesser neighbours, or with lesser and greater ones."""
    ends = e.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(e.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    node = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, odd = node.agg(F.sum("up"), F.count(F.when((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)), 1))).first()
    return n or 0, odd


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for every node of ``edges (a, b)``; root is the least id of the component."""
    ship_package(edges.sparkSession)
    plain = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct()
    e = materialize(_contracted(plain), "edges")
    while True:
        n, odd = _state(e)
        if not odd:
            break
        e = materialize(_contracted(_small(_large(e, n), n)), "stars")
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())

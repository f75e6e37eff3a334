"""A Parquet fact store with a unique natural key.

Layout: ``partitionBy('DataType', 'Year')`` so entity-kind and year filters
prune whole folders. The key check against the store is a semi join of the
*store* with the batch keys: the batch is the build side (broadcast only when
Spark's size check allows), and dynamic partition pruning skips store
folders whose (DataType, Year) does not occur in the batch.

Appends in ``skip`` mode are idempotent: re-running a batch after a lost
executor or a failed job appends nothing twice. Writers may append at the same time: a batch's
new rows are staged, then the writer takes the table's next commit (``commits``); if another
took it first, the batch is checked again against the table that now holds the other's rows.
Replacing a table (``create``) is not meant to run beside appends.

Writes go through Spark's rebalance hint on the folder columns: adaptive
execution sizes files by bytes, so a hot folder is written by many tasks and a small one by one. Rows of a
file are sorted by name and carry a Bloom filter on it, so a read of one entity skips row groups.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.session import _hadoop, materialize, path_exists
from cadence.sources import commits
from cadence.sources.wide_csv import in_folders

ANNUAL_SCHEMA = T.StructType(
    [
        T.StructField("Name", T.StringType(), False),
        T.StructField("DataType", T.StringType(), False),
        T.StructField("Year", T.IntegerType(), False),
        T.StructField("Registrations", T.LongType(), False),
    ]
)
MONTHLY_SCHEMA = T.StructType(
    [
        T.StructField("Name", T.StringType(), False),
        T.StructField("DataType", T.StringType(), False),
        T.StructField("Year", T.IntegerType(), False),
        T.StructField("Month", T.StringType(), False),
        T.StructField("MonthlyRegistrations", T.LongType(), False),
    ]
)
ANNUAL_KEY = ("Name", "DataType", "Year")
MONTHLY_KEY = ("Name", "DataType", "Year", "Month")

R_KEY_EXISTS = "key exists in store"
R_DUP_IN_BATCH = "duplicate key in batch"


@dataclass
class AppendResult:
    appended: bool
    conflicts: DataFrame  # keys with a Reason
    dropped: DataFrame  # rows of the batch that were not appended, with a Reason


class FactStore:
    """One fact table: create / read / check keys / append."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        key: Sequence[str],
        partition_by: Sequence[str] = ("DataType", "Year"),
        row_group_bytes: int | None = None,
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.key = list(key)
        self.partition_by = list(partition_by)
        self.row_group_bytes = row_group_bytes  # None: the writer's default

    @classmethod
    def annual(cls, spark: SparkSession, path: str) -> FactStore:
        return cls(spark, path, ANNUAL_SCHEMA, ANNUAL_KEY)

    @classmethod
    def monthly(cls, spark: SparkSession, path: str) -> FactStore:
        return cls(spark, path, MONTHLY_SCHEMA, MONTHLY_KEY)

    def _conform(self, df: DataFrame) -> DataFrame:
        """Project to the table schema; NOT NULL columns drop NULL rows."""
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        not_null = [f.name for f in self.schema.fields if not f.nullable]
        return df.select(*cols).dropna(subset=not_null)

    def _write(self, df: DataFrame, mode: str, path: str | None = None) -> None:
        by_name = [c for c in self.key[:1] if c not in self.partition_by]
        out = in_folders(self._conform(df).hint("rebalance", *self.partition_by), self.partition_by, by_name)
        writer = out.write.mode(mode).partitionBy(*self.partition_by)
        for c in by_name:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        if self.row_group_bytes:
            writer = writer.option("parquet.block.size", str(self.row_group_bytes))
        writer.parquet(path or self.path)

    def exists(self) -> bool:
        return path_exists(self.spark, self.path)

    def create(self, df: DataFrame | None = None, replace: bool = True) -> None:
        """replace=True: drop and recreate; False: create only if missing. Rows that repeat a key are an error."""
        if not replace and self.exists():
            return
        if df is None:
            df = self.spark.createDataFrame([], self.schema)
        else:
            df = materialize(self._conform(df), "store-rows")
            if not self._repeated(df).isEmpty():
                raise ValueError(f"rows repeat a key {self.key}")
        self._write(df, "overwrite")

    def _repeated(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*self.key)

    def read(self) -> DataFrame:
        """The stored facts; a missing table has none."""
        if not self.exists():
            return self.spark.createDataFrame([], self.schema)
        return (
            self.spark.read.schema(self.schema)
            .option("basePath", self.path)
            .parquet(self.path)
            .select(*[f.name for f in self.schema.fields])
        )

    def years(self) -> list[int]:
        """Years that the store has facts of, from its folders' names; no file is opened."""
        if not self.exists() or "Year" not in self.partition_by:
            return []
        fs, pattern = _hadoop(self.spark, f"{self.path}/" + "/".join(f"{c}=*" for c in self.partition_by))
        names = [s.getPath().toString() for s in fs.globStatus(pattern) or []]
        return sorted({int(y) for n in names for y in re.findall(r"/Year=(-?\d+)(?:/|$)", n)})

    def version(self) -> int:
        """The table's last commit; its files are in place."""
        number = commits.last(self.spark, self.path)
        commits.finish(self.spark, self.path, number)  # a taken commit may wait for its files
        return number

    def holders(self, rows: DataFrame, by: str) -> DataFrame:
        """(``by``): its values that have a row whose key the table holds.

        The table meets the rows by 64-bit hashes of keys: numbers are shuffled, not names. Keys decide: of each value the
        least hash that the table has too is looked up, the others only where that one's key is not stored.
        """
        mine = rows.select(by, *[F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.key]).withColumn("__h", F.xxhash64(*self.key))
        stored = self._near(mine).withColumn("__h", F.xxhash64(*self.key))
        met = materialize(stored.select("__h").join(mine.select("__h"), "__h", "left_semi"), "store-met")
        if met.isEmpty():
            return mine.select(by).where(F.lit(False))

        def confirmed(asked: DataFrame) -> DataFrame:
            found = stored.join(asked.select("__h").distinct(), "__h", "left_semi").select(*self.key)
            return materialize(mine.join(asked, [by, "__h"], "left_semi").join(found, self.key, "left_semi").select(by).distinct(), "store-holders")

        asked = materialize(mine.select(by, "__h").join(met, "__h", "left_semi"), "store-asked")
        sure = confirmed(materialize(asked.groupBy(by).agg(F.min("__h").alias("__h")), "store-first"))
        rest = asked.join(sure, by, "left_anti")
        return sure if rest.isEmpty() else sure.unionByName(confirmed(rest))

    def _near(self, keys: DataFrame) -> DataFrame:
        """Stored keys of the folders that ``keys`` fall into."""
        out = self.read().select(*self.key)
        folders = [c for c in self.partition_by if c in self.key]
        values = keys.agg(*[F.collect_set(c).alias(c) for c in folders]).first() if folders else {}
        for c in folders:  # as literals, so that other folders are not listed among the scan's files
            out = out.where(F.col(c).isin(values[c]))
        return out

    def _stored(self, keys: DataFrame) -> DataFrame:
        return self.read().select(*self.key).join(keys, self.key, "left_semi")

    def _checked(self, rows: DataFrame) -> DataFrame:
        """One row a key of the batch: its count ``n``, its least row ``kept``, and whether the table holds it (``Held``)."""
        others = [c for c in rows.columns if c not in self.key]
        # one column that is never null: its least value, which Spark aggregates by hash; a least struct needs a sort by the key
        plain = len(others) == 1 and not self.schema[others[0]].nullable
        least = F.struct(F.min(others[0]).alias(others[0])) if plain else F.min(F.struct(*others))
        keys = rows.groupBy(*self.key).agg(F.count(F.lit(1)).alias("n"), least.alias("kept"))
        stored = self._stored(rows.select(*self.key)).withColumn("Held", F.lit(True))
        return keys.join(stored, self.key, "left").withColumn("Held", F.coalesce("Held", F.lit(False)))

    def _conflicts(self, checked: DataFrame) -> DataFrame:
        held = checked.where("Held").select(*self.key, F.lit(R_KEY_EXISTS).alias("Reason"))
        return held.unionByName(checked.where("n > 1").select(*self.key, F.lit(R_DUP_IN_BATCH).alias("Reason")))

    def conflicts(self, batch: DataFrame) -> DataFrame:
        """Keys of the batch that are duplicated inside it or already stored."""
        rows = materialize(self._conform(batch), "batch")
        return self._conflicts(materialize(self._checked(rows), "batch-keys"))

    def _dropped(self, rows: DataFrame, checked: DataFrame) -> DataFrame:
        """Rows whose key is stored, and all but the kept row of a repeated key.

        Equal rows are counted before they meet their key, so a key that a batch repeats does not gather in one task's window.
        """
        others = [c for c in rows.columns if c not in self.key]
        held = rows.join(checked.where("Held").select(*self.key), self.key, "left_semi").withColumn("Reason", F.lit(R_KEY_EXISTS))
        again = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("times"))
        again = again.join(checked.where("NOT Held AND n > 1").select(*self.key, "kept"), self.key)
        left = F.col("times") - F.struct(*others).eqNullSafe(F.col("kept")).cast("int")
        again = again.withColumn("left", left).where("left > 0").withColumn("one", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("left"))))
        return held.unionByName(again.select(*rows.columns, F.lit(R_DUP_IN_BATCH).alias("Reason")))

    def append(self, batch: DataFrame, on_conflict: str = "skip", clear_at: int | None = None) -> AppendResult:
        """Append a batch.

        ``skip``: of rows with one key in the batch the least by its other columns is
        taken, unless the store has the key; every other row comes back in ``dropped``.
        ``refuse``: any conflict refuses the whole batch (nothing appended).
        An empty batch writes nothing. A missing table is created first.
        ``clear_at``: the commit (``version``) of the table at which the caller has found that no key of the batch is stored or
        comes twice in the batch; keys are checked again only if the table has a later commit.
        """
        if on_conflict not in ("skip", "refuse"):
            raise ValueError("on_conflict must be 'skip' or 'refuse'")
        if not self.exists():
            self.create(replace=False)
        rows = None
        while True:
            number = self.version()
            if number == clear_at:
                new = self._conform(batch)
                dropped = new.withColumn("Reason", F.lit(R_KEY_EXISTS)).where(F.lit(False))
                bad = dropped.select(*self.key, "Reason")
            else:
                if rows is None:
                    rows = materialize(self._conform(batch), "batch")  # the batch is evaluated once
                checked = materialize(self._checked(rows), "batch-keys")  # written before the table changes
                bad, dropped = self._conflicts(checked), self._dropped(rows, checked)
                if on_conflict == "refuse" and not bad.isEmpty():
                    return AppendResult(False, bad, rows.withColumn("Reason", F.lit("batch refused")))
                new = checked.where("NOT Held").select(*self.key, "kept.*").select(*rows.columns)
            stage = f"{self.path}/_stage/{uuid.uuid4().hex}"
            self._write(new, "overwrite", stage)
            if commits.take(self.spark, self.path, number + 1, stage):
                commits.finish(self.spark, self.path, number + 1)
                return AppendResult(True, bad, dropped)
            commits.delete(self.spark, stage)

"""A kept growth table that follows the store: after an append only the touched entities are computed anew.

The table is partitioned by kind and a bucket of the entity's name. A refresh reads the store's facts
of the touched entities (a semi join; growth windows hold whole series, so an entity is done as a whole), puts
them beside the untouched rows of their buckets, and swaps those buckets in with dynamic partition overwrite. Other buckets are not
read or written. A refresh depends on the store and the touched names only, so a replay gives the same table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions.rules import Rules, group_name
from cadence.operators.growth import QOQ_SCHEMA, YOY_SCHEMA, qoq_growth, yoy_growth
from cadence.session import materialize, path_exists
from cadence.sources.store import FactStore

FOLDERS = ["DataType", "Bucket"]


@dataclass
class Refreshed:
    entities: int  # touched, and computed anew
    rows: int  # growth rows computed anew
    kept: int  # rows of the same buckets that were carried over


class GrowthTable:
    """Growth per entity (``yoy`` of annual, ``qoq`` of monthly facts) of one store; names mapped by ``rules`` if given."""

    def __init__(self, spark: SparkSession, path: str, store: FactStore, metric: str = "yoy", rules: Rules | None = None, buckets: int = 64):
        if metric not in ("yoy", "qoq"):
            raise ValueError("metric must be 'yoy' or 'qoq'")
        self.spark, self.path, self.store, self.metric, self.rules, self.buckets = spark, path.rstrip("/"), store, metric, rules, buckets
        self.schema = YOY_SCHEMA if metric == "yoy" else QOQ_SCHEMA

    def _named(self, facts: DataFrame) -> DataFrame:
        return facts if self.rules is None else facts.withColumn("Name", group_name("DataType", "Name", self.rules))

    def _bucket(self):
        return F.pmod(F.xxhash64("Name"), F.lit(self.buckets)).cast("int").alias("Bucket")

    def _growth(self, facts: DataFrame) -> DataFrame:
        return (yoy_growth if self.metric == "yoy" else qoq_growth)(facts).select(*self.schema.names)

    def full(self) -> DataFrame:
        """Growth of the whole store, computed anew."""
        return self._growth(self._named(self.store.read()))

    def read(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self._stored().select(*self.schema.names)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("Bucket", T.IntegerType())])).parquet(self.path)

    def refresh(self, touched: DataFrame) -> Refreshed:
        """Follow an append; ``touched`` has the kinds and names (of the store) that it added facts of."""
        names = materialize(self._named(touched.select("DataType", "Name")).where(F.col("Name").isNotNull()).distinct(), "touched")
        entities = names.count()
        if not entities:
            return Refreshed(0, 0, 0)
        facts = self._named(self.store.read()).join(names, ["DataType", "Name"], "left_semi")
        fresh = self._growth(facts).select("*", self._bucket(), F.lit(True).alias("fresh"))
        if path_exists(self.spark, self.path):
            folders = names.select("DataType", self._bucket()).distinct()
            old = self._stored().join(folders, FOLDERS, "left_semi").join(names, ["DataType", "Name"], "left_anti")
            fresh = fresh.unionByName(old.select(*fresh.columns[:-1], F.lit(False).alias("fresh")))
        rows = materialize(fresh, "growth-rows")  # written before the folders it was read from change
        counted = rows.agg(F.count_if("fresh"), F.count_if(~F.col("fresh"))).first()
        out = rows.drop("fresh").hint("rebalance", *FOLDERS)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS).parquet(self.path)
        return Refreshed(entities, counted[0], counted[1])

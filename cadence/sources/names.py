"""A kept dictionary of a store's names: the catalogue of entities without reading facts.

It follows the store: after an append, names it does not hold yet are added. Two writers may add one name
twice; a read gives each once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.session import materialize, path_exists

SCHEMA = "DataType string, Name string"


class NameDictionary:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path).distinct()

    def refresh(self, touched: DataFrame) -> int:
        """Add the kinds and names of an append; the number of new ones."""
        seen = touched.select("DataType", "Name").where(F.col("Name").isNotNull()).distinct()
        new = materialize(seen.join(self.read(), ["DataType", "Name"], "left_anti"), "new-names")  # read before the folder changes
        found = new.count()
        if found:
            new.hint("rebalance").write.mode("append").parquet(self.path)
        return found

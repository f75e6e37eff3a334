"""Catalog helpers: entity lists, year bounds, previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Groups the category list always offers (file profile) when none is present.
DEFAULT_GROUPS = ("2W", "3W", "4W")


def entity_catalog(
    annual: DataFrame,
    monthly: DataFrame,
    name_col: str = "Name",
    ensure_groups: Sequence[str] = (),
    grouped_type: str | None = None,
) -> DataFrame:
    """Distinct (DataType, Name) over both fact tables, sorted by code point.

    ``ensure_groups``: for ``grouped_type``, add these names when *none* of
    them is present (one-row scalar subquery, no driver round trip).
    """
    names = (
        annual.select("DataType", F.col(name_col).alias("Name"))
        .unionByName(monthly.select("DataType", F.col(name_col).alias("Name")))
        .where(F.col("Name").isNotNull())
        .distinct()
    )
    if ensure_groups and grouped_type is not None:
        spark = annual.sparkSession
        defaults = spark.createDataFrame([(grouped_type, g) for g in ensure_groups], "DataType string, Name string")
        present = (
            names.where((F.col("DataType") == grouped_type) & F.col("Name").isin(list(ensure_groups)))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        names = names.unionByName(defaults.where(present.scalar() == 0))
    return names.orderBy("DataType", "Name")


def year_bounds(annual: DataFrame, monthly: DataFrame, current_year=None) -> DataFrame:
    """Min and max year over both tables *and* the current year (one row)."""
    cur = F.year(F.current_date()) if current_year is None else F.lit(int(current_year))
    a = annual.agg(F.min("Year").alias("lo"), F.max("Year").alias("hi"))
    m = monthly.agg(F.min("Year").alias("lo"), F.max("Year").alias("hi"))
    both = a.unionByName(m).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return both.select(
        F.least(F.col("lo"), cur).cast("int").alias("MinYear"),
        F.greatest(F.col("hi"), cur).cast("int").alias("MaxYear"),
    )


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in a fixed order (a top-k: partial sort per task, then merge)."""
    return df.orderBy(*order).limit(n)

"""Period-over-period growth for every entity at once.

Plan shape (checked with ``explain``): scan -> partial aggregate ->
Exchange(keys, period) -> final aggregate -> Exchange(DataType, Name) ->
Sort -> Window(lag). The aggregate runs before the window, so a window
partition holds one row per period of one entity: a hot entity costs its
number of periods, never its raw row count. The entity filter of a view sits
on the window partition key, so Catalyst pushes it to the scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions.calendar import month_date, month_num, quarter_label
from cadence.functions.numeric import pct_change

YOY_SCHEMA = T.StructType(
    [
        T.StructField("DataType", T.StringType()),
        T.StructField("Name", T.StringType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Registrations", T.LongType()),
        T.StructField("PrevYearRegistrations", T.LongType()),
        T.StructField("YoYGrowth", T.DoubleType()),
    ]
)

QOQ_SCHEMA = T.StructType(
    [
        T.StructField("DataType", T.StringType()),
        T.StructField("Name", T.StringType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Quarter", T.IntegerType()),
        T.StructField("QuarterYear", T.StringType()),
        T.StructField("QuarterlyRegistrations", T.LongType()),
        T.StructField("PrevQuarterRegistrations", T.LongType()),
        T.StructField("QoQGrowth", T.DoubleType()),
    ]
)


def has_columns(df: DataFrame, cols: Iterable[str]) -> bool:
    """Input guard: all needed columns present (no Spark job is run)."""
    present = set(df.columns)
    return all(c in present for c in cols)


def empty_like(df: DataFrame, schema: T.StructType) -> DataFrame:
    """An empty result with the given schema, built without touching the data."""
    return df.sparkSession.createDataFrame([], schema)


def aggregate_annual(annual: DataFrame, group_col: str = "Name") -> DataFrame:
    """One row per (DataType, entity, Year); NULL entities never form a group."""
    return (
        annual.where(F.col(group_col).isNotNull())
        .groupBy("DataType", F.col(group_col).alias("Name"), F.col("Year").cast("int").alias("Year"))
        .agg(F.sum(F.col("Registrations").cast("bigint")).alias("Registrations"))
    )


def with_month_dates(monthly: DataFrame) -> DataFrame:
    """Add MonthNum and Date (first of month); rows whose month is unknown are dropped."""
    out = monthly.withColumn("MonthNum", month_num("Month")).withColumn(
        "Date", month_date(F.col("Year"), F.col("MonthNum"))
    )
    return out.where(F.col("Date").isNotNull())


def aggregate_quarterly(monthly: DataFrame, group_col: str = "Name") -> DataFrame:
    """Monthly rows -> one row per (DataType, entity, Year, Quarter)."""
    m = monthly if "Date" in monthly.columns else with_month_dates(monthly)
    m = m.where(F.col(group_col).isNotNull() & F.col("Date").isNotNull())
    quarter = F.quarter("Date")
    return m.groupBy(
        "DataType",
        F.col(group_col).alias("Name"),
        F.year("Date").alias("Year"),
        quarter.alias("Quarter"),
        quarter_label(F.year("Date"), quarter).alias("QuarterYear"),
    ).agg(F.sum(F.col("MonthlyRegistrations").cast("bigint")).alias("QuarterlyRegistrations"))


def entity_window(*order_cols: str):
    """The per-entity series window: partitioned by (DataType, Name), ordered by period."""
    return Window.partitionBy("DataType", "Name").orderBy(*order_cols)


def yoy_growth(annual: DataFrame, group_col: str = "Name") -> DataFrame:
    """Year-over-year growth. The lag is positional: a gap year compares with
    the previous *present* year. First year and zero predecessors give NULL."""
    if not has_columns(annual, ["DataType", group_col, "Year", "Registrations"]):
        return empty_like(annual, YOY_SCHEMA)
    agg = aggregate_annual(annual, group_col)
    prev = F.lag("Registrations").over(entity_window("Year"))
    return agg.select("DataType", "Name", "Year", "Registrations", prev.alias("PrevYearRegistrations")).withColumn(
        "YoYGrowth", pct_change("Registrations", "PrevYearRegistrations")
    )


def qoq_growth(monthly: DataFrame, group_col: str = "Name") -> DataFrame:
    """Quarter-over-quarter growth over the present quarters of each entity."""
    needed = ["DataType", group_col, "MonthlyRegistrations"]
    if not has_columns(monthly, needed) or not (
        "Date" in monthly.columns or has_columns(monthly, ["Year", "Month"])
    ):
        return empty_like(monthly, QOQ_SCHEMA)
    return qoq_of_quarters(aggregate_quarterly(monthly, group_col))


def qoq_of_quarters(q: DataFrame) -> DataFrame:
    """Quarter-over-quarter growth of quarterly sums."""
    prev = F.lag("QuarterlyRegistrations").over(entity_window("Year", "Quarter"))
    return q.select(
        "DataType",
        "Name",
        "Year",
        "Quarter",
        "QuarterYear",
        "QuarterlyRegistrations",
        prev.alias("PrevQuarterRegistrations"),
    ).withColumn("QoQGrowth", pct_change("QuarterlyRegistrations", "PrevQuarterRegistrations"))


def mask_first_period(growth: DataFrame, period: str = "Year", cols: Iterable[str] = ()) -> DataFrame:
    """Null out the given columns on each entity's first period (group-min broadcast).

    With a positional lag the first period is already NULL; the mask states it
    explicitly and costs no extra exchange (same window partitioning).
    """
    first = F.min(period).over(Window.partitionBy("DataType", "Name"))
    out = growth
    for c in cols:
        out = out.withColumn(c, F.when(F.col(period) != first, F.col(c)))
    return out

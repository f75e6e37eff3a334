"""Dashboard views as plain filters and projections over the all-entity growth.

Order matters and is kept: the entity filter is on the window partition key
(Catalyst pushes it below the window, down to the scan), the year range is
applied *after* the lag so the first visible year keeps its growth against a
hidden year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions.text import format_count, format_pct


def filter_entity(
    df: DataFrame, data_type: str | None = None, name: str | None = None, name_col: str = "Name"
) -> DataFrame:
    """DataType == t AND <name_col> == n (either may be omitted). The store
    profile selects categories by their group column (e.g. MappedName)."""
    cond = F.lit(True)
    if data_type is not None:
        cond = cond & (F.col("DataType") == F.lit(data_type))
    if name is not None:
        cond = cond & (F.col(name_col) == F.lit(name))
    return df.where(cond)


def filter_year_range(df: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """lo <= Year <= hi, inclusive; an open bound is not applied."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col("Year") >= F.lit(int(lo)))
    if hi is not None:
        cond = cond & (F.col("Year") <= F.lit(int(hi)))
    return df.where(cond)


def drop_null_growth(df: DataFrame, growth_col: str = "QoQGrowth") -> DataFrame:
    return df.where(F.col(growth_col).isNotNull())


def growth_view_yoy(yoy: DataFrame, data_type=None, name=None, lo=None, hi=None) -> DataFrame:
    """YoY display rows: entity filter, then year range; NULL growth is kept."""
    v = filter_year_range(filter_entity(yoy, data_type, name), lo, hi)
    return v.select("DataType", "Name", "Year", "Registrations", "PrevYearRegistrations", "YoYGrowth")


def growth_view_qoq(qoq: DataFrame, data_type=None, name=None, lo=None, hi=None) -> DataFrame:
    """QoQ display rows: entity filter, year range, then NULL growth dropped."""
    v = drop_null_growth(filter_year_range(filter_entity(qoq, data_type, name), lo, hi))
    return v.select(
        "DataType",
        "Name",
        "Year",
        "Quarter",
        "QuarterYear",
        "QuarterlyRegistrations",
        "PrevQuarterRegistrations",
        "QoQGrowth",
    )


def format_growth_table(view: DataFrame, metric: str = "yoy") -> DataFrame:
    """The display table: counts as '1,234', growth as '12.34%', missing as 'nan'."""
    if metric == "yoy":
        return view.select(
            "DataType",
            "Name",
            F.col("Year").cast("string").alias("Period"),
            format_count("Registrations").alias("RegistrationsText"),
            format_count("PrevYearRegistrations").alias("PreviousText"),
            format_pct("YoYGrowth").alias("GrowthText"),
        )
    return view.select(
        "DataType",
        "Name",
        F.col("QuarterYear").alias("Period"),
        format_count("QuarterlyRegistrations").alias("RegistrationsText"),
        format_count("PrevQuarterRegistrations").alias("PreviousText"),
        format_pct("QoQGrowth").alias("GrowthText"),
    )


def trend_series(view: DataFrame, metric: str = "yoy") -> DataFrame:
    """The (x, y) series behind the trend chart, sorted by entity then x
    (quarter labels sort as text, which is right for 4-digit years)."""
    if metric == "yoy":
        s = view.select("DataType", "Name", F.col("Year").cast("string").alias("X"), F.col("YoYGrowth").alias("Y"))
    else:
        s = view.select("DataType", "Name", F.col("QuarterYear").alias("X"), F.col("QoQGrowth").alias("Y"))
    return s.orderBy("DataType", "Name", "X")

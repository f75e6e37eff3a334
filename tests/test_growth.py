"""Growth semantics on tiny inline series (traps T1-T10, T15, T17)."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.functions import CATEGORY_TYPE, MAKER_TYPE, group_name
from cadence.operators import (
    growth_view_qoq,
    growth_view_yoy,
    insights,
    mask_first_period,
    qoq_growth,
    yoy_growth,
)
from conftest import rows

ANNUAL = "Name string, DataType string, Year int, Registrations bigint"
MONTHLY = "Name string, DataType string, Year int, Month string, MonthlyRegistrations bigint"


def np_growth(cur, prev):
    """The pandas/numpy definition: ((c - p) / p) * 100, round(2), inf -> NULL."""
    if prev is None:
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        g = ((np.float64(cur) - np.float64(prev)) / np.float64(prev)) * 100
    if not np.isfinite(g):
        return None
    return float(np.round(g, 2))


def test_gap_year_lag_is_positional(spark):
    # T1: 2020 missing -> 2021 compares with 2019.
    a = spark.createDataFrame(
        [("3EV", MAKER_TYPE, y, r) for y, r in [(2016, 8), (2017, 11), (2018, 1), (2019, 1), (2021, 142)]], ANNUAL
    )
    got = rows(yoy_growth(a), "Year", "PrevYearRegistrations", "YoYGrowth")
    assert got == [
        (2016, None, None),
        (2017, 8, 37.5),
        (2018, 11, -90.91),
        (2019, 1, 0.0),
        (2021, 1, 14100.0),
    ]


def test_zero_predecessor_and_zero_profiles(spark):
    # T2/T3: Q1..Q4 = 3, 2, 0, 3; keep-zero vs drop-zero profiles.
    months = [("JAN", 3), ("APR", 2), ("JUL", 0), ("OCT", 3)]
    keep = spark.createDataFrame([("3EV", MAKER_TYPE, 2016, m, v) for m, v in months], MONTHLY)
    got = rows(qoq_growth(keep), "Quarter", "QoQGrowth")
    assert got == [(1, None), (2, -33.33), (3, -100.0), (4, None)]
    drop = keep.where(F.col("MonthlyRegistrations") > 0)
    got = rows(qoq_growth(drop), "Quarter", "QoQGrowth")
    assert got == [(1, None), (2, -33.33), (4, 50.0)]


def test_zero_over_zero_is_null(spark):
    a = spark.createDataFrame([("x", MAKER_TYPE, 2016, 0), ("x", MAKER_TYPE, 2017, 0)], ANNUAL)
    assert rows(yoy_growth(a), "Year", "YoYGrowth") == [(2016, None), (2017, None)]


@pytest.mark.parametrize(
    "prev,cur",
    [(800, 801), (8, 9), (3, 2), (7, 3), (1, 0), (6, 7), (9, 10), (11, 10), (1999, 2001), (3, 10**9)],
)
def test_rounding_matches_numpy_half_even(spark, prev, cur):
    # T4: rint(x*100)/100 on the scaled double.
    a = spark.createDataFrame([("x", MAKER_TYPE, 2000, prev), ("x", MAKER_TYPE, 2001, cur)], ANNUAL)
    got = dict(rows(yoy_growth(a), "Year", "YoYGrowth"))
    assert got[2001] == np_growth(cur, prev)


def test_range_filter_after_growth(spark):
    # T5: the first visible year keeps its growth vs the hidden year.
    a = spark.createDataFrame([("x", MAKER_TYPE, y, r) for y, r in [(2016, 10), (2017, 20), (2018, 30)]], ANNUAL)
    v = growth_view_yoy(yoy_growth(a), MAKER_TYPE, "x", 2017, 2018)
    assert rows(v, "Year", "YoYGrowth") == [(2017, 100.0), (2018, 50.0)]


def test_mapping_before_sum(spark):
    # T7: detailed categories collapse to one group row per period.
    a = spark.createDataFrame(
        [
            ("TWO WHEELER(NT)", CATEGORY_TYPE, 2016, 10),
            ("TWO WHEELER(T)", CATEGORY_TYPE, 2016, 5),
            ("TWO WHEELER(NT)", CATEGORY_TYPE, 2017, 30),
        ],
        ANNUAL,
    )
    g = a.withColumn("Name", group_name("DataType", "Name"))
    assert rows(yoy_growth(g), "Name", "Year", "Registrations", "YoYGrowth") == [
        ("2W", 2016, 15, None),
        ("2W", 2017, 30, 100.0),
    ]


def test_views_null_policy(spark):
    # T8: QoQ view drops NULL growth, YoY view keeps it.
    a = spark.createDataFrame([("x", MAKER_TYPE, 2016, 5), ("x", MAKER_TYPE, 2017, 10)], ANNUAL)
    assert len(rows(growth_view_yoy(yoy_growth(a)))) == 2
    m = spark.createDataFrame([("x", MAKER_TYPE, 2016, "JAN", 5), ("x", MAKER_TYPE, 2016, "APR", 10)], MONTHLY)
    assert rows(growth_view_qoq(qoq_growth(m)), "QuarterYear") == [("2016-Q2",)]


def test_insight_null_latest_is_stable_nan(spark):
    # T9: only one year in range -> NULL growth -> stable, prints nan%.
    a = spark.createDataFrame([("x", MAKER_TYPE, 2016, 5)], ANNUAL)
    i = insights(growth_view_yoy(yoy_growth(a)), "yoy").first()
    assert i["Trend"] == "stable" and i["LatestGrowth"] is None and i["BestGrowth"] is None
    assert i["Insight"] == (
        "The **x** shows a **stable YoY growth of nan%** in the latest available year within the selected range."
        " This indicates a relatively stable registration count compared to the previous year."
    )


def test_best_period_first_max_and_positive_only(spark):
    # T10: tie -> first period; best only if max > 0.
    a = spark.createDataFrame(
        [("x", MAKER_TYPE, y, r) for y, r in [(2016, 10), (2017, 20), (2018, 10), (2019, 20), (2020, 15)]]
        + [("y", MAKER_TYPE, y, r) for y, r in [(2016, 10), (2017, 5), (2018, 4)]],
        ANNUAL,
    )
    out = {r["Name"]: r for r in insights(growth_view_yoy(yoy_growth(a)), "yoy").collect()}
    assert out["x"]["BestGrowth"] == 100.0 and out["x"]["BestPeriod"] == "2017"
    assert out["x"]["Trend"] == "negative" and out["x"]["LatestGrowth"] == -25.0
    assert out["x"]["Insight"].endswith("\n\nIts highest YoY growth was **100.00%** in **2017**.")
    assert out["y"]["BestGrowth"] is None and out["y"]["BestPeriod"] is None
    assert "highest" not in out["y"]["Insight"]


def test_qoq_insight_text(spark):
    m = spark.createDataFrame(
        [("x", MAKER_TYPE, 2016, mo, v) for mo, v in [("JAN", 4), ("APR", 5), ("JUL", 6)]], MONTHLY
    )
    i = insights(growth_view_qoq(qoq_growth(m)), "qoq").first()
    assert i["LatestPeriod"] == "2016-Q3" and i["BestPeriod"] == "2016-Q2"
    assert i["Insight"] == (
        "The **x** shows a **positive QoQ growth of 20.00%** in the latest available quarter within the selected"
        " range. This indicates healthy sequential growth.\n\nIts highest QoQ growth was **25.00%** in **2016-Q2**."
    )


def test_null_names_never_group(spark):
    # T15
    a = spark.createDataFrame([(None, MAKER_TYPE, 2016, 5), ("x", MAKER_TYPE, 2016, 5)], ANNUAL)
    assert rows(yoy_growth(a), "Name") == [("x",)]


def test_same_name_in_both_kinds_is_two_series(spark):
    # T17: partition by (DataType, Name).
    a = spark.createDataFrame(
        [("2W", MAKER_TYPE, 2016, 10), ("2W", MAKER_TYPE, 2017, 20), ("2W", CATEGORY_TYPE, 2017, 40)], ANNUAL
    )
    got = rows(yoy_growth(a), "DataType", "Year", "YoYGrowth")
    assert got == [(MAKER_TYPE, 2016, None), (MAKER_TYPE, 2017, 100.0), (CATEGORY_TYPE, 2017, None)]


def test_first_period_mask_is_identity_on_lag(spark):
    a = spark.createDataFrame([("x", MAKER_TYPE, y, r) for y, r in [(2016, 10), (2017, 20)]], ANNUAL)
    y = yoy_growth(a)
    m = mask_first_period(y, "Year", ["PrevYearRegistrations", "YoYGrowth"])
    assert rows(m) == rows(y)


def test_growth_is_invariant_to_input_order_and_partitions(spark):
    data = [("e%d" % (i % 7), MAKER_TYPE, 2000 + (i % 11), (i * 37) % 101) for i in range(300)]
    a = spark.createDataFrame(data, ANNUAL)
    base = rows(yoy_growth(a))
    assert rows(yoy_growth(a.repartition(7))) == base
    assert rows(yoy_growth(a.orderBy(F.rand(3)).coalesce(1))) == base


def test_entity_filter_before_equals_after(spark):
    data = [("e%d" % (i % 5), MAKER_TYPE, 2000 + (i % 9), (i * 13) % 50) for i in range(200)]
    a = spark.createDataFrame(data, ANNUAL)
    after = growth_view_yoy(yoy_growth(a), MAKER_TYPE, "e3")
    before = growth_view_yoy(yoy_growth(a.where(F.col("Name") == "e3")), MAKER_TYPE, "e3")
    assert rows(after) == rows(before)


def test_guard_missing_columns_returns_empty_with_schema(spark):
    a = spark.createDataFrame([("x", MAKER_TYPE, 2016)], "Name string, DataType string, Year int")
    y = yoy_growth(a)
    assert y.count() == 0
    assert y.columns == ["DataType", "Name", "Year", "Registrations", "PrevYearRegistrations", "YoYGrowth"]
    m = spark.createDataFrame([("x", MAKER_TYPE, 2016)], "Name string, DataType string, Year int")
    assert qoq_growth(m).count() == 0


def test_unknown_month_rows_dropped(spark):
    m = spark.createDataFrame(
        [("x", MAKER_TYPE, 2016, "JAN", 3), ("x", MAKER_TYPE, 2016, "XXX", 99), ("x", MAKER_TYPE, 2016, "FEB", 1)],
        MONTHLY,
    )
    assert rows(qoq_growth(m), "QuarterlyRegistrations") == [(4,)]

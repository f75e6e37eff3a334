"""Plan shape: no Python on the growth path, pushdown, window partitioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.functions import FILE_RULES, MAKER_TYPE, group_name
from cadence.operators import growth_view_yoy, insights, qoq_growth, yoy_growth
from cadence.plans import facts
from conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_growth_plans_have_no_python_and_partitioned_windows(spark):
    fs = facts.FactSet(spark, SF_SMALL)
    a = fs.annual.withColumn("Name", group_name("DataType", "Name", FILE_RULES))
    for df in (yoy_growth(a), qoq_growth(fs.monthly()), insights(growth_view_yoy(yoy_growth(a)), "yoy")):
        p = plan(df)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p
        assert "SinglePartition" not in p
        assert "Window" in p or "ObjectHashAggregate" in p or "SortAggregate" in p or "HashAggregate" in p


def test_entity_filter_reaches_the_scan(spark, tmp_dir):
    ddl = "Name string, DataType string, Year int, Registrations bigint"
    spark.createDataFrame(
        [("A", MAKER_TYPE, 2000 + i, i) for i in range(5)] + [("B", MAKER_TYPE, 2000 + i, i) for i in range(5)], ddl
    ).write.parquet(f"{tmp_dir}/annual")
    a = spark.read.parquet(f"{tmp_dir}/annual")
    v = growth_view_yoy(yoy_growth(a), MAKER_TYPE, "A", 2001, 2003)
    p = plan(v)
    scan = [line for line in p.splitlines() if "FileScan parquet" in line][0]
    assert "EqualTo(Name,A)" in scan and "EqualTo(DataType,Manufacturer)" in scan
    # the year range must stay above the window (it is not a partition key)
    assert "GreaterThanOrEqual(Year" not in scan
    assert sorted(r["Year"] for r in v.collect()) == [2001, 2002, 2003]


def test_facts_scan_prunes_columns(spark):
    counts = facts.monthly_counts(spark, SF_SMALL)
    p = plan(counts)
    li = [line for line in p.splitlines() if "lineitem" in line and "FileScan" in line][0]
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_shipdate:timestamp_ntz>" in li


def test_window_exchange_is_on_entity_key(spark):
    fs = facts.FactSet(spark, SF_SMALL)
    y = yoy_growth(fs.annual)
    fmt = y._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(DataType" in fmt
    assert F is not None


def test_pre_aggregated_join_gives_the_same_counts(spark):
    a = facts.monthly_counts(spark, SF_SMALL)
    b = facts.monthly_counts(spark, SF_SMALL, pre_aggregate=True)
    assert sorted(a.collect()) == sorted(b.collect())
    p = plan(b)
    assert p.count("HashAggregate") >= 4  # map-side count before the join, then the cell aggregates


def test_pre_aggregation_is_chosen_when_aqe_cannot_split_skew(spark):
    before = spark.conf.get("spark.sql.adaptive.skewJoin.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
        off = plan(facts.monthly_counts(spark, SF_SMALL))
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
        on = plan(facts.monthly_counts(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", before)
    assert off.count("HashAggregate") > on.count("HashAggregate")


def test_a_selection_is_filtered_below_the_join(spark):
    from cadence.plans.registry import QUERIES

    p = plan(QUERIES["project_growth_view"](spark, SF_SMALL))
    part = [x for x in p.splitlines() if "part.parquet" in x and "FileScan" in x][0]
    line = [x for x in p.splitlines() if "lineitem.parquet" in x and "FileScan" in x][0]
    assert "EqualTo(p_brand,Brand#1)" in part and "EqualTo(l_suppkey,3)" in line
    assert "Expand" not in p  # the other kind is not computed
    view = plan(QUERIES["growth_view_yoy"](spark, SF_SMALL))
    assert "l_suppkey" not in view and "p_brand" not in view and "Expand" not in view


def test_quarters_come_straight_from_the_counts(spark):
    from cadence.plans.registry import QUERIES

    p = plan(QUERIES["qoq_growth"](spark, SF_SMALL))
    assert "counts-" not in p and p.count("Expand") <= 2  # the two kinds of the counts, no month columns
    fs = facts.FactSet(spark, SF_SMALL)
    dense = qoq_growth(fs.monthly().withColumn("Name", group_name("DataType", "Name", FILE_RULES)))
    assert sorted(dense.collect()) == sorted(QUERIES["qoq_growth"](spark, SF_SMALL).collect())

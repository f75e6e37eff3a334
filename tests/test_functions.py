"""Scalar functions: rules (T12, T13), coercion (T11), formats, names, calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.functions import (
    CATEGORY_TYPE,
    FILE_RULES,
    MAKER_TYPE,
    STORE_RULES,
    categorize,
    coerce_count,
    coerce_or_zero,
    format_count,
    format_pct,
    group_name,
    month_date,
    month_label,
    month_num,
    quarter_label,
    safe_name,
    trend_label,
)


def one_col(spark, values, expr_fn, ddl="v string"):
    df = spark.createDataFrame([(v,) for v in values], ddl)
    return [r[0] for r in df.select(expr_fn(F.col("v"))).collect()]


def py_file_rule(name):
    """Plain-Python statement of the file rule set (first match wins)."""
    s = str(name).strip().upper()
    for label, kws in FILE_RULES:
        if any(k in s for k in kws):
            return label
    return "Other"


def test_rules_first_match_trim_upper_null(spark):
    names = [
        " two wheeler(nt) ",
        "THREE WHEELER AND TWO WHEELER",
        "CONTRACTOR",
        "BUS",
        "MOTOR VEHICLE",
        "HEAVY GOODS VEHICLE",
        "EARTH MOVING EQUIPMENT",
        "CRANE",
        None,
        "",
    ]
    got = one_col(spark, names, lambda c: categorize(c, FILE_RULES))
    assert got == ["2W", "2W", "4W", "Other", "4W", "4W", "4W", "Other", "Other", "Other"]
    assert got == [py_file_rule(n if n is not None else "nan") for n in names]


def test_two_rule_sets_differ_where_expected(spark):
    names = ["BUS", "MOTOR VEHICLE", "DUMPER", "CRANE", "LIGHT MOTOR VEHICLE", "TWO WHEELER(T)"]
    f = one_col(spark, names, lambda c: categorize(c, FILE_RULES))
    s = one_col(spark, names, lambda c: categorize(c, STORE_RULES))
    assert f == ["Other", "4W", "Other", "Other", "4W", "2W"]
    assert s == ["4W", "Other", "4W", "4W", "4W", "2W"]


def test_custom_rules_and_fallback(spark):
    rules = [("A", ["apple"]), ("B", ["Ban"])]
    got = one_col(spark, ["Apple pie", "banana", "cherry"], lambda c: categorize(c, rules, fallback="Z"))
    assert got == ["A", "B", "Z"]


def test_group_name_only_for_category_rows(spark):
    df = spark.createDataFrame(
        [("TWO WHEELER(NT)", CATEGORY_TYPE), ("TWO WHEELER(NT)", MAKER_TYPE)], "Name string, DataType string"
    )
    got = [r[0] for r in df.select(group_name("DataType", "Name")).collect()]
    assert got == ["2W", "TWO WHEELER(NT)"]


def test_coerce_or_zero(spark):
    cells = ["12", " 12 ", "12.5", "1,234", "-", "", None, "NaN", "abc", "-3"]
    assert one_col(spark, cells, coerce_or_zero) == [12.0, 12.0, 12.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -3.0]
    assert one_col(spark, cells, coerce_count) == [12, 12, 12, 0, 0, 0, 0, 0, 0, -3]


def test_formats(spark):
    assert one_col(spark, [1234567, 0, None], format_count, "v bigint") == ["1,234,567", "0", "nan"]
    assert one_col(spark, [12.5, -0.29, 14100.0, None], format_pct, "v double") == [
        "12.50%",
        "-0.29%",
        "14100.00%",
        "nan%",
    ]


def test_trend_label(spark):
    assert one_col(spark, [1.0, -1.0, 0.0, None], trend_label, "v double") == [
        "positive",
        "negative",
        "stable",
        "stable",
    ]


def test_safe_name(spark):
    got = one_col(spark, ["Maker / Month Wise 2024", "ÉtéÅ-1", "a_b.c"], safe_name)
    py = ["".join(ch if ch.isalnum() else "_" for ch in s) for s in ["Maker / Month Wise 2024", "ÉtéÅ-1", "a_b.c"]]
    assert got == py


def test_calendar(spark):
    assert one_col(spark, ["JAN", "DEC", "XXX", None], month_num) == [1, 12, None, None]
    assert one_col(spark, [1, 12, 13], month_label, "v int") == ["JAN", "DEC", None]
    df = spark.createDataFrame([(2024, 2), (2024, 13), (None, 1)], "y int, m int")
    got = [r[0] for r in df.select(month_date("y", "m")).collect()]
    assert [str(x) if x else None for x in got] == ["2024-02-01", None, None]
    df = spark.createDataFrame([(2024, 1)], "y int, q int")
    assert df.select(quarter_label("y", "q")).first()[0] == "2024-Q1"

"""SQL functions give what the DataFrame views give; the chosen entity is a filter on the facts."""

from __future__ import annotations

import pytest

from cadence import app, sql
from cadence.functions import CATEGORY_TYPE, MAKER_TYPE, categorize
from cadence.functions.rules import FILE_RULES
from conftest import rows
from test_sources import MONTHS12, monthly_report, write


@pytest.fixture()
def facts(spark, tmp_dir):
    for y in (2020, 2022, 2023):
        monthly_report(tmp_dir, "Maker", y, MONTHS12, [("A", [y % 7 + i for i in range(12)]), ("B", [0] * 12)])
        monthly_report(tmp_dir, "Vehicle_Category", y, MONTHS12[:8], [("TWO WHEELER(NT)", [7] * 8), ("BUS", [y - 2020] * 8)])
        write(f"{tmp_dir}/Y_Maker_X_Calendar_Year_Year_{y}.csv", [f"Maker_Maker,Calendar Year_{y}", f"A,{y % 5}", "B,0"])
    return tmp_dir


@pytest.mark.parametrize("profile", [app.FILE_PROFILE, app.STORE_PROFILE])
def test_table_functions(spark, facts, profile):
    loaded = app.load_facts(spark, facts, profile)
    sql.register(spark, loaded)
    for kind, name, span in ((MAKER_TYPE, None, None), (MAKER_TYPE, "A", (2021, 2023)), (CATEGORY_TYPE, "2W", (2022, 2022)), (MAKER_TYPE, "nobody", None)):
        for metric in ("yoy", "qoq"):
            lo, hi = span or (None, None)
            got = spark.sql(f"SELECT * FROM growth_{metric}(:k, :n, :lo, :hi)", {"k": kind, "n": name, "lo": lo, "hi": hi})
            want = app.growth_report(loaded, kind, metric, name, span).view
            assert got.columns == want.columns and rows(got) == rows(want)
    assert spark.sql("SELECT * FROM growth_yoy()").count() == app.growth_report(loaded, MAKER_TYPE).view.count() + app.growth_report(loaded, CATEGORY_TYPE).view.count()


def test_choice_reaches_the_facts(spark, facts):
    sql.register(spark, app.load_facts(spark, facts))
    plan = spark.sql("SELECT * FROM growth_yoy('Manufacturer', 'A')")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("= Manufacturer")


def test_rule_functions(spark):
    sql.register_rules(spark, "my_group", (("X", ("o'b", "bus")), ("Y", ())), "none")
    got = spark.sql("SELECT my_group('an O''B'), my_group(' bus '), my_group('tram'), my_group(NULL)").first()
    assert tuple(got) == ("X", "X", "none", "none")
    sql.register_rules(spark, "shipped", FILE_RULES)
    texts = spark.createDataFrame([("TWO WHEELER(NT)",), ("trac",), (None,), ("",)], "t string")
    texts.createOrReplaceTempView("texts")
    assert rows(spark.sql("SELECT t, shipped(t) AS g FROM texts")) == rows(texts.withColumn("g", categorize("t", FILE_RULES)))
    with pytest.raises(ValueError):
        sql.register_rules(spark, "bad name; DROP", FILE_RULES)

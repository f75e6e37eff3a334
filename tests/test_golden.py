"""Golden values on the 40 sample report files (FIXTURES.md).

Set CADENCE_SAMPLE_REPORTS to the folder holding those CSV files to run these
tests; the files are only read as input data.
"""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from cadence.functions import CATEGORY_TYPE, FILE_RULES, MAKER_TYPE, STORE_RULES, group_name
from cadence.operators import growth_view_yoy, insights, qoq_growth, yoy_growth
from cadence.sources import wide_csv
from conftest import rows

SAMPLE_DIR = os.environ.get("CADENCE_SAMPLE_REPORTS", "")
pytestmark = pytest.mark.skipif(not os.path.isdir(SAMPLE_DIR or "/nonexistent"), reason="set CADENCE_SAMPLE_REPORTS")

# Golden YoY by category group: year -> (registrations, growth) for 2W, 3W, 4W, Other.
GOLDEN = {
    2016: [(16496980, None), (548995, None), (4229129, None), (47409, None)],
    2017: [(18077900, 9.58), (570612, 3.94), (4608407, 8.97), (47058, -0.74)],
    2018: [(19591696, 8.37), (771232, 35.16), (5019249, 8.92), (40908, -13.07)],
    2019: [(18657112, -4.77), (772967, 0.22), (4685017, -6.66), (43115, 5.40)],
    2020: [(14315176, -23.27), (406609, -47.40), (3872105, -17.35), (40014, -7.19)],
    2021: [(13934782, -2.66), (397924, -2.14), (4528713, 16.96), (49814, 24.49)],
    2022: [(15598507, 11.94), (683990, 71.89), (5245217, 15.82), (50484, 1.35)],
    2023: [(17097320, 9.61), (1105450, 61.62), (5735533, 9.35), (70260, 39.17)],
    2024: [(18940009, 10.78), (1221861, 10.53), (5966665, 4.03), (80833, 15.05)],
    2025: [(11208634, -40.82), (762216, -37.62), (3814732, -36.07), (54784, -32.23)],
}
GROUPS = ["2W", "3W", "4W", "Other"]


@pytest.fixture(scope="module")
def loaded(spark):
    a = wide_csv.load_reports(spark, SAMPLE_DIR, "annual")
    m = wide_csv.load_reports(spark, SAMPLE_DIR, "monthly")
    a_s = wide_csv.load_reports(spark, SAMPLE_DIR, "annual", keep_zero=False)
    m_s = wide_csv.load_reports(spark, SAMPLE_DIR, "monthly", keep_zero=False)
    return a.facts.cache(), m.facts.cache(), a_s.facts.cache(), m_s.facts.cache(), a.rejects, m.rejects


def test_counts(loaded):
    a, m, a_s, m_s, ra, rm = loaded
    assert (a.count(), m.count(), a_s.count(), m_s.count()) == (414, 4800, 406, 3574)
    assert ra.count() == 0 and rm.count() == 0
    assert a.where(F.col("DataType") == MAKER_TYPE).count() == 250
    assert m.where(F.col("DataType") == MAKER_TYPE).count() == 2900


def test_category_yoy_goldens(loaded):
    a = loaded[0].withColumn("Name", group_name("DataType", "Name", FILE_RULES))
    y = yoy_growth(a).where(F.col("DataType") == CATEGORY_TYPE)
    got = {(r["Name"], r["Year"]): (r["Registrations"], r["YoYGrowth"]) for r in y.collect()}
    for year, vals in GOLDEN.items():
        for g, v in zip(GROUPS, vals):
            assert got[(g, year)] == v, (g, year)


def test_store_rules_agree_on_sample_names(loaded):
    a = loaded[0].where(F.col("DataType") == CATEGORY_TYPE)
    f = a.select(group_name("DataType", "Name", FILE_RULES).alias("f"), group_name("DataType", "Name", STORE_RULES).alias("s"))
    assert f.where(F.col("f") != F.col("s")).count() == 0


def test_gap_and_zero_maker(loaded):
    a, m, a_s, m_s = loaded[:4]
    name = "3EV INDUSTRIES PVT LTD"
    y = yoy_growth(a.where(F.col("Name") == name))
    assert rows(y, "Year", "Registrations", "YoYGrowth")[:5] == [
        (2016, 8, None),
        (2017, 11, 37.5),
        (2018, 1, -90.91),
        (2019, 1, 0.0),
        (2021, 142, 14100.0),
    ]
    q_keep = qoq_growth(m.where(F.col("Name") == name)).where("Year = 2016")
    assert rows(q_keep, "Quarter", "QuarterlyRegistrations", "QoQGrowth") == [
        (1, 3, None),
        (2, 2, -33.33),
        (3, 0, -100.0),
        (4, 3, None),
    ]
    q_drop = qoq_growth(m_s.where(F.col("Name") == name)).where("Year = 2016")
    assert rows(q_drop, "Quarter", "QoQGrowth") == [(1, None), (2, -33.33), (4, 50.0)]


def test_qoq_samples_and_insights(loaded):
    m = loaded[1].withColumn("Name", group_name("DataType", "Name", FILE_RULES))
    q = qoq_growth(m).where(F.col("DataType") == CATEGORY_TYPE)
    got = {(r["Name"], r["QuarterYear"]): (r["QuarterlyRegistrations"], r["QoQGrowth"]) for r in q.collect()}
    assert got[("2W", "2016-Q2")] == (4220077, 6.09)
    assert got[("3W", "2025-Q3")] == (156771, -48.57)
    assert got[("4W", "2016-Q2")] == (1029967, -7.65)
    assert got[("Other", "2025-Q3")] == (6156, -72.19)
    a = loaded[0].withColumn("Name", group_name("DataType", "Name", FILE_RULES))
    ins = {r["Name"]: r for r in insights(growth_view_yoy(yoy_growth(a), CATEGORY_TYPE), "yoy").collect()}
    assert (ins["2W"]["Trend"], ins["2W"]["LatestGrowth"], ins["2W"]["BestPeriod"]) == ("negative", -40.82, "2022")
    assert (ins["3W"]["BestGrowth"], ins["3W"]["BestPeriod"]) == (71.89, "2022")
    assert (ins["4W"]["BestGrowth"], ins["4W"]["BestPeriod"]) == (16.96, "2021")
    assert (ins["Other"]["BestGrowth"], ins["Other"]["BestPeriod"]) == (39.17, "2023")


def test_app_file_and_store_profiles(spark, tmp_dir, capsys):
    from cadence import app
    from cadence.__main__ import main

    facts = app.load_facts(spark, SAMPLE_DIR, app.FILE_PROFILE)
    rep = app.growth_report(facts, CATEGORY_TYPE, "yoy", "3W", (2017, 2022))
    assert rows(rep.view, "Year", "YoYGrowth") == [
        (2017, 3.94), (2018, 35.16), (2019, 0.22), (2020, -47.4), (2021, -2.14), (2022, 71.89)
    ]
    assert rows(rep.table, "Period", "GrowthText")[0] == ("2017", "3.94%")
    assert [r[0] for r in app.entity_choices(facts, CATEGORY_TYPE).collect()] == ["2W", "3W", "4W", "Other"]
    store_dir = f"{tmp_dir}/store"
    assert app.build_store(spark, SAMPLE_DIR, store_dir).rejects.count() == 0
    sfacts = app.load_store(spark, store_dir)
    assert (sfacts.annual.count(), sfacts.monthly.count()) == (406, 3574)
    srep = app.growth_report(sfacts, MAKER_TYPE, "qoq", "3EV INDUSTRIES PVT LTD", (2016, 2016))
    assert rows(srep.view, "Quarter", "QoQGrowth") == [(2, -33.33), (4, 50.0)]
    srep = app.growth_report(sfacts, CATEGORY_TYPE, "yoy", "4W")
    assert dict(rows(srep.view, "Year", "YoYGrowth"))[2021] == 16.96
    assert main(["report", SAMPLE_DIR, "--type", CATEGORY_TYPE, "--metric", "yoy", "--name", "2W"]) == 0
    out = capsys.readouterr().out
    assert "The **2W** shows a **negative YoY growth of -40.82%**" in out

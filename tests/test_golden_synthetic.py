"""Golden values on a small set of synthetic reports that hold the traps of real ones.

A maker with a gap year and a zero quarter, a partial last year, a category
row that only the store rules map, a report listed twice, names with signs.
"""

from __future__ import annotations

import pytest

from cadence import app
from cadence.__main__ import main
from cadence.functions import CATEGORY_TYPE, MAKER_TYPE
from conftest import rows
from test_sources import MONTHS12, monthly_report, write

ANNUAL = {  # year -> maker, category cells
    2016: ({"GAP CO": 8, "A.B. & SONS": 100}, {"TWO WHEELER(NT)": 1000, "BUS": 10, "LIGHT MOTOR VEHICLE": 50}),
    2017: ({"GAP CO": 11, "A.B. & SONS": 0}, {"TWO WHEELER(NT)": 1100, "BUS": 12, "LIGHT MOTOR VEHICLE": 40}),
    2018: ({"GAP CO": 1, "A.B. & SONS": 7}, {"TWO WHEELER(NT)": 990, "TWO WHEELER(T)": 110, "LIGHT MOTOR VEHICLE": 60}),
    2020: ({"GAP CO": 142}, {"TWO WHEELER(NT)": 825, "BUS": 9}),
}
GAP_2016 = [1, 1, 1, 2, 0, 0, 0, 0, 0, 1, 1, 1]


@pytest.fixture()
def reports(tmp_dir):
    for year, (makers, cats) in ANNUAL.items():
        for kind, col, cells in (("Maker", "Maker_Maker", makers), ("Vehicle_Category", "Vehicle Category_Vehicle Category", cats)):
            lines = [f"S No_S No,{col},Calendar Year_{year},TOTAL_TOTAL"]
            lines += [f"{i},{name},{n},{n}" for i, (name, n) in enumerate(cells.items(), 1)]
            write(f"{tmp_dir}/r/Y_{kind}_X_Calendar_Year_Year_{year}.csv", lines)
    monthly_report(f"{tmp_dir}/r", "Maker", 2016, MONTHS12, [("GAP CO", GAP_2016)])
    monthly_report(f"{tmp_dir}/r", "Maker", 2017, MONTHS12[:8], [("GAP CO", [2] * 8)])
    return f"{tmp_dir}/r"


def test_file_profile(spark, reports):
    facts = app.load_facts(spark, reports)
    assert (facts.annual.count(), facts.monthly.count(), facts.rejects.count()) == (7 + 11, 20, 0)
    gap = app.growth_report(facts, MAKER_TYPE, "yoy", "GAP CO").view
    assert rows(gap, "Year", "Registrations", "YoYGrowth") == [
        (2016, 8, None), (2017, 11, 37.5), (2018, 1, -90.91), (2020, 142, 14100.0),  # the year before 2020 is 2018
    ]
    zero = app.growth_report(facts, MAKER_TYPE, "yoy", "A.B. & SONS").view
    assert rows(zero, "Year", "YoYGrowth") == [(2016, None), (2017, -100.0), (2018, None)]  # nothing grows from zero
    q = app.growth_report(facts, MAKER_TYPE, "qoq", "GAP CO").view
    assert rows(q, "QuarterYear", "QuarterlyRegistrations", "QoQGrowth") == [
        ("2016-Q2", 2, -33.33), ("2016-Q3", 0, -100.0), ("2017-Q1", 6, 100.0), ("2017-Q2", 6, 0.0), ("2017-Q3", 4, -33.33),
    ]
    two = app.growth_report(facts, CATEGORY_TYPE, "yoy", "2W", (2017, 2020))
    assert rows(two.view, "Year", "Registrations", "YoYGrowth") == [(2017, 1100, 10.0), (2018, 1100, 0.0), (2020, 825, -25.0)]
    assert rows(two.insight, "Trend", "LatestGrowth", "BestPeriod", "BestGrowth") == [("negative", -25.0, "2017", 10.0)]
    bus = app.growth_report(facts, CATEGORY_TYPE, "yoy", "Other").view  # the file rules know no BUS
    assert rows(bus, "Year", "Registrations") == [(2016, 10), (2017, 12), (2020, 9)]


def test_store_profile_and_command_line(spark, reports, tmp_dir, capsys):
    write(  # 2016 once more, under a later name: refused whole
        f"{reports}/Y_Maker_X_Calendar_Year_Year_2016.csv_copy_Year_2016.csv",
        ["S No_S No,Maker_Maker,Calendar Year_2016,TOTAL_TOTAL", "1,GAP CO,9,9", "2,NEW,1,1"],
    )
    built = app.build_store(spark, reports, f"{tmp_dir}/store")
    assert rows(built.rejects, "Report") == [("Y_Maker_X_Calendar_Year_Year_2016.csv_copy_Year_2016.csv",)]
    facts = app.load_store(spark, f"{tmp_dir}/store")
    assert (facts.annual.count(), facts.monthly.count()) == (6 + 11, 20 - 5)  # zero counts are no store facts
    q = app.growth_report(facts, MAKER_TYPE, "qoq", "GAP CO", (2016, 2016)).view
    assert rows(q, "Quarter", "QoQGrowth") == [(2, -33.33), (4, 50.0)]
    four = app.growth_report(facts, CATEGORY_TYPE, "yoy", "4W").view  # the store rules do
    assert rows(four, "Year", "Registrations", "YoYGrowth") == [(2016, 60, None), (2017, 52, -13.33), (2018, 60, 15.38), (2020, 9, -85.0)]
    assert main(["report", reports, "--type", CATEGORY_TYPE, "--metric", "yoy", "--name", "2W"]) == 0
    out = capsys.readouterr().out
    assert "The **2W** shows a **negative YoY growth of -25.00%**" in out and "2018" in out
    assert main(["report", reports, "--type", CATEGORY_TYPE, "--metric", "yoy", "--name", "2W", "--from", "2030"]) == 0
    assert app.R_NO_DATA in capsys.readouterr().out

"""User flows on small synthetic report folders."""

from __future__ import annotations

from cadence import app
from cadence.functions import CATEGORY_TYPE, MAKER_TYPE
from conftest import rows
from test_sources import MONTHS12, monthly_report, write


def _reports(d):
    write(
        f"{d}/Y_Vehicle_Category_X_Calendar_Year_Year_2020.csv",
        ["S No_S No,Vehicle Category_Vehicle Category,Calendar Year_2020,TOTAL_TOTAL", "1,CRANE,5,5", "2,BUS,3,3"],
    )
    write(
        f"{d}/Y_Maker_X_Calendar_Year_Year_2021.csv",
        ["S No_S No,Maker_Maker,Calendar Year_2021,TOTAL_TOTAL", "1,ZETA,1,1", "2,ALPHA,0,0"],
    )
    monthly_report(d, "Maker", 2019, MONTHS12[:2], [("ALPHA", [1, 2])])


def test_entity_choices_default_groups_and_bounds(spark, tmp_dir):
    _reports(tmp_dir)
    facts = app.load_facts(spark, tmp_dir)  # file profile: CRANE and BUS are both 'Other'
    assert [r[0] for r in app.entity_choices(facts, CATEGORY_TYPE).collect()] == ["2W", "3W", "4W", "Other"]
    assert [r[0] for r in app.entity_choices(facts, MAKER_TYPE).collect()] == ["ALPHA", "ZETA"]
    assert rows(app.year_range_default(facts, current_year=2018)) == [(2018, 2021)]
    assert rows(app.year_range_default(facts, current_year=2030)) == [(2019, 2030)]
    annual_head, monthly_head = app.previews(facts, 2)
    assert [r["Name"] for r in annual_head.collect()] == ["ALPHA", "ZETA"]
    assert monthly_head.count() == 2


def test_store_profile_groups_differ(spark, tmp_dir):
    _reports(tmp_dir)
    store = f"{tmp_dir}/store"
    app.build_store(spark, tmp_dir, store)
    sfacts = app.load_store(spark, store)  # store rules: CRANE and BUS are 4W; zero rows dropped
    assert [r[0] for r in app.entity_choices(sfacts, CATEGORY_TYPE).collect()] == ["4W"]
    assert rows(sfacts.annual.where("DataType = 'Manufacturer'"), "Name") == [("ZETA",)]
    rep = app.growth_report(sfacts, CATEGORY_TYPE, "yoy", "4W")
    assert rows(rep.view, "Year", "Registrations", "YoYGrowth") == [(2020, 8, None)]

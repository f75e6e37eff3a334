"""Wide report loader (header drift, rejects, T11, T18, T19), reshape, store."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from cadence.functions import CATEGORY_TYPE, MAKER_TYPE
from cadence.operators import clean_numeric, flatten_columns, unpivot_annual, unpivot_monthly
from cadence.sources import wide_csv
from cadence.sources.store import R_DUP_IN_BATCH, R_KEY_EXISTS, FactStore
from conftest import rows

MONTHS12 = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("\n".join(lines) + "\n")


def monthly_report(d, kind, year, months, rows_):
    ent = "Maker_Maker" if kind == "Maker" else "Vehicle Category_Vehicle Category"
    header = ["S No_S No", ent] + [f"Month Wise_{m}" for m in months] + ["TOTAL_TOTAL"]
    lines = [",".join(header)]
    for i, (name, vals) in enumerate(rows_, 1):
        lines.append(",".join([str(i), name] + [str(v) for v in vals] + [str(sum(int(v) for v in vals))]))
    write(f"{d}/Y_{kind}_X_Month_Wise_Year_{year}.csv", lines)


def test_header_drift_12_and_8_months(spark, tmp_dir):
    monthly_report(tmp_dir, "Maker", 2024, MONTHS12, [("A", list(range(1, 13))), ("B", [0] * 12)])
    monthly_report(tmp_dir, "Maker", 2025, MONTHS12[:8], [("A", [5] * 8)])
    monthly_report(tmp_dir, "Vehicle_Category", 2025, MONTHS12[:8], [("TWO WHEELER(NT)", [7] * 8)])
    loaded = wide_csv.load_reports(spark, tmp_dir, "monthly")
    f = loaded.facts
    assert f.count() == 12 + 12 + 8 + 8
    # TOTAL never read as a month (position binding across files would do that)
    assert rows(f.where((F.col("Year") == 2025) & (F.col("Name") == "A")).agg(F.sum("MonthlyRegistrations"))) == [
        (40,)
    ]
    assert rows(f.where(F.col("Name") == "B").agg(F.sum("MonthlyRegistrations"))) == [(0,)]
    assert rows(f.select("DataType").distinct()) == [(MAKER_TYPE,), (CATEGORY_TYPE,)]
    assert loaded.rejects.count() == 0
    # store profile drops the zero rows
    store = wide_csv.load_reports(spark, tmp_dir, "monthly", keep_zero=False).facts
    assert store.count() == 12 + 8 + 8


def test_property_months_sum_to_total(spark, tmp_dir):
    monthly_report(tmp_dir, "Maker", 2020, MONTHS12, [(f"M{i}", [(i * j) % 17 for j in range(12)]) for i in range(9)])
    f = wide_csv.load_reports(spark, tmp_dir, "monthly").facts
    sums = dict(rows(f.groupBy("Name").agg(F.sum("MonthlyRegistrations"))))
    assert sums == {f"M{i}": sum((i * j) % 17 for j in range(12)) for i in range(9)}


def test_bad_cells_and_unknown_month(spark, tmp_dir):
    write(
        f"{tmp_dir}/Y_Maker_X_Month_Wise_Year_2024.csv",
        [
            "S No_S No,Maker_Maker,Month Wise_JAN,Month Wise_FEB,Month Wise_XXX,TOTAL_TOTAL",
            '1,A,"1,234",-,5,0',
            "2,B, 12 ,12.5,5,0",
            "3,C,,abc,5,0",
            "4,,3,3,5,0",
        ],
    )
    f = wide_csv.load_reports(spark, tmp_dir, "monthly").facts
    got = rows(f, "Name", "Month", "MonthlyRegistrations")
    # NULL names are kept by the file profile; 'XXX' rows are dropped (unknown month);
    # '1,234', '-', '' and 'abc' are 0; ' 12 ' is 12; 12.5 truncates to 12.
    assert got == [
        (None, "FEB", 3),
        (None, "JAN", 3),
        ("A", "FEB", 0),
        ("A", "JAN", 0),
        ("B", "FEB", 12),
        ("B", "JAN", 12),
        ("C", "FEB", 0),
        ("C", "JAN", 0),
    ]
    s = wide_csv.load_reports(spark, tmp_dir, "monthly", keep_zero=False).facts
    assert rows(s, "Name", "Month") == [("B", "FEB"), ("B", "JAN")]


def test_rejects_and_annual_multi_year(spark, tmp_dir):
    write(
        f"{tmp_dir}/Y_Maker_X_Calendar_Year_Year_2024.csv",
        ["S No_S No,Maker_Maker,Calendar Year_2023,Calendar Year_2024,TOTAL_TOTAL", "1,A,3,4,7", "2,B,0,2,2"],
    )
    write(f"{tmp_dir}/Y_Fuel_X_Calendar_Year_Year_2024.csv", ["S No_S No,Fuel_Fuel,Calendar Year_2024", "1,P,1"])
    write(f"{tmp_dir}/Y_Maker_X_Calendar_Year_Year_2023.csv", ["S No_S No,Other,Calendar Year_2023", "1,P,1"])
    write(f"{tmp_dir}/Y_Maker_X_Calendar_Year_Year_2022.csv", ["S No_S No,Maker_Maker,TOTAL_TOTAL", "1,P,1"])
    write(f"{tmp_dir}/Y_Maker_X_Calendar_Year_Year_2021.csv", [""])
    write(f"{tmp_dir}/notes.txt", ["ignored"])
    loaded = wide_csv.load_reports(spark, tmp_dir, "annual")
    assert rows(loaded.facts, "Name", "Year", "Registrations") == [
        ("A", 2023, 3),
        ("A", 2024, 4),
        ("B", 2023, 0),
        ("B", 2024, 2),
    ]
    assert rows(loaded.rejects) == [
        ("Y_Fuel_X_Calendar_Year_Year_2024.csv", wide_csv.R_UNKNOWN_KIND),
        ("Y_Maker_X_Calendar_Year_Year_2021.csv", wide_csv.R_EMPTY),
        ("Y_Maker_X_Calendar_Year_Year_2022.csv", wide_csv.R_NO_PERIODS),
        ("Y_Maker_X_Calendar_Year_Year_2023.csv", wide_csv.R_NO_ENTITY),
    ]


def test_monthly_year_from_name_required(spark, tmp_dir):
    write(
        f"{tmp_dir}/Y_Maker_X_Month_Wise_Year_latest.csv",
        ["S No_S No,Maker_Maker,Month Wise_JAN,TOTAL_TOTAL", "1,A,1,1"],
    )
    loaded = wide_csv.load_reports(spark, tmp_dir, "monthly")
    assert loaded.facts.count() == 0
    assert rows(loaded.rejects) == [("Y_Maker_X_Month_Wise_Year_latest.csv", wide_csv.R_NO_YEAR)]


def test_write_then_load_roundtrip_spark_folders(spark, tmp_dir):
    wide = spark.createDataFrame(
        [(MAKER_TYPE, "A", 2024, 1, 2, None, 3), (MAKER_TYPE, "B", 2024, 0, 5, None, 5)],
        "DataType string, Name string, Year int, `Month Wise_JAN` bigint, `Month Wise_FEB` bigint, "
        "`Month Wise_MAR` bigint, TOTAL_TOTAL bigint",
    )
    names = wide_csv.write_reports(wide, tmp_dir, "monthly")
    assert names == ["Y_Maker_X_Month_Wise_Year_2024.csv"]
    f = wide_csv.load_reports(spark, tmp_dir, "monthly").facts
    assert rows(f, "Name", "Month", "MonthlyRegistrations") == [
        ("A", "FEB", 2),
        ("A", "JAN", 1),
        ("B", "FEB", 5),
        ("B", "JAN", 0),
    ]


def test_unpivot_and_flatten_and_clean(spark):
    wide = spark.createDataFrame(
        [("A", "1", "2", "3"), ("B", None, "x", "2")],
        "Name string, `Month Wise_JAN` string, `Month Wise_FEB` string, TOTAL_TOTAL string",
    )
    assert rows(unpivot_monthly(wide), "Name", "Month", "MonthlyRegistrations") == [
        ("A", "FEB", 2),
        ("A", "JAN", 1),
        ("B", "FEB", 0),
        ("B", "JAN", 0),
    ]
    assert len(rows(unpivot_monthly(wide, keep_null_cells=False))) == 3
    ann = spark.createDataFrame([("A", 1, 2)], "Name string, `Calendar Year_2023` int, `Calendar Year_2024` int")
    assert rows(unpivot_annual(ann), "Name", "Year", "Registrations") == [("A", 2023, 1), ("A", 2024, 2)]
    nested = spark.createDataFrame([((1, "x"), 5)], "s struct<a:int, b:string>, ` c ` int")
    assert flatten_columns(nested).columns == ["s_a", "s_b", "c"]
    txt = spark.createDataFrame(
        [("1,234", " 7 ", "a", "1.5"), ("2", "8", "b", "")], "p string, q string, r string, s string"
    )
    out = clean_numeric(txt)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["bigint", "bigint", "string", "double"]
    assert rows(out) == [(2, 8, "b", None), (1234, 7, "a", 1.5)]


def test_store_strict_skip_idempotent(spark, tmp_dir):
    ddl = "Name string, DataType string, Year int, Month string, MonthlyRegistrations bigint"
    first = spark.createDataFrame([("A", MAKER_TYPE, 2024, "JAN", 1), ("A", MAKER_TYPE, 2024, "FEB", 2)], ddl)
    store = FactStore.monthly(spark, f"{tmp_dir}/monthly")
    store.create(first)
    batch = spark.createDataFrame(
        [
            ("A", MAKER_TYPE, 2024, "FEB", 9),  # exists
            ("A", MAKER_TYPE, 2024, "MAR", 3),  # new
            ("B", MAKER_TYPE, 2024, "JAN", 4),  # duplicated in batch
            ("B", MAKER_TYPE, 2024, "JAN", 5),
        ],
        ddl,
    )
    conf = rows(store.conflicts(batch))
    assert conf == [("A", MAKER_TYPE, 2024, "FEB", R_KEY_EXISTS), ("B", MAKER_TYPE, 2024, "JAN", R_DUP_IN_BATCH)]
    res = store.append(batch, on_conflict="refuse")
    assert not res.appended and store.read().count() == 2
    res = store.append(batch, on_conflict="skip")  # of a key repeated in the batch the least row is taken
    assert rows(store.read(), "Month", "MonthlyRegistrations") == [("FEB", 2), ("JAN", 1), ("JAN", 4), ("MAR", 3)]
    assert rows(res.dropped, "Name", "Month", "MonthlyRegistrations", "Reason") == [
        ("A", "FEB", 9, R_KEY_EXISTS),
        ("B", "JAN", 5, R_DUP_IN_BATCH),
    ]
    store.append(batch, on_conflict="skip")  # a re-run appends nothing twice
    assert store.read().count() == 4
    empty = spark.createDataFrame([], ddl)
    assert store.append(empty, on_conflict="refuse").appended
    assert store.read().count() == 4
    with pytest.raises(ValueError):
        store.append(batch, on_conflict="merge")


def test_store_create_if_missing_keeps_data(spark, tmp_dir):
    ddl = "Name string, DataType string, Year int, Registrations bigint"
    store = FactStore.annual(spark, f"{tmp_dir}/annual")
    store.create(spark.createDataFrame([("A", MAKER_TYPE, 2024, 1)], ddl))
    store.create(spark.createDataFrame([("B", MAKER_TYPE, 2024, 1)], ddl), replace=False)
    assert rows(store.read(), "Name") == [("A",)]
    store.create(spark.createDataFrame([("B", MAKER_TYPE, 2024, 1)], ddl), replace=True)
    assert rows(store.read(), "Name") == [("B",)]


def test_store_writes_are_sized_by_bytes(spark, tmp_dir):
    import glob

    ddl = "Name string, DataType string, Year int, Registrations bigint"
    data = [(f"M{i}", MAKER_TYPE, 2020 + (i % 7 == 0), i) for i in range(40_000)]
    small = FactStore.annual(spark, f"{tmp_dir}/small")
    small.create(spark.createDataFrame(data, ddl).repartition(40))
    for folder in glob.glob(f"{tmp_dir}/small/DataType=*/Year=*"):
        assert len(glob.glob(f"{folder}/*.parquet")) == 1  # forty tasks' rows, one small file
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
            "spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k"}  # many tasks to read, as at scale
    was = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        large = FactStore.annual(spark, f"{tmp_dir}/large")
        large.create(spark.createDataFrame(data, ddl).repartition(40))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(glob.glob(f"{tmp_dir}/large/DataType=*/Year=2020/*.parquet")) > 8  # a hot folder is split
    assert large.read().count() == small.read().count() == 40_000


def test_store_create_refuses_repeated_keys_and_missing_tables_are_empty(spark, tmp_dir):
    from cadence import app

    ddl = "Name string, DataType string, Year int, Registrations bigint"
    store = FactStore.annual(spark, f"{tmp_dir}/annual_registrations")
    with pytest.raises(ValueError, match="repeat a key"):
        store.create(spark.createDataFrame([("A", MAKER_TYPE, 2024, 1), ("A", MAKER_TYPE, 2024, 2)], ddl))
    assert store.read().count() == 0
    store.create(spark.createDataFrame([("A", MAKER_TYPE, 2023, 1), ("A", MAKER_TYPE, 2024, 2)], ddl))
    facts = app.load_store(spark, tmp_dir)
    assert facts.annual.count() == 2 and facts.monthly.count() == 0
    assert rows(facts.warnings) == [("monthly_registrations", app.R_NO_TABLE)]
    rep = app.growth_report(facts, MAKER_TYPE, "yoy")
    assert [r["Year"] for r in rep.view.collect()] == [2023, 2024] and rep.notice.count() == 0
    assert rows(app.growth_report(facts, MAKER_TYPE, "yoy", "nobody").notice) == [(app.R_NO_DATA,)]


def test_append_creates_missing_store(spark, tmp_dir):
    ddl = "Name string, DataType string, Year int, Registrations bigint"
    store = FactStore.annual(spark, f"{tmp_dir}/fresh")
    res = store.append(spark.createDataFrame([("A", MAKER_TYPE, 2024, 1)], ddl), on_conflict="refuse")
    assert res.appended and rows(store.read(), "Name") == [("A",)]


def test_unique_reports_first_report_wins(spark, tmp_dir):
    write(
        f"{tmp_dir}/Y_Maker_X_Calendar_Year_Year_2023.csv",
        ["S No_S No,Maker_Maker,Calendar Year_2023,TOTAL_TOTAL", "1,A,3,3", "2,B,4,4"],
    )
    write(  # repeats (A, 2023) from the report above -> refused whole
        f"{tmp_dir}/Y_Maker_X_Calendar_Year_Year_2024.csv",
        ["S No_S No,Maker_Maker,Calendar Year_2023,Calendar Year_2024,TOTAL_TOTAL", "1,A,9,5,14", "2,C,1,1,2"],
    )
    write(  # a key twice inside one report -> refused whole
        f"{tmp_dir}/Y_Vehicle_Category_X_Calendar_Year_Year_2024.csv",
        ["S No_S No,Vehicle Category_Vehicle Category,Calendar Year_2024,TOTAL_TOTAL", "1,BUS,1,1", "2,BUS,2,2"],
    )
    write(
        f"{tmp_dir}/Y_Vehicle_Category_X_Calendar_Year_Year_2025.csv",
        ["S No_S No,Vehicle Category_Vehicle Category,Calendar Year_2025,TOTAL_TOTAL", "1,BUS,7,7"],
    )
    loaded = wide_csv.unique_reports(wide_csv.load_reports(spark, tmp_dir, "annual"), ["Name", "DataType", "Year"])
    assert rows(loaded.facts, "Name", "Year", "Registrations") == [("A", 2023, 3), ("B", 2023, 4), ("BUS", 2025, 7)]
    assert rows(loaded.rejects) == [
        ("Y_Maker_X_Calendar_Year_Year_2024.csv", wide_csv.R_DUP_KEY),
        ("Y_Vehicle_Category_X_Calendar_Year_Year_2024.csv", wide_csv.R_DUP_KEY),
    ]


def test_save_table_then_load_as_report(spark, tmp_dir):
    from cadence import app

    df = spark.createDataFrame(
        [(("1",), ("A",), ("1,234",), ("1,234",)), (("2",), ("B",), ("5",), ("5",))],
        "`S No` struct<`S No`:string>, Maker struct<Maker:string>, "
        "`Calendar Year` struct<`2024`:string>, TOTAL struct<TOTAL:string>",
    )
    path = app.save_table(df, "Y/Maker X Calendar_Year Year 2024", tmp_dir)
    assert path.endswith("/Y_Maker_X_Calendar_Year_Year_2024.csv")
    f = wide_csv.load_reports(spark, tmp_dir, "annual").facts
    assert rows(f, "Name", "Year", "Registrations") == [("A", 2024, 1234), ("B", 2024, 5)]


def test_shuffled_column_order_binds_by_name(spark, tmp_dir):
    monthly_report(tmp_dir, "Maker", 2023, MONTHS12[:3], [("A", [1, 2, 3])])
    write(
        f"{tmp_dir}/Y_Maker_X_Month_Wise_Year_2024.csv",
        ["TOTAL_TOTAL,Month Wise_MAR,Maker_Maker,S No_S No,Month Wise_JAN", "13,3,A,1,10"],
    )
    f = wide_csv.load_reports(spark, tmp_dir, "monthly").facts
    assert rows(f.where("Year = 2024"), "Name", "Month", "MonthlyRegistrations") == [("A", "JAN", 10), ("A", "MAR", 3)]
    assert rows(f.where("Year = 2023"), "Month", "MonthlyRegistrations") == [("FEB", 2), ("JAN", 1), ("MAR", 3)]


def test_ragged_report_is_refused_whole(spark, tmp_dir):
    write(
        f"{tmp_dir}/Y_Maker_X_Calendar_Year_Year_2023.csv",
        ["S No_S No,Maker_Maker,Calendar Year_2023,TOTAL_TOTAL", "1,A,3,3", "2,B,1,234,1234"],
    )
    write(  # fewer cells than the header are empty cells
        f"{tmp_dir}/Y_Maker_X_Calendar_Year_Year_2024.csv",
        ["S No_S No,Maker_Maker,Calendar Year_2024,TOTAL_TOTAL", '1,"A, ""x""","1,5",5', "2,B", "", "3,C,7,7"],
    )
    loaded = wide_csv.load_reports(spark, tmp_dir, "annual")
    assert rows(loaded.facts, "Name", "Year", "Registrations") == [('A, "x"', 2024, 0), ("B", 2024, 0), ("C", 2024, 7)]
    assert rows(loaded.rejects) == [("Y_Maker_X_Calendar_Year_Year_2023.csv", wide_csv.R_RAGGED)]


def test_long_header_is_read_whole(spark, tmp_dir):
    wide = [f"Extra_{i:05d}" for i in range(9000)]  # far over 64 KiB
    write(
        f"{tmp_dir}/Y_Maker_X_Calendar_Year_Year_2024.csv",
        [",".join(["Maker_Maker", *wide, "Calendar Year_2024"]), ",".join(["A", *["0"] * 9000, "5"])],
    )
    assert rows(wide_csv.load_reports(spark, tmp_dir, "annual").facts, "Name", "Registrations") == [("A", 5)]


def test_fraction_above_zero_is_a_store_fact(spark, tmp_dir):
    write(
        f"{tmp_dir}/Y_Maker_X_Calendar_Year_Year_2024.csv",
        ["Maker_Maker,Calendar Year_2024", "A,0.5", "B,0", "C,12d", "D,9007199254740993", "E,-1", "F,1e3"],
    )
    got = wide_csv.load_reports(spark, tmp_dir, "annual", keep_zero=False)
    assert rows(got.facts, "Name", "Registrations") == [("A", 0), ("D", 9007199254740993), ("F", 1000)]
    assert rows(got.warnings, "Reason", "Cells") == [(wide_csv.R_FRACTIONAL, 1)]


def test_key_twice_in_a_report_frees_it_for_the_next(spark, tmp_dir):
    head = "S No_S No,Maker_Maker,Calendar Year_2020,TOTAL_TOTAL"
    for tag, lines in (("1", ["1,A,5,5", "2,A,7,7"]), ("2", ["1,A,6,6"]), ("3", ["1,A,8,8", "2,B,1,1"]), ("4", ["1,B,9,9"])):
        write(f"{tmp_dir}/Y_Maker_X_Calendar_Year_Year_{tag}.csv", [head, *lines])
    got = wide_csv.unique_reports(wide_csv.load_reports(spark, tmp_dir, "annual"), ["Name", "DataType", "Year"])
    assert rows(got.facts, "Name", "Registrations") == [("A", 6), ("B", 9)]
    assert rows(got.rejects, "Report") == [("Y_Maker_X_Calendar_Year_Year_1.csv",), ("Y_Maker_X_Calendar_Year_Year_3.csv",)]


def test_written_reports_are_numbered_and_chunked(spark, tmp_dir):
    wide = spark.range(2500).selectExpr(
        f"'{MAKER_TYPE}' AS DataType", "concat('M', id) AS Name", "2020 + int(id % 3 = 0) AS Year",
        "CASE WHEN id % 3 > 0 THEN id END AS `Calendar Year_2020`", "CASE WHEN id % 3 = 0 THEN id END AS `Calendar Year_2021`", "id AS TOTAL_TOTAL",
    )
    names = wide_csv.write_reports(wide, tmp_dir, "annual", chunk_rows=300)
    assert names == [f"Y_Maker_X_Calendar_Year_Year_{y}.csv" for y in (2020, 2021)]
    _, records = wide_csv.scan_reports(spark, tmp_dir, "annual")
    for report, serials in records.groupBy(wide_csv.report_of_path(F.col("path"))).agg(F.collect_list(wide_csv.split_line(F.col("record"))[0].cast("int"))).collect():
        assert sorted(serials) == list(range(1, 1 + (834 if "2021" in report else 1666)))
    f = wide_csv.load_reports(spark, tmp_dir, "annual").facts
    assert f.count() == 2500 and rows(f.where("Name = 'M7'"), "Year", "Registrations") == [(2020, 7)]

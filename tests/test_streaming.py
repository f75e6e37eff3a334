"""Incremental ingest: new report files are appended once; replays add nothing."""

from __future__ import annotations

import random

from cadence.functions import CATEGORY_TYPE, MAKER_TYPE
from cadence.sources.store import FactStore
from cadence.streaming.ingest import IngestConfig, ingest_available, make_batch_writer
from conftest import rows
from test_sources import MONTHS12, monthly_report


def test_two_waves_and_replay(spark, tmp_dir):
    landing = f"{tmp_dir}/landing"
    cfg = IngestConfig(
        landing_glob=f"{landing}/*.csv",
        axis="monthly",
        store_path=f"{tmp_dir}/store",
        rejects_path=f"{tmp_dir}/rejects",
        checkpoint=f"{tmp_dir}/ckpt",
        max_files_per_trigger=1,
    )
    monthly_report(landing, "Maker", 2023, MONTHS12[:2], [("A", [1, 0]), ("B", [2, 3])])
    out = ingest_available(spark, cfg)
    assert rows(out, "Name", "Year", "Month", "MonthlyRegistrations") == [
        ("A", 2023, "JAN", 1),
        ("B", 2023, "FEB", 3),
        ("B", 2023, "JAN", 2),
    ]
    # a second wave: one new file plus a bad one (rejected, not fatal)
    monthly_report(landing, "Maker", 2024, MONTHS12[:1], [("A", [5])])
    monthly_report(landing, "Fuel", 2024, MONTHS12[:1], [("P", [5])])
    out = ingest_available(spark, cfg)
    assert out.count() == 4
    assert rows(out.where("Year = 2024"), "Name", "DataType", "MonthlyRegistrations") == [("A", MAKER_TYPE, 5)]
    assert rows(spark.read.parquet(cfg.rejects_path), "Reason") == [("unknown report kind",)]
    # replaying a micro-batch (e.g. after a lost executor) appends nothing twice
    writer = make_batch_writer(cfg)
    batch = spark.createDataFrame([(f"file:{landing}/Y_Maker_X_Month_Wise_Year_2023.csv",)], "path string")
    writer(batch, 0)
    assert FactStore.monthly(spark, cfg.store_path).read().count() == 4


def test_store_and_rejects_do_not_depend_on_batch_size(spark, tmp_dir):
    import os

    got = []
    for most in (1, 100):
        base = f"{tmp_dir}/{most}"
        landing = f"{base}/landing"
        head = "S No_S No,Maker_Maker,Month Wise_JAN,TOTAL_TOTAL"
        reports = {
            "Y_Maker_X_Month_Wise_Year_2020.csv": ["1,A,5,5", "2,A,7,7"],  # a key twice: refused
            "Y_Maker_X_Month_Wise_Year_2021.csv": ["1,A,5,5"],
            "Y_Maker_X_Month_Wise_Year_2021.csv_b_Year_2021.csv": ["1,A,6,6", "2,B,1,1"],  # A of 2021 again: refused whole
            "Y_Maker_X_Month_Wise_Year_2021.csv_c_Year_2021.csv": ["1,B,2,2"],
        }
        os.makedirs(landing)
        for at, (name, lines) in enumerate(reports.items()):
            with open(f"{landing}/{name}", "w") as fh:
                fh.write("\n".join([head, *lines]) + "\n")
            os.utime(f"{landing}/{name}", (1_700_000_000 + 60 * at,) * 2)
        cfg = IngestConfig(f"{landing}/*.csv", "monthly", f"{base}/store", f"{base}/rejects", f"{base}/ckpt", max_files_per_trigger=most)
        store = ingest_available(spark, cfg)
        rejects = spark.read.parquet(cfg.rejects_path).select("Report").distinct()
        got.append((rows(store, "Name", "Year", "MonthlyRegistrations"), rows(rejects)))
    assert got[0] == got[1]
    assert got[0][0] == [("A", 2021, 5), ("B", 2021, 2)]
    assert [r[0] for r in got[0][1]] == ["Y_Maker_X_Month_Wise_Year_2020.csv", "Y_Maker_X_Month_Wise_Year_2021.csv_b_Year_2021.csv"]


def test_growth_table_follows_the_store(spark, tmp_dir):
    """After each batch the kept table equals a full recompute, and only touched entities were computed."""
    import os

    from cadence.functions.rules import STORE_RULES
    from cadence.streaming.growth_table import GrowthTable

    rng = random.Random(3)
    store = FactStore.annual(spark, f"{tmp_dir}/store")
    table = GrowthTable(spark, f"{tmp_dir}/growth", store, "yoy", STORE_RULES, buckets=8)
    assert table.read().count() == 0
    ddl = "Name string, DataType string, Year int, Registrations bigint"
    makers = [f"M{i}" for i in range(60)]
    texts = ["TWO WHEELER(NT)", "TWO WHEELER(T)", "BUS", "TRACTOR", "AMBULANCE"]
    for batch in range(4):
        some = makers if batch == 0 else rng.sample(makers, 4) + [f"new{batch}"]
        data = [(n, MAKER_TYPE, 2020 + batch, rng.randrange(1, 9)) for n in some] + [(t, CATEGORY_TYPE, 2020 + batch, 5) for t in texts[batch :]]
        df = spark.createDataFrame(data, ddl)
        store.append(df)
        before = {f: os.path.getmtime(f"{tmp_dir}/growth/DataType={MAKER_TYPE}/{f}") for f in os.listdir(f"{tmp_dir}/growth/DataType={MAKER_TYPE}")} if batch else {}
        done = table.refresh(df)
        assert rows(table.read()) == rows(table.full())
        assert done.entities == len(some) + len({"2W", "4W", "Other"} if batch < 2 else {"4W", "Other"} if batch < 4 else set())
        if batch:
            assert done.rows + done.kept < table.read().count()  # untouched buckets are left alone
            after = {f: os.path.getmtime(f"{tmp_dir}/growth/DataType={MAKER_TYPE}/{f}") for f in before}
            assert any(after[f] == before[f] for f in before)
        again = table.refresh(df)  # a replay
        assert again.rows == done.rows and rows(table.read()) == rows(table.full())
    assert table.refresh(df.where("false")).entities == 0


def test_ingest_keeps_growth(spark, tmp_dir):
    from cadence.streaming.ingest import growth_table

    landing = f"{tmp_dir}/landing"
    cfg = IngestConfig(f"{landing}/*.csv", "monthly", f"{tmp_dir}/store", f"{tmp_dir}/rejects", f"{tmp_dir}/ckpt", 1, growth_path=f"{tmp_dir}/growth")
    for year in (2022, 2023):
        monthly_report(landing, "Maker", year, MONTHS12, [("A", list(range(1, 13))), (f"B{year}", [2] * 12)])
        ingest_available(spark, cfg)
        table = growth_table(spark, cfg)
        assert rows(table.read()) == rows(table.full()) and table.read().count() > 0


def test_a_batch_meets_the_store_once_and_a_replay_checks_again(spark, tmp_dir, monkeypatch):
    landing = f"{tmp_dir}/landing"
    cfg = IngestConfig(f"{landing}/*.csv", "monthly", f"{tmp_dir}/store", f"{tmp_dir}/rejects", f"{tmp_dir}/ckpt", 1)
    checks, met, checked, holders = [], [], FactStore._checked, FactStore.holders
    monkeypatch.setattr(FactStore, "_checked", lambda self, rows: (checks.append(1), checked(self, rows))[1])
    monkeypatch.setattr(FactStore, "holders", lambda self, rows, by: (met.append(1), holders(self, rows, by))[1])
    for year in (2022, 2023):
        monthly_report(landing, "Maker", year, MONTHS12[:2], [("A", [1, 0]), ("B", [2, 3])])
        ingest_available(spark, cfg)
    assert (len(checks), len(met)) == (0, 2)
    monthly_report(landing, "Maker", "z_Year_2023", MONTHS12[:1], [("B", [7])])  # a stored key of 2023
    out = ingest_available(spark, cfg)
    assert rows(spark.read.parquet(cfg.rejects_path), "Reason") == [("key exists in store",)] and not checks
    make_batch_writer(cfg)(spark.createDataFrame([(f"file:{landing}/Y_Maker_X_Month_Wise_Year_2023.csv",)], "path string"), 1)
    assert len(checks) == 1 and out.count() == FactStore.monthly(spark, cfg.store_path).read().count() == 6

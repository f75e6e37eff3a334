"""What one task holds: shares of a large file or batch stay small, and hot aggregates go by hash."""

from __future__ import annotations

import pathlib

from pyspark.sql import functions as F

from cadence.functions.rules import MAKER_TYPE
from cadence.plans import registry
from cadence.sources import settle, wide_csv
from cadence.sources.store import FactStore
from conftest import rows

REPORT = "Y_Maker_X_Calendar_Year_Year_2020.csv"
HEAD = "Maker_Maker,Calendar Year_2020"


def taken(monkeypatch, module):
    """Frames that ``module`` materializes, by name: (as given, as read back)."""
    seen, real = {}, module.materialize

    def keep(df, name="materialized"):
        seen[name] = (df, real(df, name))
        return seen[name][1]

    monkeypatch.setattr(module, "materialize", keep)
    return seen


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_one_open_file_are_dealt_to_many_tasks(spark, tmp_dir, monkeypatch):
    names = [f"A{i}" if i % 3 else f'"B\n{i},\nx"' for i in range(900)]
    pathlib.Path(tmp_dir, REPORT).write_text("\n".join([HEAD, *(f"{n},{i}" for i, n in enumerate(names))]))
    monkeypatch.setattr(wide_csv, "PART_BITS", 5, raising=False)
    monkeypatch.setattr(wide_csv, "TASK_LINES", 100, raising=False)
    seen = taken(monkeypatch, wide_csv)
    loaded = wide_csv.load_reports(spark, tmp_dir, "annual")
    assert rows(loaded.facts, "Name", "Registrations") == sorted((n.strip('"'), i) for i, n in enumerate(names))
    lines = seen["open-lines"][1]
    most = lines.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert lines.count() == 1501 and most < 700  # one task held all lines of a split


def test_unended_cell_over_parts(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(wide_csv, "PART_BITS", 2, raising=False)
    monkeypatch.setattr(wide_csv, "TASK_LINES", 3, raising=False)
    pathlib.Path(tmp_dir, REPORT).write_text("\n".join([HEAD, *(f"A{i},{i}" for i in range(20)), '"open,1', *(f"C{i},1" for i in range(20))]))
    good = REPORT.replace("2020", "2021")
    pathlib.Path(tmp_dir, good).write_text(HEAD.replace("2020", "2021") + '\n"a ""b"",\n\n c",7\n"x"\n')
    loaded = wide_csv.load_reports(spark, tmp_dir, "annual")
    assert rows(loaded.rejects) == [(REPORT, wide_csv.R_QUOTES)]
    assert rows(loaded.facts, "Name", "Registrations") == [('a "b",\n\n c', 7), ("x", 0)]


def test_headers_go_by_hash_and_names_are_matched_once_a_file(spark, tmp_dir, monkeypatch):
    pathlib.Path(tmp_dir, REPORT).write_text(f"\n  \n{HEAD}\nA,1\n")
    seen = taken(monkeypatch, wide_csv)
    assert rows(wide_csv.load_reports(spark, tmp_dir, "annual").facts, "Name", "Registrations") == [("A", 1)]
    text = plan(seen["files"][0])
    assert "SortAggregate" not in text and "regexp_extract" not in text.lower()


def test_extra_reports_of_several_files_each_with_its_header(spark, tmp_dir, monkeypatch):
    annual = spark.createDataFrame([(f"M{i}", MAKER_TYPE, 2020, i) for i in range(50)], "Name string, DataType string, Year int, Registrations bigint")
    monkeypatch.setattr(registry, "EXTRA_ROWS", 10, raising=False)
    made = registry._extra_reports(annual, MAKER_TYPE, "Y_Maker_" + wide_csv.ANNUAL_MARKER, ".csv", "concat('Maker_Maker,Calendar Year_', Year)", "concat(Name, ',', Registrations)")
    registry._write_lines(made, tmp_dir)
    files = [p.read_text().splitlines() for p in pathlib.Path(tmp_dir).rglob("*.txt")]
    assert len(files) == 5 and all(f[0] == HEAD for f in files) and max(map(len, files)) < 30
    assert rows(wide_csv.load_reports(spark, tmp_dir, "annual").facts, "Name", "Registrations") == sorted((f"M{i}", i) for i in range(50))


def test_rows_that_a_report_write_sorts_hold_no_cells(spark, tmp_dir, monkeypatch):
    """A task has some chunks of text rows, and as many tasks as chunks are asked for."""
    frame = wide_csv.annual_report_frame(spark.createDataFrame([(f"M{i}", MAKER_TYPE, 2020, i) for i in range(40)], "Name string, DataType string, Year int, Registrations bigint"))
    written = []
    monkeypatch.setattr(wide_csv, "write_lines", lambda lines, *a, real=wide_csv.write_lines: (written.append(lines), real(lines, *a)))
    wide_csv.write_reports(frame, tmp_dir, "annual", chunk_rows=5)
    sort = [x for x in plan(written[0]).splitlines() if "row_number" in x]
    assert sort and not any("Cells" in x for x in sort) and "REPARTITION_BY_NUM, [plan_id" in plan(written[0])
    assert wide_csv.load_reports(spark, tmp_dir, "annual").facts.count() == 40


def test_keys_are_dealt_to_as_many_tasks_as_there_are_keys(spark, monkeypatch):
    monkeypatch.setattr(settle, "TASK_KEYS", 10, raising=False)
    seen = taken(monkeypatch, settle)
    df = spark.createDataFrame([(r, f"k{i}", 2020) for r in ("a", "b") for i in range(30)] + [("c", None, 1), ("c", None, 1)], "Report string, Name string, Year int")
    assert rows(settle.refused(df, ["Name", "Year"])) == [("b",), ("c",)]
    assert "hashpartitioning(Name" in plan(seen["settle-lists"][0]) and ", 7), REPARTITION_BY_NUM" in plan(seen["settle-lists"][0])


def test_key_check_goes_by_hash(spark, tmp_dir):
    store = FactStore.monthly(spark, f"{tmp_dir}/s")
    facts = lambda *r: spark.createDataFrame([("A", MAKER_TYPE, 2020, *x) for x in r], store.schema)
    store.create(facts(("JAN", 3)))
    batch = facts(("JAN", 9), ("FEB", 8), ("FEB", 4))
    checked = store._checked(batch)
    assert "SortAggregate" not in plan(checked)
    assert [(r.Month, r.n, r.kept[0], r.Held) for r in checked.orderBy("Month").collect()] == [("FEB", 2, 4, False), ("JAN", 1, 9, True)]


def test_keys_that_do_not_clash_are_counted_by_hash_and_go_no_further(spark, monkeypatch):
    seen = taken(monkeypatch, settle)
    facts = lambda *r: spark.createDataFrame(list(r), "Report string, Name string, Year int")
    assert rows(settle.refused(facts(("a", "x", 1), ("b", "y", 1), ("b", None, 1)), ["Name", "Year"])) == []
    assert list(seen) == ["settle-hashes"]
    assert rows(settle.refused(facts(("a", "x", 1), ("b", "x", 1), ("c", "z", 1)), ["Name", "Year"])) == [("b",)]
    for name in ("settle-hashes", "settle-lists"):  # no lists of names where two numbers tell the reports
        text = plan(seen[name][0])
        assert "collect_list" not in text and "SortAggregate" not in text and "ObjectHash" not in text


def test_cells_of_the_store_profile_are_facts_or_have_a_reason(spark, tmp_dir, monkeypatch):
    """Zeros and empty cells of a dense report are not written; a ragged or fractional one is still told of."""
    head = "Maker_Maker,Month Wise_JAN,Month Wise_FEB,Month Wise_MAR"
    name = "Y_Maker_X_Month_Wise_Year_{}.csv".format
    pathlib.Path(tmp_dir, name(2020)).write_text("\n".join([head, *(f"A{i},0,,{i}" for i in range(9)), "B,-1.5,0.5,00", ",4,4,4"]))
    pathlib.Path(tmp_dir, name(2021)).write_text(f"{head}\nC,0,0,0,0\n")
    pathlib.Path(tmp_dir, name(2022)).write_text(f"{head}\nD,x,0,-2\n")
    seen = taken(monkeypatch, wide_csv)
    loaded = wide_csv.load_reports(spark, tmp_dir, "monthly", keep_zero=False)
    assert seen["cells"][1].count() == 8 + 2 + 3  # facts (one of them a fraction) and the fraction below 0, the ragged row's cells
    assert rows(loaded.facts, "Name", "Month", "MonthlyRegistrations") == [*((f"A{i}", "MAR", i) for i in range(1, 9)), ("B", "FEB", 0)]
    assert rows(loaded.warnings) == [(name(2020), wide_csv.R_FRACTIONAL, 2)]
    assert rows(loaded.rejects) == [(name(2021), wide_csv.R_RAGGED)]
    dense = wide_csv.load_reports(spark, tmp_dir, "monthly", keep_zero=True)
    assert dense.facts.count() == 11 * 3 + 3

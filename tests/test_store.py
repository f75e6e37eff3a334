"""Store: writers at the same time, unfinished commits, repeated keys, reads of one name."""

from __future__ import annotations

import random
import threading

import pytest
from pyspark.sql import functions as F

from cadence.functions import CATEGORY_TYPE, MAKER_TYPE
from cadence.session import path_exists
from cadence.sources import commits
from cadence.sources.store import R_DUP_IN_BATCH, R_KEY_EXISTS, FactStore
from conftest import rows

DDL = "Name string, DataType string, Year int, Registrations bigint"


def frame(spark, data):
    return spark.createDataFrame([(n, MAKER_TYPE, y, v) for n, y, v in data], DDL)


def test_take_has_one_winner(spark, tmp_dir):
    won = []
    barrier = threading.Barrier(8)

    def one(i):
        barrier.wait()
        if commits.take(spark, tmp_dir, 1, f"{tmp_dir}/_stage/{i}"):
            won.append(i)

    threads = [threading.Thread(target=one, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and commits.last(spark, tmp_dir) == 1
    assert not commits.take(spark, tmp_dir, 1, f"{tmp_dir}/_stage/x")
    assert commits.take(spark, tmp_dir, 2, f"{tmp_dir}/_stage/y") and commits.last(spark, tmp_dir) == 2


def test_two_writers_store_a_key_once(spark, tmp_dir, monkeypatch):
    store = FactStore.annual(spark, f"{tmp_dir}/annual")
    store.create(frame(spark, [("A", 2020, 1)]))
    meet, tried, was = threading.Barrier(2), [], commits.take

    def together(s, table, number, stage):  # both have checked and staged before either takes the commit
        if len(tried) < 2:
            tried.append(number)
            meet.wait(timeout=120)
        return was(s, table, number, stage)

    monkeypatch.setattr(commits, "take", together)
    out = {}

    def write(i):
        out[i] = FactStore.annual(spark, store.path).append(frame(spark, [("B", 2020, i), ("A", 2020, 9), (f"own{i}", 2021, i)]))

    threads = [threading.Thread(target=write, args=(i,)) for i in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = rows(store.read(), "Name", "Year")
    assert tried == [1, 1]
    assert got == [("A", 2020), ("B", 2020), ("own1", 2021), ("own2", 2021)]
    reasons = sorted(len(rows(r.dropped)) for r in out.values())
    assert reasons == [1, 2]  # the second saw that the first had stored B
    assert commits.last(spark, store.path) == 2


def test_refusing_writer_checks_again(spark, tmp_dir, monkeypatch):
    store = FactStore.annual(spark, f"{tmp_dir}/annual")
    store.create(frame(spark, [("A", 2020, 1)]))
    was = commits.take

    def after_another(s, table, number, stage):
        monkeypatch.setattr(commits, "take", was)
        assert FactStore.annual(spark, store.path).append(frame(spark, [("B", 2020, 5)])).appended
        return was(s, table, number, stage)

    monkeypatch.setattr(commits, "take", after_another)
    res = store.append(frame(spark, [("B", 2020, 6), ("C", 2020, 6)]), on_conflict="refuse")
    assert not res.appended and rows(res.conflicts, "Name", "Reason") == [("B", R_KEY_EXISTS)]
    assert rows(store.read(), "Name", "Registrations") == [("A", 1), ("B", 5)]


def test_commit_of_a_lost_writer_is_finished(spark, tmp_dir, monkeypatch):
    store = FactStore.annual(spark, f"{tmp_dir}/annual")
    store.create(frame(spark, [("A", 2020, 1)]))
    with monkeypatch.context() as m:
        m.setattr(commits, "finish", lambda s, t, n: None)  # dies after it took the commit
        store.append(frame(spark, [("B", 2020, 2), ("C", 2021, 3)]))
    assert store.read().count() == 1
    res = store.append(frame(spark, [("B", 2020, 7), ("D", 2020, 4)]))
    assert rows(store.read(), "Name", "Registrations") == [("A", 1), ("B", 2), ("C", 3), ("D", 4)]
    assert rows(res.dropped, "Name", "Registrations", "Reason") == [("B", 7, R_KEY_EXISTS)]
    commits.finish(spark, store.path, 1)  # again: nothing moves twice
    assert store.read().count() == 4 and path_exists(spark, f"{store.path}/_log/000000000001/done")


def test_many_writers_finish_one_commit(spark, tmp_dir):
    store = FactStore.annual(spark, f"{tmp_dir}/annual")
    store.create(frame(spark, [("A", 2020, 1)]))
    stage = f"{store.path}/_stage/s"
    store._write(frame(spark, [(f"n{i}", 2000 + i, i) for i in range(60)]), "overwrite", stage)
    assert commits.take(spark, store.path, 1, stage)
    failed = []

    def one():
        try:
            commits.finish(spark, store.path, 1)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=one) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and store.read().count() == 61 and not path_exists(spark, stage)


def test_hot_repeated_key_against_plain(spark, tmp_dir):
    rng = random.Random(1)
    stored = [("A", 2020, 1), ("H", 2020, 3)]
    batch = [("H2", 2020, rng.randrange(4)) for _ in range(300)] + [("H", 2020, i % 3) for i in range(20)]
    batch += [(f"n{rng.randrange(30)}", 2020 + rng.randrange(2), rng.randrange(3)) for _ in range(100)]
    store = FactStore.annual(spark, f"{tmp_dir}/annual")
    store.create(frame(spark, stored))
    res = store.append(frame(spark, batch).repartition(5))
    have, dropped, kept = {(n, y) for n, y, _ in stored}, [], {}
    for n, y, v in sorted(batch):
        if (n, y) in have:
            dropped.append((n, y, v, R_KEY_EXISTS))
        elif (n, y) in kept:
            dropped.append((n, y, v, R_DUP_IN_BATCH))
        else:
            kept[n, y] = v
    assert rows(store.read(), "Name", "Year", "Registrations") == sorted(stored + [(*k, v) for k, v in kept.items()])
    assert rows(res.dropped, "Name", "Year", "Registrations", "Reason") == sorted(dropped)
    assert "Window" not in res.dropped._jdf.queryExecution().optimizedPlan().toString()


def scanned(df) -> int:
    """Rows that the scans of a query give out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_one_entity_read_skips_row_groups(spark, tmp_dir):
    rng = random.Random(2)
    names = [f"maker {i:06}" for i in range(40_000)]
    rng.shuffle(names)
    df = frame(spark, [(n, 2020, i) for i, n in enumerate(names)])
    store = FactStore(spark, f"{tmp_dir}/annual", FactStore.annual(spark, "x").schema, ("Name", "DataType", "Year"), row_group_bytes=32 << 10)
    store.create(df.repartition(8))
    one = store.read().where((F.col("Name") == "maker 012345") & (F.col("DataType") == MAKER_TYPE))
    assert scanned(one) <= 8_000 and one.count() == 1
    assert scanned(store.read().where("Name = 'maker 012345x'")) <= 8_000  # a name that no file holds
    with_order = store.read().where("Name >= 'maker 012345' AND Name < 'maker 012400'")  # no Bloom filter helps here
    assert scanned(with_order) <= 12_000 and with_order.count() == 55
    plain = f"{tmp_dir}/plain"
    df.repartition(8).write.option("parquet.block.size", 32 << 10).partitionBy("DataType", "Year").parquet(plain)
    assert scanned(spark.read.parquet(plain).where("Name = 'maker 012345'")) > 4 * scanned(one)


@pytest.mark.parametrize("kind", [MAKER_TYPE, CATEGORY_TYPE])
def test_append_after_append(spark, tmp_dir, kind):
    store = FactStore.annual(spark, f"{tmp_dir}/annual")
    for i in range(3):
        store.append(spark.createDataFrame([("A", kind, 2020 + i, i), ("A", kind, 2020, 9)], DDL))
    assert rows(store.read(), "Year", "Registrations") == [(2020, 0), (2021, 1), (2022, 2)]
    assert store.append(spark.createDataFrame([], DDL)).appended


def test_years_and_names_without_reading_facts(spark, tmp_dir):
    from cadence import app
    from cadence.sources.names import NameDictionary

    store = FactStore.annual(spark, f"{tmp_dir}/annual_registrations")
    assert store.years() == []
    names = NameDictionary(spark, f"{tmp_dir}/names")
    for batch in ([("A", 2001, 1), ("B", 2003, 2)], [("A", 1999, 1), ("C, c", 2003, 2)], [("A", 2005, 1)]):
        df = frame(spark, batch)
        store.append(df)
        added = names.refresh(df)
    assert added == 0 and names.refresh(df) == 0
    assert store.years() == [1999, 2001, 2003, 2005]
    bounds = app.store_year_range(spark, tmp_dir, 2004)
    assert rows(bounds) == [(1999, 2005)] and "parquet" not in bounds._jdf.queryExecution().executedPlan().toString().lower()
    assert rows(names.read()) == [(MAKER_TYPE, n) for n in ("A", "B", "C, c")]


@pytest.mark.parametrize("hashes", [None, 3])
def test_holders_against_plain(spark, tmp_dir, monkeypatch, hashes):
    """Which reports hold a stored key; keys decide, also where all hashes agree with a stored one."""
    real = F.xxhash64
    if hashes:
        monkeypatch.setattr(F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(hashes)))
    store = FactStore.annual(spark, f"{tmp_dir}/annual")
    store.create(frame(spark, [(f"A{i}", 2020 + i % 3, i) for i in range(30)]))
    data = [("clear", f"B{i}", 2020) for i in range(20)] + [("other year", f"A{i}", 2030 + i) for i in range(20)]
    data += [("one", f"C{i}", 2021) for i in range(20)] + [("one", "A4", 2021), ("all", "A6", 2020), ("all", "A7", 2021), ("none", None, 2020)]
    batch = spark.createDataFrame([(r, n, MAKER_TYPE, y) for r, n, y in data], "Report string, Name string, DataType string, Year int")
    assert rows(store.holders(batch, "Report")) == [("all",), ("one",)]
    assert rows(store.holders(batch.where("Report NOT IN ('one', 'all')"), "Report")) == []
    assert rows(FactStore.annual(spark, f"{tmp_dir}/missing").holders(batch, "Report")) == []


def test_append_clear_at_a_commit_checks_only_after_a_later_one(spark, tmp_dir, monkeypatch):
    store = FactStore.annual(spark, f"{tmp_dir}/annual")
    store.create(frame(spark, [("A", 2020, 1)]))
    checks, was = [], FactStore._checked
    monkeypatch.setattr(FactStore, "_checked", lambda self, rows: (checks.append(1), was(self, rows))[1])
    at = store.version()
    res = store.append(frame(spark, [("B", 2020, 2)]), clear_at=at)
    assert res.appended and rows(res.dropped) == rows(res.conflicts) == [] and not checks
    assert store.version() == at + 1
    res = store.append(frame(spark, [("B", 2020, 9), ("C", 2020, 3)]), clear_at=at)  # B came after that commit
    assert checks and rows(res.dropped, "Name", "Reason") == [("B", R_KEY_EXISTS)]
    assert rows(store.read(), "Name", "Registrations") == [("A", 1), ("B", 2), ("C", 3)]

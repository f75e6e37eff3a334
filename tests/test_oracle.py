"""Every registered query against its DuckDB oracle on the small driver tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from cadence.plans.oracle import ORACLE_SQL
from cadence.plans.registry import QUERIES
from conftest import SF_SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(_norm(r[i])) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLE_SQL[key])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert _canon(df.columns, got) == _canon(cols, want)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["DataType", "Name", "LatestPeriod", "LatestGrowth", "Trend", "BestGrowth", "BestPeriod", "Insight"]
    assert df.count() > 0


def test_the_rows_exercise_the_rules_of_growth(duck):
    """Gap years, zero months and quarters, zero predecessors and every rule keyword occur in the driver tables."""
    from cadence.plans import oracle as O

    one = lambda body: duck.execute(O.with_ctes(O.FACTS, O.GROWTH, body=body)).fetchone()[0]
    assert one("SELECT count(*) FROM (SELECT Year - lag(Year) OVER (PARTITION BY DataType, Name ORDER BY Year) AS d FROM aa) WHERE d > 1") > 0
    assert one("SELECT count(*) FROM monthly WHERE MonthlyRegistrations = 0") > 0
    assert one("SELECT count(*) FROM aq WHERE QuarterlyRegistrations = 0") > 0
    assert one("SELECT count(*) FROM qoq WHERE PrevQuarterRegistrations = 0 AND QoQGrowth IS NULL") > 0
    texts = [r[0].upper() for r in duck.execute(f"SELECT DISTINCT {O.CAT_CASE} FROM part").fetchall()]
    for _, words in (*O.FILE_RULES, *O.STORE_RULES):
        assert all(any(w in t for t in texts) for w in words)

"""The growth views and rule lists for users of SQL: functions of a session, bodies in SQL, nothing in Python.

``register(spark, facts)`` makes the views ``annual_facts`` and ``monthly_facts`` and the table functions

* ``growth_yoy(kind, name, first_year, last_year)``
* ``growth_qoq(kind, name, first_year, last_year)``

Every argument may be left out (NULL): all kinds, all entities, an open range. The kind and the name
are filters on the window's partition key, which Catalyst moves to the facts; the range holds after the lag.
``register_rules(spark, function, rules)`` makes a rule list a scalar function of a text.
"""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.rules import FALLBACK, FILE_RULES, STORE_RULES, Rules, rules_sql

if TYPE_CHECKING:
    from cadence.app import Facts

ANNUAL_VIEW, MONTHLY_VIEW = "annual_facts", "monthly_facts"
#: Scalar functions of the two shipped rule sets.
RULE_FUNCTIONS = {"file_group": FILE_RULES, "store_group": STORE_RULES}

_PARAMETERS = "kind STRING DEFAULT NULL, name STRING DEFAULT NULL, first_year INT DEFAULT NULL, last_year INT DEFAULT NULL"


def _growth(now: str, before: str) -> str:
    now, before = f"CAST({now} AS DOUBLE)", f"CAST({before} AS DOUBLE)"
    return f"rint(try_divide({now} - {before}, {before}) * 100.0D * 100.0D) / 100.0D"


def _chosen(view: str, function: str) -> str:
    return f"({function}.kind IS NULL OR {view}.DataType = {function}.kind) AND ({function}.name IS NULL OR {view}.Name = {function}.name)"


def _in_range(function: str) -> str:
    return f"({function}.first_year IS NULL OR Year >= {function}.first_year) AND ({function}.last_year IS NULL OR Year <= {function}.last_year)"


def _table_functions(annual: str, monthly: str) -> list[str]:
    yoy = f"""
CREATE OR REPLACE TEMPORARY FUNCTION growth_yoy({_PARAMETERS})
RETURNS TABLE (DataType STRING, Name STRING, Year INT, Registrations BIGINT, PrevYearRegistrations BIGINT, YoYGrowth DOUBLE)
RETURN SELECT DataType, Name, Year, Registrations, Previous, {_growth("Registrations", "Previous")}
FROM (
  SELECT DataType, Name, Year, Registrations, lag(Registrations) OVER (PARTITION BY DataType, Name ORDER BY Year) AS Previous
  FROM (
    SELECT DataType, Name, Year, sum(Registrations) AS Registrations FROM {annual}
    WHERE Name IS NOT NULL AND {_chosen(annual, "growth_yoy")} GROUP BY DataType, Name, Year
  )
) WHERE {_in_range("growth_yoy")}"""
    qoq = f"""
CREATE OR REPLACE TEMPORARY FUNCTION growth_qoq({_PARAMETERS})
RETURNS TABLE (DataType STRING, Name STRING, Year INT, Quarter INT, QuarterYear STRING, QuarterlyRegistrations BIGINT, PrevQuarterRegistrations BIGINT, QoQGrowth DOUBLE)
RETURN SELECT DataType, Name, Year, Quarter, concat(Year, '-Q', Quarter), Registrations, Previous, {_growth("Registrations", "Previous")}
FROM (
  SELECT DataType, Name, Year, Quarter, Registrations, lag(Registrations) OVER (PARTITION BY DataType, Name ORDER BY Year, Quarter) AS Previous
  FROM (
    SELECT DataType, Name, year(Date) AS Year, quarter(Date) AS Quarter, sum(Registrations) AS Registrations FROM {monthly}
    WHERE Name IS NOT NULL AND Date IS NOT NULL AND {_chosen(monthly, "growth_qoq")} GROUP BY DataType, Name, year(Date), quarter(Date)
  )
) WHERE {_in_range("growth_qoq")} AND {_growth("Registrations", "Previous")} IS NOT NULL"""
    return [yoy, qoq]


def register_rules(spark: SparkSession, function: str, rules: Rules, fallback: str = FALLBACK) -> None:
    """Make ``function(text)`` give the label of the first rule that matches a text."""
    if not re.fullmatch(r"\w+", function):
        raise ValueError(f"not a function name: {function!r}")
    body = rules_sql(f"{function}.label_of", rules, fallback)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}(label_of STRING) RETURNS STRING RETURN {body}")


def register_views(spark: SparkSession, annual: DataFrame, monthly: DataFrame) -> None:
    """Views and table functions over annual (DataType, Name, Year, Registrations) and dated monthly facts."""
    annual.select("DataType", "Name", F.col("Year").cast("int"), F.col("Registrations").cast("bigint")).createOrReplaceTempView(ANNUAL_VIEW)
    monthly.select("DataType", "Name", "Date", F.col("MonthlyRegistrations").cast("bigint").alias("Registrations")).createOrReplaceTempView(MONTHLY_VIEW)
    for statement in _table_functions(ANNUAL_VIEW, MONTHLY_VIEW):
        spark.sql(statement)


def register(spark: SparkSession, facts: Facts) -> None:
    """Views, table functions and rule functions for facts of either profile; names are the profile's groups."""
    of = facts.profile.group_col
    named = [df if of == "Name" else df.drop("Name").withColumnRenamed(of, "Name") for df in (facts.annual, facts.monthly)]
    register_views(spark, *named)
    for function, rules in RULE_FUNCTIONS.items():
        register_rules(spark, function, rules)

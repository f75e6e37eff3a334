"""Keyword rules that group detailed entity names (e.g. vehicle categories).

A rule set is an ordered list ``[(label, [keyword, ...]), ...]``. The name is
trimmed and upper-cased (a NULL name reads as ``'NAN'``); the first rule with
any keyword contained in it wins, otherwise the fallback label. The rule list
compiles to one ``CASE WHEN`` expression, so grouping stays inside whole-stage
codegen with no Python on the data path.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadence.functions._util import as_col

Rules = Sequence[tuple[str, Sequence[str]]]

# The two shipped rule sets and their fallback label.
# "file" profile (dashboard over report files):
FILE_RULES: Rules = (
    ("2W", ("TWO WHEELER",)),
    ("3W", ("THREE WHEELER",)),
    ("4W", ("FOUR WHEELER", "GOODS VEHICLE", "PASSENGER VEHICLE", "MOTOR VEHICLE", "TRAC", "EARTH MOVING")),
)
# "store" profile (dashboard over the fact store):
STORE_RULES: Rules = (
    ("2W", ("TWO WHEELER",)),
    ("3W", ("THREE WHEELER",)),
    (
        "4W",
        (
            "FOUR WHEELER",
            "LIGHT MOTOR VEHICLE",
            "MEDIUM MOTOR VEHICLE",
            "HEAVY MOTOR VEHICLE",
            "GOODS VEHICLE",
            "PASSENGER VEHICLE",
            "BUS",
            "TRAC",
            "EARTH MOVING",
            "DUMPER",
            "CRANE",
        ),
    ),
)
FALLBACK = "Other"
NULL_TEXT = "NAN"

# The two entity kinds of the data model.
CATEGORY_TYPE = "Vehicle Category"
MAKER_TYPE = "Manufacturer"


def normalized_text(name: Column | str) -> Column:
    """trim + upper, NULL read as 'NAN' (how a missing cell prints as text)."""
    return F.upper(F.trim(F.coalesce(as_col(name).cast("string"), F.lit(NULL_TEXT))))


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rules_sql(column: str, rules: Rules, fallback: str = FALLBACK) -> str:
    """The rule CASE WHEN as SQL text over a column as it is written in SQL."""
    text = f"upper(trim(coalesce(CAST({column} AS STRING), {_sql_str(NULL_TEXT)})))"
    whens = []
    for label, keywords in rules:
        if keywords:
            cond = " OR ".join(f"contains({text}, {_sql_str(k.upper())})" for k in keywords)
            whens.append(f"WHEN {cond} THEN {_sql_str(label)}")
    if not whens:
        return _sql_str(fallback)
    return f"CASE {' '.join(whens)} ELSE {_sql_str(fallback)} END"


@lru_cache(maxsize=256)
def _rules_sql(name: str, rules: tuple, fallback: str) -> str:
    """``rules_sql`` over a column name (built once per rule set)."""
    quoted = name.replace("`", "``")
    return rules_sql(f"`{quoted}`", rules, fallback)


def categorize(name: Column | str, rules: Rules = FILE_RULES, fallback: str = FALLBACK) -> Column:
    """Compile an ordered keyword rule list into a first-match-wins CASE WHEN."""
    if isinstance(name, str):
        frozen = tuple((label, tuple(kws)) for label, kws in rules)
        return F.expr(_rules_sql(name, frozen, fallback))
    text = normalized_text(name)
    expr = None
    for label, keywords in rules:
        if not keywords:
            continue
        cond = reduce(lambda a, b: a | b, [text.contains(F.lit(k.upper())) for k in keywords])
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(fallback) if expr is None else expr.otherwise(F.lit(fallback))


def group_name(
    data_type: Column | str,
    name: Column | str,
    rules: Rules = FILE_RULES,
    grouped_type: str = CATEGORY_TYPE,
    fallback: str = FALLBACK,
) -> Column:
    """Rules for rows of the grouped kind; every other row keeps its own name."""
    return F.when(as_col(data_type) == F.lit(grouped_type), categorize(name, rules, fallback)).otherwise(
        as_col(name)
    )

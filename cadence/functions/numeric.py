"""Numeric column functions: coercion, cleaning, growth percentages, rounding.

All are plain Spark expressions (codegen'd, no Python on the data path) and
null-safe under ANSI mode: ``try_cast`` / ``try_divide`` never raise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadence.functions._util import as_col


#: What counts as a number in a text cell (blanks around it are allowed); no type suffixes, no hex, no "inf".
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"


def parse_number(c: Column | str) -> Column:
    """A cell as double; NULL when it is no number."""
    s = F.trim(as_col(c).cast("string"))
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def parse_integer(c: Column | str) -> Column:
    """A cell as bigint, exact to 64 bits; NULL when it is no whole number in range."""
    s = F.trim(as_col(c).cast("string"))
    return F.when(s.rlike(INTEGER), s.try_cast("bigint"))


def coerce_or_zero(c: Column | str) -> Column:
    """Any cell to double; unparsable, empty, null or NaN become 0.0."""
    return F.coalesce(parse_number(c), F.lit(0.0))


def coerce_count(c: Column | str) -> Column:
    """A cell as a BIGINT count: whole numbers exactly, fractions cut toward zero, anything else 0."""
    return F.coalesce(parse_integer(c), parse_number(c).try_cast("bigint"), F.lit(0).cast("bigint"))


def is_fractional(c: Column | str) -> Column:
    """True when a cell parses to a number with a fractional part."""
    d = parse_number(c)
    return F.coalesce(parse_integer(c).isNull() & d.isNotNull() & (d != F.floor(d)), F.lit(False))


def strip_thousands(c: Column | str) -> Column:
    """Remove thousands separators and surrounding blanks from a text cell."""
    return F.trim(F.regexp_replace(as_col(c).cast("string"), ",", ""))


def round2(x: Column) -> Column:
    """Round to 2 decimals half-to-even on the scaled double: ``rint(x*100)/100``."""
    return F.rint(x * F.lit(100.0)) / F.lit(100.0)


def pct_change(cur: Column | str, prev: Column | str) -> Column:
    """(cur - prev) / prev * 100, rounded to 2 places.

    NULL when there is no previous period, or when prev is 0 (x/0 and 0/0 give
    NULL rather than inf / NaN).
    """
    c = as_col(cur).cast("double")
    p = as_col(prev).cast("double")
    return round2(F.try_divide(c - p, p) * F.lit(100.0))

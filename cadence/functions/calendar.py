"""Month and quarter helpers for the monthly grain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadence.functions._util import as_col

# Month labels used by the monthly report columns, JAN=1 .. DEC=12.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

# Column-name prefixes of the wide reports.
MONTH_PREFIX = "Month Wise_"
YEAR_PREFIX = "Calendar Year_"
TOTAL_COLUMN = "TOTAL_TOTAL"


# The lookups as SQL literals (one expression instead of dozens of literal columns).
_MONTH_MAP = "map(" + ", ".join(f"'{m}', {i}" for i, m in enumerate(MONTHS, 1)) + ")"
_MONTH_ARRAY = "array(" + ", ".join(f"'{m}'" for m in MONTHS) + ")"


def month_num(month: Column | str) -> Column:
    """'JAN' -> 1 ... 'DEC' -> 12; any other label -> NULL."""
    return F.try_element_at(F.expr(_MONTH_MAP), as_col(month))


def month_label(num: Column | str) -> Column:
    """1 -> 'JAN' ... 12 -> 'DEC'; out of range -> NULL."""
    return F.try_element_at(F.expr(_MONTH_ARRAY), as_col(num).cast("int"))


def month_date(year: Column | str, mnum: Column | str) -> Column:
    """First day of the month; NULL when the month or year is unknown or invalid."""
    y = as_col(year).cast("int")
    m = as_col(mnum).cast("int")
    ok = y.between(1, 9999) & m.between(1, 12)
    return F.when(ok, F.make_date(y, m, F.lit(1)))


def quarter_label(year: Column | str, quarter: Column | str) -> Column:
    """'2024-Q1' style label (sorts correctly for 4-digit years)."""
    return F.concat(as_col(year).cast("string"), F.lit("-Q"), as_col(quarter).cast("string"))

"""Text functions: display formats, trend labels, safe output names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadence.functions._util import as_col

# How a missing number prints in the display formats.
NAN_TEXT = "nan"


def safe_name(c: Column | str) -> Column:
    """Every character that is not a letter or a digit becomes '_'."""
    return F.regexp_replace(as_col(c).cast("string"), r"[^\p{L}\p{N}]", "_")


def format_count(c: Column | str) -> Column:
    """'{:,.0f}' style: thousands separators, no decimals; NULL prints 'nan'."""
    x = as_col(c)
    return F.when(x.isNull(), F.lit(NAN_TEXT)).otherwise(F.format_number(x.cast("bigint"), 0))


def format_pct(c: Column | str) -> Column:
    """'{:.2f}%' style; NULL prints 'nan%'."""
    x = as_col(c).cast("double")
    return F.when(x.isNull(), F.lit(NAN_TEXT + "%")).otherwise(F.format_string("%.2f%%", x))


def format_2f(c: Column | str) -> Column:
    """'{:.2f}' style; NULL prints 'nan'."""
    x = as_col(c).cast("double")
    return F.when(x.isNull(), F.lit(NAN_TEXT)).otherwise(F.format_string("%.2f", x))


def trend_label(g: Column | str) -> Column:
    """positive / negative / stable; a NULL growth is 'stable' (no comparison holds)."""
    x = as_col(g)
    return F.when(x > 0, F.lit("positive")).when(x < 0, F.lit("negative")).otherwise(F.lit("stable"))

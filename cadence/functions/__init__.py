"""Column functions (all built-in Spark expressions, no Python UDFs)."""

from cadence.functions.calendar import MONTHS, month_date, month_label, month_num, quarter_label
from cadence.functions.numeric import (
    coerce_count,
    coerce_or_zero,
    is_fractional,
    pct_change,
    round2,
    strip_thousands,
)
from cadence.functions.rules import (
    CATEGORY_TYPE,
    FALLBACK,
    FILE_RULES,
    MAKER_TYPE,
    STORE_RULES,
    categorize,
    group_name,
)
from cadence.functions.text import format_2f, format_count, format_pct, safe_name, trend_label

__all__ = [
    "MONTHS",
    "CATEGORY_TYPE",
    "MAKER_TYPE",
    "FALLBACK",
    "FILE_RULES",
    "STORE_RULES",
    "categorize",
    "coerce_count",
    "coerce_or_zero",
    "format_2f",
    "format_count",
    "format_pct",
    "group_name",
    "is_fractional",
    "month_date",
    "month_label",
    "month_num",
    "pct_change",
    "quarter_label",
    "round2",
    "safe_name",
    "strip_thousands",
    "trend_label",
]

"""Wide report frames -> long fact tables, plus cleaning steps.

``unpivot`` is a narrow operator (Expand): no shuffle, it streams each input
row into one output row per period column.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions.calendar import MONTH_PREFIX, TOTAL_COLUMN, YEAR_PREFIX
from cadence.functions.numeric import coerce_count, parse_integer, parse_number, strip_thousands

_YEAR_COL = re.compile(re.escape(YEAR_PREFIX) + r"\d{4}")


def month_columns(columns: Iterable[str]) -> list[str]:
    return [c for c in columns if MONTH_PREFIX in c]


def year_columns(columns: Iterable[str]) -> list[str]:
    return [c for c in columns if _YEAR_COL.match(c)]


def _id_columns(df: DataFrame, value_cols: Sequence[str], keep: Sequence[str] | None) -> list[str]:
    if keep is not None:
        return list(keep)
    return [c for c in df.columns if c not in set(value_cols) and c != TOTAL_COLUMN]


def unpivot_monthly(
    wide: DataFrame,
    ids: Sequence[str] | None = None,
    value_name: str = "MonthlyRegistrations",
    keep_null_cells: bool = True,
    coerce: bool = True,
) -> DataFrame:
    """'Month Wise_JAN'.. columns -> rows (Month='JAN', value); TOTAL dropped.

    Cells are coerced (unparsable -> 0). With ``keep_null_cells=False`` a NULL
    cell (a month the report does not cover) produces no row; ``coerce=False``
    keeps NULL cells NULL (for an explicit ``drop_nulls`` step).
    """
    mcols = month_columns(wide.columns)
    id_cols = _id_columns(wide, mcols, ids)
    if not mcols:
        return wide.select(*id_cols, F.lit(None).cast("string").alias("Month"), F.lit(None).cast("bigint").alias(value_name)).limit(0)
    labels = {c: c.removeprefix(MONTH_PREFIX) for c in mcols}
    long = _typed_unpivot(wide, id_cols, labels, "Month")
    if not keep_null_cells:
        long = long.where(F.col("Cell").isNotNull())
    return long.select(*id_cols, "Month", (_count("Cell", long) if coerce else _whole("Cell", long)).alias(value_name))


def _typed_unpivot(wide: DataFrame, ids: list[str], labels: dict[str, str], name: str) -> DataFrame:
    """Columns -> rows (label, Cell) without a text round trip: whole-number columns stay BIGINT, anything else is text."""
    kinds = dict(wide.dtypes)
    whole = all(kinds[c] in ("tinyint", "smallint", "int", "bigint") for c in labels)
    kind = "bigint" if whole else "string"
    cells = [F.col(f"`{c}`").cast(kind).alias(label) for c, label in labels.items()]
    return wide.select(*[F.col(f"`{c}`") for c in ids], *cells).unpivot(ids, list(labels.values()), name, "Cell")


def _count(cell: str, df: DataFrame):
    """The cell as a count, 0 when it is none."""
    return F.coalesce(F.col(cell), F.lit(0).cast("bigint")) if dict(df.dtypes)[cell] == "bigint" else coerce_count(cell)


def _whole(cell: str, df: DataFrame):
    return F.col(cell) if dict(df.dtypes)[cell] == "bigint" else parse_integer(cell)


def unpivot_annual(
    wide: DataFrame,
    ids: Sequence[str] | None = None,
    value_name: str = "Registrations",
    keep_null_cells: bool = True,
) -> DataFrame:
    """Every 'Calendar Year_YYYY' column -> rows (Year from the column name)."""
    ycols = year_columns(wide.columns)
    id_cols = _id_columns(wide, ycols, ids)
    if not ycols:
        return wide.select(*id_cols, F.lit(None).cast("int").alias("Year"), F.lit(None).cast("bigint").alias(value_name)).limit(0)
    labels = {c: _YEAR_COL.match(c).group()[-4:] for c in ycols}
    long = _typed_unpivot(wide, id_cols, labels, "YearText")
    if not keep_null_cells:
        long = long.where(F.col("Cell").isNotNull())
    return long.select(*id_cols, F.col("YearText").cast("int").alias("Year"), _count("Cell", long).alias(value_name))


def drop_nulls(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(subset))


def keep_positive(df: DataFrame, value_col: str) -> DataFrame:
    """Store profile: rows with a value <= 0 are not facts."""
    return df.where(F.col(value_col) > 0)


def flatten_columns(df: DataFrame, sep: str = "_") -> DataFrame:
    """Two-level (struct) columns -> 'outer_inner' columns; names are stripped."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            for sub in f.dataType.fields:
                out.append(F.col(f"`{f.name}`.`{sub.name}`").alias(f"{f.name}{sep}{sub.name}".strip()))
        else:
            out.append(F.col(f"`{f.name}`").alias(f.name.strip()))
    return df.select(*out)


def clean_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Strip thousands commas and blanks from text columns; a column becomes
    BIGINT when every non-empty cell is an integer, DOUBLE when every cell is
    a number, otherwise it stays text (cleaned).

    The promotion decision is one aggregate job over the input (one row of
    flags), like a schema inference pass.
    """
    text_cols = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)
    ]
    if not text_cols:
        return df
    flags = []
    for c in text_cols:
        s = strip_thousands(F.col(f"`{c}`"))
        present = s.isNotNull() & (s != "")
        flags.append(F.bool_and(~present | parse_integer(s).isNotNull()).alias(f"i{len(flags)}"))
        flags.append(F.bool_and(~present | parse_number(s).isNotNull()).alias(f"d{len(flags)}"))
    row = df.agg(*flags).first()
    out = []
    k = 0
    for f in df.schema.fields:
        if f.name in text_cols:
            s = strip_thousands(F.col(f"`{f.name}`"))
            is_int, is_dbl = row[k], row[k + 1]
            k += 2
            if is_int is not False:
                out.append(parse_integer(s).alias(f.name))
            elif is_dbl:
                out.append(parse_number(s).alias(f.name))
            else:
                out.append(s.alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)

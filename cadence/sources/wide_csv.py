"""Wide report files (CSV) -> long fact tables, with a reject report.

A report is one kind (maker / category) x one axis (calendar year / month
wise) x one year. Its columns drift: the year sits inside a column name and a
partial year has fewer month columns. So files are read as text lines, each
line meets the header of its own file, and cells are picked by column name.

Scale notes
* A load scans the text twice: once for one row a file (its first line, and whether a line of it leaves a quoted cell
  open), once to parse all rows, which are written and read from there. The counts of
  rows that need a second look come with the second scan (``observe``); where they are 0, nothing more runs.
* Files without an open line, almost all, need no shuffle: every line is a record. In the others a record may go over
  lines and file splits: each line maps "starts inside a quoted cell or not" to "ends inside or not", these maps are chained
  within a split, the splits' maps (a row each) within a file, and lines of one record are put together.
* The file table has one row per file and joins the lines on the file's path
  (broadcast by Spark's own size check; a hot file's lines are split by AQE).
* Files of no bytes are not listed by Spark's sources; a file of blank lines is an empty report.
* A row with more cells than its header, or a quoted cell that no quote ends, refuses the whole report; a read error fails the job.
* A line break inside a cell, of any kind, reads as ``\\n``.
* A report may be a single file or a Spark-written folder of part files: the
  report name is the path component that starts with ``Y_``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions.calendar import MONTH_PREFIX, TOTAL_COLUMN, YEAR_PREFIX, month_date, month_num
from cadence.functions.numeric import parse_integer, parse_number
from cadence.functions.rules import CATEGORY_TYPE, MAKER_TYPE
from cadence.session import materialize
from cadence.sources import settle
from cadence.sources.commits import delete, rename, staged_files

# Report naming and header conventions.
REPORT_PREFIX = "Y_"
ANNUAL_MARKER = "X_Calendar_Year_Year_"
MONTHLY_MARKER = "X_Month_Wise_Year_"
REPORT_SUFFIX = ".csv"
FILE_GLOB = "*.{csv,txt}"  # part files of a written report are text
KIND_TOKENS = {MAKER_TYPE: "Y_Maker_", CATEGORY_TYPE: "Y_Vehicle_Category_"}
ENTITY_COLUMNS = {MAKER_TYPE: "Maker_Maker", CATEGORY_TYPE: "Vehicle Category_Vehicle Category"}
SERIAL_COLUMN = "S No_S No"
YEAR_IN_NAME = r"Year_(\d{4})\.csv"

AXES = {"annual": ANNUAL_MARKER, "monthly": MONTHLY_MARKER}

# Reject reasons.
R_UNKNOWN_KIND = "unknown report kind"
R_NO_ENTITY = "no entity column"
R_NO_PERIODS = "no period columns"
R_NO_YEAR = "no year in file name"
R_EMPTY = "empty report"
R_RAGGED = "row does not fit header"
R_QUOTES = "quoted cell does not end"

REJECT_SCHEMA = T.StructType([T.StructField("Report", T.StringType()), T.StructField("Reason", T.StringType())])


# ---------------------------------------------------------------- naming

def report_name(axis: str, data_type: str, year: int) -> str:
    token = KIND_TOKENS[data_type]
    return f"{token}{AXES[axis]}{int(year)}{REPORT_SUFFIX}"


def report_of_path(path: Column) -> Column:
    """The report name inside a file URI: the last component starting with 'Y_'
    (a file, a folder of part files, or a ``Report=<name>`` partition folder)."""
    return F.regexp_extract(path, r".*/(?:Report=)?(" + re.escape(REPORT_PREFIX) + r"[^/]*)(?:/[^/]*){0,2}$", 1)


def kind_of_report(report: Column) -> Column:
    expr = None
    for data_type, token in KIND_TOKENS.items():
        cond = report.contains(token)
        expr = F.when(cond, F.lit(data_type)) if expr is None else expr.when(cond, F.lit(data_type))
    return expr


def year_of_report(report: Column) -> Column:
    return F.regexp_extract(report, YEAR_IN_NAME, 1).try_cast("int")


# ---------------------------------------------------------------- discovery

def _paths(source: str | Iterable[str]) -> list[str]:
    return [source] if isinstance(source, str) else list(source)


def list_report_files(spark: SparkSession, source: str | Iterable[str], axis: str) -> DataFrame:
    """(path, Report, Kind) for every file of the axis under ``source``."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", FILE_GLOB)
        .load(_paths(source))
        .select(F.col("_metadata.file_path").alias("path"))
    )
    return _of_axis(files, axis).withColumn("Kind", kind_of_report(F.col("Report")))


def _of_axis(files: DataFrame, axis: str) -> DataFrame:
    out = files.withColumn("Report", report_of_path(F.col("path")))
    return out.where(F.col("Report").contains(AXES[axis]) & F.col("Report").endswith(REPORT_SUFFIX))


def read_lines(spark: SparkSession, source: str | Iterable[str], axis: str) -> DataFrame:
    """(path, line, block, place): the lines of every file of the axis; ``block`` is the file split, ``place`` grows in it.

    Files of the other axis are left out by their path, so they are not read.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", FILE_GLOB).text(_paths(source))
    path, value = F.col("_metadata.file_path"), F.col("value")
    return text.where(path.contains("/" + REPORT_PREFIX) | path.contains("/Report=" + REPORT_PREFIX)).where(path.contains(AXES[axis])).select(
        path.alias("path"),
        F.when(value.startswith("\ufeff"), F.substr(value, F.lit(2))).otherwise(value).alias("line"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )


# Patterns over a line with a comma before it, so that every cell has one. All loops are possessive:
# linear time, no recursion. A quote counts only at the start of a cell; text after the closing quote belongs to the cell.
_QUOTED = '"[^"]*+(?:""[^"]*+)*+'  # an opened cell without its closing quote
_CELL = f',({_QUOTED}"[^,]*+|[^,]*+)'
_OPEN_LINE = f'^(?:,(?:{_QUOTED}"[^,]*+|[^,"][^,]*+|(?=,|\\z)))*+,{_QUOTED}\\z'


def ends_open(line: Column) -> Column:
    """True when a line that starts a record ends inside a quoted cell."""
    return line.contains('"') & F.concat(F.lit(","), line).rlike(_OPEN_LINE)


def _unquoted(cell: Column) -> Column:
    body = F.regexp_extract(cell, f'^({_QUOTED})"', 1)  # with the opening quote
    text = F.concat(F.replace(F.substr(body, F.lit(2)), F.lit('""'), F.lit('"')), F.substr(cell, F.length(body) + 2))
    return F.when(cell.startswith('"') & (body != ""), text).otherwise(cell)


def split_line(line: Column) -> Column:
    """Cells of a CSV record; quoted cells lose their quotes, empty cells are NULL."""
    plain = F.split(line, ",", -1)
    quoted = F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), 1), _unquoted)
    return F.transform(F.when(line.contains('"'), quoted).otherwise(plain), lambda c: F.when(c != "", c))


def _states(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Add ``in0``, ``in1``: is a quoted cell open before a row, if its group starts outside (0) or inside (1) of one.

    ``a``, ``b``: the state after a row that starts outside, inside. After the last row that ends the
    same way from both, only the number of rows that swap the state matters.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum((F.col("a") & ~F.col("b")).cast("int")).over(before), F.lit(0))
    out = df.withColumn("swaps", swaps)
    fixed = F.last(F.when(F.col("a") == F.col("b"), F.struct("a", "swaps")), ignorenulls=True).over(before)
    out = out.withColumn("fixed", fixed)
    odd = F.col("swaps") % 2 == 1
    known = F.col("fixed.a") != ((F.col("swaps") - F.col("fixed.swaps")) % 2 == 1)
    return out.withColumns({"in0": F.coalesce(known, odd), "in1": F.coalesce(known, ~odd)}).drop("swaps", "fixed")


#: Characters of the longest record; a longer one counts as a quoted cell that does not end.
RECORD_CHARS = 64 << 20

#: Lines of a task of ``assemble``, about; a part (of a split) has at most 2 ** PART_BITS.
TASK_LINES = 250_000
PART_BITS = 16


def assemble(lines: DataFrame, tasks: int = 8) -> tuple[DataFrame, DataFrame]:
    """``(records, broken)`` of files whose records may go over lines: (path, n, record), and paths whose last quoted cell never ends.

    Lines are dealt to ``tasks`` by parts of file splits, so a task's share does not grow with a file.
    """
    part = ["path", "block", "part"]
    mapped = lines.withColumn("part", F.shiftright("place", PART_BITS)).repartition(tasks, *part)
    mapped = mapped.withColumns({"a": ends_open(F.col("line")), "b": ends_open(F.concat(F.lit('"'), "line"))})
    upto = Window.partitionBy(*part).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    started = [F.sum((~F.col(f"in{s}")).cast("int")).over(upto).alias(f"n{s}") for s in (0, 1)]
    after = [F.when(F.col(s), F.col("b")).otherwise(F.col("a")).alias(f"open{s[2]}") for s in ("in0", "in1")]
    mapped = materialize(_states(mapped, part, "place").select(*part, "place", "line", "in0", "in1", *started, *after), "open-lines")
    ends = mapped.groupBy(*part).agg(
        F.max_by("open0", "place").alias("a"), F.max_by("open1", "place").alias("b"), F.max("n0").alias("starts0"), F.max("n1").alias("starts1")
    )
    blocks = _states(ends, ["path"], "block", "part")  # a row for each part of a file
    before = Window.partitionBy("path").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.when(F.col("in0"), F.col("starts1")).otherwise(F.col("starts0"))
    blocks = materialize(
        blocks.select(*part, F.col("in0").alias("inside"), F.coalesce(F.sum(starts).over(before), F.lit(0)).alias("done"),
                      F.when(F.col("in0"), F.col("b")).otherwise(F.col("a")).alias("open")),
        "open-blocks",
    )
    inside = lambda s: F.when(F.col("inside"), F.col(f"{s}1")).otherwise(F.col(f"{s}0"))
    numbered = mapped.join(blocks.select(*part, "inside", "done"), part).select(
        "path", "block", "place", "line", (F.col("done") + inside("n")).alias("n"), (~inside("in") & ~inside("open")).alias("alone")
    )
    unended = blocks.groupBy("path").agg(F.max_by("open", F.struct("block", "part")).alias("open")).where("open").select("path")
    chars = numbered.where("NOT alone").groupBy("path", "n").agg(F.sum(F.length("line") + 1).alias("chars"))
    chars = chars.unionByName(numbered.where("alone").select("path", "n", (F.length("line") + 1).cast("bigint").alias("chars")))
    endless = chars.where(F.col("chars") > RECORD_CHARS).select("path")
    broken = materialize(unended.unionByName(endless).distinct(), "open-broken")
    sound = numbered.join(broken, "path", "left_anti")
    # only lines that share their record with others meet
    whole = sound.where("NOT alone").groupBy("path", "n").agg(F.sort_array(F.collect_list(F.struct("block", "place", "line"))).alias("lines"))
    whole = whole.select("path", "n", F.array_join("lines.line", "\n").alias("record"))
    return sound.where("alone").select("path", "n", F.col("line").alias("record")).unionByName(whole), broken


def scan_reports(spark: SparkSession, source: str | Iterable[str], axis: str) -> tuple[DataFrame, DataFrame]:
    """``(files, records)``: (path, Report, Kind, Header, Columns, Broken) of each file, and its body's (path, record), blank ones left out.

    Records of broken files are not among them.
    """
    lines = read_lines(spark, source, axis)
    first = F.when((F.col("block") == 0) & (F.trim("line") != ""), F.struct("place", "line"))
    # a set of at most one entry, not a maximum: with it Spark aggregates by hash, without it sorts all lines by path
    opened = F.size(F.collect_set(F.when(ends_open(F.col("line")), F.lit(True)))) > 0
    files = lines.groupBy("path").agg(F.min(first)["line"].alias("Header"), opened.alias("Open"), F.count(F.lit(1)).alias("Lines"))
    # written before names are looked at: else that filter goes below the aggregate, and every line's path is matched
    files = materialize(files.select("path", "Header", F.lit(False).alias("Broken"), "Open", "Lines"), "files")
    files = materialize(_of_axis(files, axis), "axis-files")
    bodies = lines.join(files.where(~F.col("Open")).select("path", "Header"), "path")
    records = bodies.where((F.trim("line") != "") & (F.col("line") != F.col("Header"))).select("path", F.col("line").alias("record"))
    open_lines = files.where("Open").agg(F.sum("Lines")).first()[0]
    files = files.drop("Lines")
    if open_lines:
        # a number stands for a path where lines are dealt and sorted
        open_ = materialize(files.where("Open").select("path", "Report", F.monotonically_increasing_id().alias("id")), "open-files")
        ids = open_.select("path", "id")
        numbered = lines.join(ids, "path").select(F.col("id").alias("path"), "line", "block", "place")
        whole, broken = assemble(numbered, max(1, -(-open_lines // TASK_LINES)))
        whole = materialize(whole.where(F.trim("record") != "").withColumnRenamed("path", "id").join(ids, "id").select("path", "n", "record"), "records")
        heads = whole.join(whole.groupBy("path").agg(F.min("n").alias("n")), ["path", "n"]).select("path", F.col("record").alias("Header"))
        broken = broken.withColumnRenamed("path", "id").join(ids, "id").select("path", F.lit(True).alias("Broken"))
        open_ = open_.drop("id").join(heads, "path", "left").join(broken, "path", "left")
        open_ = open_.select("path", "Header", F.coalesce("Broken", F.lit(False)).alias("Broken"), F.lit(True).alias("Open"), "Report")
        files = files.where(~F.col("Open")).unionByName(open_)
        records = records.unionByName(whole.join(heads, "path").where(F.col("record") != F.col("Header")).select("path", "record"))
    columns = F.transform(split_line(F.col("Header")), lambda c: F.coalesce(c, F.lit("")))
    return files.select("path", "Report", kind_of_report(F.col("Report")).alias("Kind"), "Header", columns.alias("Columns"), "Broken"), records


# ---------------------------------------------------------------- rejects

def _entity_column(kind: Column) -> Column:
    expr = None
    for data_type, col_name in ENTITY_COLUMNS.items():
        cond = kind == F.lit(data_type)
        expr = F.when(cond, F.lit(col_name)) if expr is None else expr.when(cond, F.lit(col_name))
    return expr


def _period_count(axis: str) -> Column:
    if axis == "annual":
        pred = lambda c: c.rlike("^" + re.escape(YEAR_PREFIX) + r"\d{4}")
    else:
        pred = lambda c: c.contains(MONTH_PREFIX)
    return F.size(F.filter(F.col("Columns"), pred))


def classify(headers: DataFrame, axis: str) -> DataFrame:
    """Add Reason (NULL = accepted) to each file of ``scan_reports``."""
    ent = _entity_column(F.col("Kind"))
    has_entity = F.exists(F.col("Columns"), lambda c: c.contains(ent))
    reason = (
        F.when(F.col("Kind").isNull(), F.lit(R_UNKNOWN_KIND))
        .when(F.col("Broken"), F.lit(R_QUOTES))
        .when(F.col("Columns").isNull(), F.lit(R_EMPTY))
        .when(~has_entity, F.lit(R_NO_ENTITY))
        .when(_period_count(axis) == 0, F.lit(R_NO_PERIODS))
    )
    if axis == "monthly":
        reason = reason.when(year_of_report(F.col("Report")).isNull(), F.lit(R_NO_YEAR))
    return headers.withColumn("Reason", reason)


# ---------------------------------------------------------------- loading

R_FRACTIONAL = "fractional count truncated"


R_DUP_KEY = "duplicate key"


@dataclass
class Loaded:
    facts: DataFrame
    rejects: DataFrame  # (Report, Reason): files that were not loaded
    warnings: DataFrame  # (Report, Reason, Cells): loaded files with cells that needed fixing
    by_report: DataFrame | None = None  # facts + the Report each row came from


def _without(df: DataFrame, reports: DataFrame) -> DataFrame:
    return df.join(reports.select("Report").distinct(), "Report", "left_anti").select(*df.columns)


def refused_reports(by_report: DataFrame, key: list[str]) -> DataFrame:
    """(Report, Reason): reports that repeat a key, in themselves or of a report accepted before them, by name (see ``settle``)."""
    return settle.refused(by_report, key).select("Report", F.lit(R_DUP_KEY).alias("Reason"))


def unique_reports(loaded: Loaded, key: list[str]) -> Loaded:
    """Enforce a unique key the way a file-by-file insert does: see ``refused_reports``."""
    if loaded.by_report is None:
        return loaded
    refused = refused_reports(loaded.by_report, key)
    kept = _without(loaded.by_report, refused)
    return Loaded(kept.drop("Report"), loaded.rejects.unionByName(refused), loaded.warnings, kept)


def _period_columns(axis: str) -> Column:
    """Array of a header's period columns: their place ``pos`` and what facts carry of them, worked out once a file."""
    named = F.transform(F.col("Columns"), lambda c, i: F.struct(i.alias("pos"), c.alias("label")))
    if axis == "annual":
        found = F.filter(named, lambda x: x["label"].rlike("^" + re.escape(YEAR_PREFIX) + r"\d{4}"))
        return F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), F.regexp_extract(x["label"], r"(\d{4})", 1).try_cast("int").alias("Year")))
    year = year_of_report(F.col("Report"))
    found = F.filter(named, lambda x: x["label"].contains(MONTH_PREFIX))
    found = F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), F.regexp_replace(x["label"], "^" + re.escape(MONTH_PREFIX), "").alias("Month")))
    found = F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), year.alias("Year"), x["Month"].alias("Month"), month_num(x["Month"]).alias("MonthNum")))
    return F.transform(found, lambda x: F.struct(*[x[c].alias(c) for c in ("pos", "Year", "Month", "MonthNum")], month_date(x["Year"], x["MonthNum"]).alias("Date")))


def load_reports(spark: SparkSession, source: str | Iterable[str], axis: str, keep_zero: bool = True) -> Loaded:
    """Load every report of one axis under ``source``.

    keep_zero=True is the file profile (0 counts are rows); False is the store
    profile (NULL names and counts <= 0 are not facts; a fraction above 0 counts, then is cut).
    Monthly facts carry MonthNum and Date; rows of an unknown month are dropped.
    """
    files, records = scan_reports(spark, source, axis)
    files = materialize(classify(files, axis), "headers")  # one row per file
    bad = files.where(F.col("Reason").isNotNull()).select("Report", "Reason").distinct()
    # a report of several files goes whole when one of them is refused
    good = _without(files, bad).select(
        "path", "Report", "Kind", F.size("Columns").alias("Width"), _period_columns(axis).alias("Periods"),
        F.array_position(F.transform("Columns", lambda c: c.contains(_entity_column(F.col("Kind")))), True).cast("int").alias("Entity"),
    )
    value = "Registrations" if axis == "annual" else "MonthlyRegistrations"
    rows = records.join(good, "path").withColumn("Cells", split_line(F.col("record")))
    cells = rows.select(
        "Report", F.col("Kind").alias("DataType"), F.get("Cells", F.col("Entity") - 1).alias("Name"),
        (F.size("Cells") > F.col("Width")).alias("Ragged"), "Cells", F.explode("Periods").alias("p"),
    ).withColumn("Cell", F.get("Cells", F.col("p.pos")))
    if not keep_zero:  # most cells of a dense report; a ragged row stays, as it refuses its report
        cells = cells.where(F.col("Ragged") | (F.col("Cell") != "0"))
    # a cell is matched once; only what is no whole number is looked at as a number (see ``coerce_count``, ``is_fractional``)
    cells = cells.withColumn("Whole", parse_integer("Cell")).withColumn("Number", F.when(F.col("Whole").isNull(), parse_number("Cell")))
    count = F.coalesce("Whole", F.col("Number").try_cast("bigint"), F.lit(0).cast("bigint"))
    fractional = F.col("Number").isNotNull() & (F.col("Number") != F.floor("Number"))
    period = [F.col(f"p.{c}").alias(c) for c in (["Year"] if axis == "annual" else ["Year", "Month", "MonthNum", "Date"])]
    cells = cells.select(
        "Report", "DataType", "Name", "Ragged", *period, count.alias(value),
        F.coalesce(F.col("Whole") > 0, F.col("Number") > 0, F.lit(False)).alias("Positive"), F.coalesce(fractional, F.lit(False)).alias("Fractional"),
    )
    seen = Observation()
    cells = cells.observe(seen, F.count_if("Ragged").alias("ragged"), F.count_if("Fractional").alias("fractional"))
    fact = F.col("Name").isNotNull() & F.col("Positive")
    if not keep_zero:  # above ``observe``: below it this would match a cell a second time
        cells = cells.where(fact | F.col("Ragged") | F.col("Fractional"))
    cells = materialize(cells, "cells")
    # counts of a task that ran twice may count twice; they only tell whether there is anything to look for
    found = seen.get
    none = F.lit(False)
    ragged = cells.where(F.col("Ragged") if found.get("ragged") else none).select("Report", F.lit(R_RAGGED).alias("Reason")).distinct()
    bad = bad.unionByName(ragged)
    if found.get("ragged"):
        cells = _without(cells, ragged)
    warnings = cells.where(F.col("Fractional") if found.get("fractional") else none).groupBy("Report").agg(F.count(F.lit(1)).alias("Cells"))
    warnings = warnings.select("Report", F.lit(R_FRACTIONAL).alias("Reason"), "Cells")
    if not keep_zero:
        cells = cells.where(fact)
    if axis == "annual":
        facts = cells.select("Name", "DataType", "Year", value, "Report")
    else:
        facts = cells.where(F.col("Date").isNotNull()).select("Name", "DataType", "Year", "Month", value, "Report", "MonthNum", "Date")
    return Loaded(facts.drop("Report"), bad, warnings, facts)


# ---------------------------------------------------------------- writing (CSV sink)

#: Rows of one file of a written report, about.
CHUNK_ROWS = 100_000


def _csv_cell(c: Column) -> Column:
    text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\\r\\n?", "\n")
    return F.when(text.rlike('[",\\n]'), F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))).otherwise(text)


def in_folders(df: DataFrame, folders: list[str], order: list[str]) -> DataFrame:
    """``df`` sorted within tasks by folder columns, then ``order``, so that the files of a folder keep that order.

    Spark sorts by the folder columns once more, and drops the sort before, unless they are known to hold no null text.
    """
    strings = {f.name for f in df.schema.fields if f.name in folders and isinstance(f.dataType, T.StringType)}
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in sorted(strings)}).sortWithinPartitions(*folders, *order)


def write_lines(lines: DataFrame, out_dir: str, folders: list[str], order: list[str]) -> None:
    """Add text files of ``line``, one folder for each value of ``folders``, lines in ``order``. Rows of one folder must be in one task."""
    in_folders(lines, folders, order).select(*folders, "line").write.mode("append").partitionBy(*folders).text(out_dir)


def write_reports(wide: DataFrame, out_dir: str, axis: str, chunk_rows: int = CHUNK_ROWS, named: bool = False) -> list[str]:
    """Write one report per (DataType, Year) of a wide frame.

    ``wide`` is (DataType, Name, Year, period columns..., TOTAL_TOTAL); a
    report only gets the period columns that have a value in that (kind, year):
    a partial year writes fewer columns. Rows are numbered 1..n within the report.

    One pass writes all reports: rows become CSV lines, a report's rows are
    dealt to chunks of about ``chunk_rows`` (a folder and a task each), and every chunk starts with
    its report's header line. Serials are a chunk's own numbers plus the sizes of the chunks before it.
    ``named``: every report is one CSV file of its own name, for readers that know no folders: its
    chunks are merged in order by one task a report (sorted on disk if need be), and the file moves to its name, in the place of an older one, when all are written.
    Returns the report names written.
    """
    prefix = YEAR_PREFIX if axis == "annual" else MONTH_PREFIX
    periods = [c for c in wide.columns if c.startswith(prefix)]
    pick = lambda c: F.col(f"`{c}`")
    cells = F.array(*[pick(c).cast("string") for c in periods])
    token = F.coalesce(*[F.when(F.col("DataType") == k, F.lit(t + AXES[axis])) for k, t in KIND_TOKENS.items()])
    entity = F.coalesce(*[F.when(F.col("DataType") == k, F.lit(e)) for k, e in ENTITY_COLUMNS.items()])
    rows = materialize(
        wide.select(
            F.concat(token, F.col("Year").cast("string"), F.lit(REPORT_SUFFIX)).alias("Report"),
            entity.alias("Entity"), "Name", cells.alias("Cells"), F.col(TOTAL_COLUMN).alias("Total"),
        ),
        "report-rows",
    )
    covered = [F.max(F.col("Cells")[i].isNotNull()).alias(f"p{i}") for i in range(len(periods))]
    reports = rows.groupBy("Report", "Entity").agg(F.count(F.lit(1)).alias("n"), *covered)
    shown = F.filter(F.array(*[F.when(F.col(f"p{i}"), F.struct(F.lit(i).alias("pos"), F.lit(c).alias("label"))) for i, c in enumerate(periods)]), lambda c: c.isNotNull())
    head = F.concat_ws(",", F.lit(SERIAL_COLUMN), F.col("Entity"), F.concat_ws(",", "Shown.label"), F.lit(TOTAL_COLUMN))
    reports = reports.select("Report", "Entity", shown.alias("Shown"), F.ceil(F.col("n") / chunk_rows).cast("int").alias("Chunks"))
    reports = materialize(reports.select("Report", head.alias("Head"), F.col("Shown.pos").alias("Shown"), "Chunks"), "report-heads")
    found = reports.select("Report", "Chunks").collect()  # one row per report

    # what is sorted carries the line's text, not the cells; a task has some chunks, however many rows there are
    shown = F.transform("Shown", lambda i: F.coalesce(F.get("Cells", i), F.lit("")))
    text = F.concat_ws(",", _csv_cell(F.col("Name")), F.concat_ws(",", shown), _csv_cell(F.col("Total")))
    dealt = rows.join(reports.select("Report", "Shown", "Chunks"), "Report")
    dealt = dealt.select("Report", F.pmod(F.xxhash64("Name"), F.col("Chunks")).cast("int").alias("Chunk"), "Name", "Total", text.alias("Text"))
    sizes = dealt.groupBy("Report", "Chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("Report").orderBy("Chunk")) - F.col("n")
    sizes = sizes.select("Report", "Chunk", before.alias("Before")).join(reports.select("Report", "Head"), "Report")
    dealt = dealt.repartition(max(1, sum(r["Chunks"] for r in found)), "Report", "Chunk")
    serial = F.row_number().over(Window.partitionBy("Report", "Chunk").orderBy("Name", "Total"))
    body = dealt.withColumn("Serial", serial).join(sizes, ["Report", "Chunk"]).withColumn("Serial", F.col("Serial") + F.col("Before"))
    line = F.concat_ws(",", F.col("Serial").cast("string"), "Text")
    top = F.col("Serial") == (1 if named else F.col("Before") + 1)
    line = F.when(top, F.concat("Head", F.lit("\n"), line)).otherwise(line)  # a chunk's first row
    out = body.select("Report", "Chunk", "Serial", F.posexplode(F.split(line, "\n", -1)).alias("part", "line"))  # lines of a record
    names = sorted(r["Report"] for r in found)
    if named:
        _write_named(out.repartition("Report"), out_dir, names)
    else:  # rows are dealt by report and chunk already, for their serials
        write_lines(out, out_dir, ["Report", "Chunk"], ["Serial", "part"])
    return names


def _write_named(lines: DataFrame, out_dir: str, names: list[str]) -> None:
    spark, out_dir = lines.sparkSession, out_dir.rstrip("/")
    stage = f"{out_dir}/_stage/{uuid.uuid4().hex}"
    write_lines(lines, stage, ["Report"], ["Serial", "part"])
    for name in names:
        parts = staged_files(spark, f"{stage}/Report={name}")
        if len(parts or []) != 1:
            raise OSError(f"{name}: one file expected, found {parts}")
        delete(spark, f"{out_dir}/{name}")
        if not rename(spark, f"{stage}/Report={name}/{parts[0]}", f"{out_dir}/{name}"):
            raise OSError(f"cannot move {name} to {out_dir}")
    delete(spark, stage)


def wide_annual(annual: DataFrame) -> DataFrame:
    """(DataType, Name, Year, Registrations) -> one 'Calendar Year_YYYY' column per year."""
    years = sorted(r[0] for r in annual.select("Year").distinct().collect())  # a calendar span
    # One conditional aggregate (one exchange) instead of DataFrame.pivot (two).
    cols = [
        F.sum(F.when(F.col("Year") == F.lit(y), F.col("Registrations"))).cast("bigint").alias(f"{YEAR_PREFIX}{y}")
        for y in years
    ]
    return annual.groupBy("DataType", "Name").agg(*cols)


def annual_report_frame(annual: DataFrame) -> DataFrame:
    """(DataType, Name, Year, Registrations) -> rows with the one-year wide layout,
    ready for ``write_reports(axis='annual')``: 'Calendar Year_YYYY' holds the
    row's own year only."""
    years = sorted(r[0] for r in annual.select("Year").distinct().collect())
    cols = [
        F.when(F.col("Year") == F.lit(y), F.col("Registrations")).cast("bigint").alias(f"{YEAR_PREFIX}{y}")
        for y in years
    ]
    return annual.select("DataType", "Name", "Year", *cols, F.col("Registrations").cast("bigint").alias(TOTAL_COLUMN))

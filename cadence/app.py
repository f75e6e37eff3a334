"""User-facing flows: build the store from report files, and the growth report
a dashboard user asks for (data type, metric, entity, year range).

Two profiles mirror the two ways the facts are read:
* ``FILE_PROFILE``: facts straight from the report files, zero counts kept,
  the file rule set, category rows renamed to their group;
* ``STORE_PROFILE``: facts from the Parquet store, counts <= 0 dropped at
  build time, the store rule set, the group in an extra ``MappedName`` column.

Growth is computed for every entity of the chosen kind in one pass; the
entity and year range are filters (the range after the lag).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.rules import CATEGORY_TYPE, FILE_RULES, STORE_RULES, Rules, group_name
from cadence.operators.catalog import DEFAULT_GROUPS, entity_catalog, preview, year_bounds
from cadence.operators.growth import qoq_growth, with_month_dates, yoy_growth
from cadence.operators.insight import insights
from cadence.operators.views import format_growth_table, growth_view_qoq, growth_view_yoy, trend_series
from cadence.sources import wide_csv
from cadence.sources.store import FactStore


R_NO_TABLE = "table is missing"
R_NO_DATA = "no sufficient data for the selection"


@dataclass(frozen=True)
class Profile:
    name: str
    keep_zero: bool
    rules: Rules
    group_col: str  # column growth is grouped by
    ensure_groups: tuple = field(default=())


FILE_PROFILE = Profile("file", True, FILE_RULES, "Name", DEFAULT_GROUPS)
STORE_PROFILE = Profile("store", False, STORE_RULES, "MappedName")


@dataclass
class Facts:
    annual: DataFrame
    monthly: DataFrame
    rejects: DataFrame
    profile: Profile
    warnings: DataFrame | None = None  # (Report, Reason, Cells) of loaded reports; (Table, Reason) of a store


def _apply_groups(df: DataFrame, profile: Profile) -> DataFrame:
    g = group_name("DataType", "Name", profile.rules)
    return df.withColumn("Name", g) if profile.group_col == "Name" else df.withColumn(profile.group_col, g)


def load_facts(spark: SparkSession, source: str, profile: Profile = FILE_PROFILE) -> Facts:
    """Annual and monthly facts from a folder of report files."""
    a = wide_csv.load_reports(spark, source, "annual", keep_zero=profile.keep_zero)
    m = wide_csv.load_reports(spark, source, "monthly", keep_zero=profile.keep_zero)
    return Facts(
        _apply_groups(a.facts, profile), _apply_groups(m.facts, profile), a.rejects.unionByName(m.rejects), profile,
        a.warnings.unionByName(m.warnings),
    )


@dataclass
class StoreBuild:
    rejects: DataFrame  # (Report, Reason)
    warnings: DataFrame  # (Report, Reason, Cells)


def build_store(spark: SparkSession, source: str, store_dir: str) -> StoreBuild:
    """Replace the two fact tables with the reports under ``source`` (store
    profile: zero counts and nameless rows are not facts). A report that would
    repeat a key is refused whole (first report by name wins)."""
    annual = FactStore.annual(spark, f"{store_dir}/annual_registrations")
    monthly = FactStore.monthly(spark, f"{store_dir}/monthly_registrations")
    a = wide_csv.unique_reports(wide_csv.load_reports(spark, source, "annual", keep_zero=False), annual.key)
    m = wide_csv.unique_reports(wide_csv.load_reports(spark, source, "monthly", keep_zero=False), monthly.key)
    annual.create(a.facts)
    monthly.create(m.facts)
    return StoreBuild(a.rejects.unionByName(m.rejects), a.warnings.unionByName(m.warnings))


def safe_file_name(name: str) -> str:
    """Every character that is not a letter or a digit becomes '_' (driver-side
    twin of ``functions.safe_name`` for output names)."""
    return "".join(ch if ch.isalnum() else "_" for ch in name)


def save_table(df: DataFrame, name: str, out_dir: str) -> str:
    """Save a scraped/collected table as a report: two-level headers flattened
    to 'A_B', thousands commas stripped and numeric columns promoted, written
    as a header CSV folder named after ``name``. Returns the path."""
    from cadence.operators.reshape import clean_numeric, flatten_columns

    path = f"{out_dir.rstrip('/')}/{safe_file_name(name)}.csv"
    clean_numeric(flatten_columns(df)).write.mode("overwrite").option("header", "true").csv(path)
    return path


def load_store(spark: SparkSession, store_dir: str, profile: Profile = STORE_PROFILE) -> Facts:
    """Facts from the store; monthly rows get their Date (unknown months dropped).

    A missing table has no facts and a row in ``warnings``; the other one is read.
    """
    tables = {
        "annual_registrations": FactStore.annual(spark, f"{store_dir}/annual_registrations"),
        "monthly_registrations": FactStore.monthly(spark, f"{store_dir}/monthly_registrations"),
    }
    missing = [(name, R_NO_TABLE) for name, t in tables.items() if not t.exists()]
    a = tables["annual_registrations"].read()
    m = with_month_dates(tables["monthly_registrations"].read()).drop("MonthNum")
    empty = spark.createDataFrame([], wide_csv.REJECT_SCHEMA)
    warnings = spark.createDataFrame(missing, "Table string, Reason string")
    return Facts(_apply_groups(a, profile), _apply_groups(m, profile), empty, profile, warnings)


@dataclass
class GrowthReport:
    view: DataFrame  # display rows (growth table)
    table: DataFrame  # formatted table
    series: DataFrame  # (x, y) trend series
    insight: DataFrame  # one row per entity: trend, best period, sentence
    notice: DataFrame  # one row (Reason) when the selection has no rows, else none


def growth_report(
    facts: Facts,
    data_type: str,
    metric: str = "yoy",
    name: str | None = None,
    year_range: tuple[int, int] | None = None,
) -> GrowthReport:
    """The dashboard's growth section for one kind (all entities, or one); view and table come by name and period."""
    lo, hi = year_range if year_range else (None, None)
    col = facts.profile.group_col
    if metric == "yoy":
        g = yoy_growth(facts.annual.where(F.col("DataType") == data_type), group_col=col)
        view = growth_view_yoy(g, data_type, name, lo, hi)
    elif metric == "qoq":
        g = qoq_growth(facts.monthly.where(F.col("DataType") == data_type), group_col=col)
        view = growth_view_qoq(g, data_type, name, lo, hi)
    else:
        raise ValueError("metric must be 'yoy' or 'qoq'")
    period = ["Year"] if metric == "yoy" else ["Year", "Quarter"]
    shown = view.orderBy("Name", *period)
    notice = view.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(R_NO_DATA).alias("Reason"))
    return GrowthReport(shown, format_growth_table(shown, metric), trend_series(view, metric), insights(view, metric), notice)


def entity_choices(facts: Facts, data_type: str) -> DataFrame:
    """Names offered for a kind (groups for categories), sorted."""
    col = facts.profile.group_col
    cat = entity_catalog(
        facts.annual,
        facts.monthly,
        name_col=col,
        ensure_groups=facts.profile.ensure_groups,
        grouped_type=CATEGORY_TYPE,
    )
    return cat.where(F.col("DataType") == data_type).select("Name")


def year_range_default(facts: Facts, current_year: int | None = None) -> DataFrame:
    return year_bounds(facts.annual, facts.monthly, current_year)


def store_year_range(spark: SparkSession, store_dir: str, current_year: int | None = None) -> DataFrame:
    """``year_range_default`` of a store, from the names of its folders; reads no facts."""
    found = [FactStore.annual(spark, f"{store_dir}/annual_registrations").years(), FactStore.monthly(spark, f"{store_dir}/monthly_registrations").years()]
    annual, monthly = (spark.createDataFrame([(y,) for y in years], "Year int") for years in found)
    return year_bounds(annual, monthly, current_year)


def previews(facts: Facts, n: int = 5) -> tuple[DataFrame, DataFrame]:
    return (
        preview(facts.annual, ["DataType", "Name", "Year"], n),
        preview(facts.monthly, ["DataType", "Name", "Year", "Month"], n),
    )

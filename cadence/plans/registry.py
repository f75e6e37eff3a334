"""Registered queries: one per operator / composite query of the survey.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole driver tables. Growth queries are lazy; source, store and catalog
queries run jobs while they are built, as they write reports, stores and shared counts to
the scratch folder first. Column names match ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions import (
    CATEGORY_TYPE,
    FILE_RULES,
    MAKER_TYPE,
    STORE_RULES,
    categorize,
    coerce_count,
    coerce_or_zero,
    group_name,
    month_label,
    pct_change,
    safe_name,
    trend_label,
)
from cadence import app, sql
from cadence.operators import (
    aggregate_annual,
    aggregate_quarterly,
    clean_numeric,
    drop_nulls,
    entity_catalog,
    filter_entity,
    filter_year_range,
    flatten_columns,
    format_growth_table,
    growth_view_qoq,
    growth_view_yoy,
    insights,
    latest_and_best,
    mask_first_period,
    preview,
    qoq_growth,
    qoq_of_quarters,
    trend_series,
    unpivot_annual,
    unpivot_monthly,
    with_month_dates,
    year_bounds,
    yoy_growth,
)
from cadence.operators.growth import entity_window
from cadence.plans import facts
from cadence.session import materialize, scratch_path
from cadence.sources import wide_csv
from cadence.sources.names import NameDictionary
from cadence.sources.store import FactStore

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the dashboard-style queries (a user's selections).
VIEW_RANGE = (1997, 2000)
YOY_ENTITY = (CATEGORY_TYPE, "4W")
QOQ_ENTITY = (CATEGORY_TYPE, "3W")
PROJECT_ENTITY = (MAKER_TYPE, "Brand#1", 3)  # kind, brand, supplier
SERIES_RANGE = (1996, 2001)
# A user-supplied rule list over part names (category_custom_rules).
CUSTOM_RULES = (
    ("METAL", ("BOLT", "GEAR", "RING", "ROD", "PLATE", "ANVIL")),
    ("GADGET", ("WIDGET", "GIZMO")),
)


# ---------------------------------------------------------------- shared inputs

def fact_set(spark, d, reuse: bool = True, by_month: bool = True) -> facts.FactSet:
    return facts.FactSet(spark, d, reuse, by_month)


def annual_once(spark, d):
    """Annual facts for a plan that reads the counts once: yearly grain, no
    materialization."""
    return facts.FactSet(spark, d, reuse=False, by_month=False).annual


def grouped(df: DataFrame, rules=FILE_RULES) -> DataFrame:
    """File profile: category rows get their group as Name."""
    return df.withColumn("Name", group_name("DataType", "Name", rules))


def annual_grouped(spark, d, **only):
    """Annual facts with categories by their group, mapped below the aggregate."""
    return facts.annual_from_counts(facts.monthly_counts(spark, d, by_month=False, grouped=True, **only))


def yoy_all(spark, d):
    return yoy_growth(annual_grouped(spark, d))


def quarters(spark, d, **only):
    return facts.quarterly_from_counts(facts.monthly_counts(spark, d, grouped=True, **only), rules=None)


def qoq_all(spark, d):
    return qoq_of_quarters(quarters(spark, d))


def yoy_of(spark, d, **only):
    """YoY growth of one selection: its filters sit below the join."""
    return yoy_growth(annual_grouped(spark, d, **only))


# ---------------------------------------------------------------- growth core

def q_agg_annual(spark, d):
    return aggregate_annual(annual_grouped(spark, d))


def q_lag_year(spark, d):
    a = aggregate_annual(annual_grouped(spark, d))
    return a.withColumn("PrevYearRegistrations", F.lag("Registrations").over(entity_window("Year")))


def q_pct_change(spark, d):
    y = q_lag_year(spark, d)
    return y.select(
        "DataType", "Name", "Year", pct_change("Registrations", "PrevYearRegistrations").alias("YoYGrowth")
    )


def q_first_period_mask(spark, d):
    # Registrations of the first year are known, so only the mask can hide them
    return mask_first_period(yoy_all(spark, d), "Year", ["Registrations", "PrevYearRegistrations", "YoYGrowth"])


def q_yoy_growth(spark, d):
    return yoy_all(spark, d)


def q_agg_quarterly(spark, d):
    return aggregate_quarterly(grouped(fact_set(spark, d).monthly()))


def q_lag_quarter(spark, d):
    q = quarters(spark, d)
    return q.withColumn(
        "PrevQuarterRegistrations", F.lag("QuarterlyRegistrations").over(entity_window("Year", "Quarter"))
    )


def q_quarter_label(spark, d):
    m = with_month_dates(fact_set(spark, d).monthly())
    return m.select(
        "Name",
        "DataType",
        "Year",
        "Month",
        F.quarter("Date").alias("Quarter"),
        F.concat(F.year("Date").cast("string"), F.lit("-Q"), F.quarter("Date").cast("string")).alias("QuarterYear"),
    )


def q_qoq_growth(spark, d):
    return qoq_all(spark, d)


def q_yoy_growth_store(spark, d):
    """Store profile: positive facts only, every row grouped by MappedName (store rules)."""
    a = annual_once(spark, d).where(F.col("Registrations") > 0)
    a = a.withColumn("MappedName", group_name("DataType", "Name", STORE_RULES))
    return yoy_growth(a, group_col="MappedName")


def q_qoq_growth_store(spark, d):
    m = fact_set(spark, d, reuse=False).monthly_positive
    m = m.withColumn("MappedName", group_name("DataType", "Name", STORE_RULES))
    return qoq_growth(m, group_col="MappedName")


# ---------------------------------------------------------------- views

def q_filter_entity(spark, d):
    return filter_entity(yoy_of(spark, d, kind=YOY_ENTITY[0], group=YOY_ENTITY[1]), *YOY_ENTITY)


def q_filter_year_range(spark, d):
    return filter_year_range(yoy_all(spark, d), *VIEW_RANGE)


def q_growth_view_yoy(spark, d):
    return growth_view_yoy(yoy_of(spark, d, kind=YOY_ENTITY[0], group=YOY_ENTITY[1]), *YOY_ENTITY, *VIEW_RANGE)


def q_growth_view_qoq(spark, d):
    q = qoq_of_quarters(quarters(spark, d, kind=QOQ_ENTITY[0], group=QOQ_ENTITY[1]))
    return growth_view_qoq(q, *QOQ_ENTITY, *VIEW_RANGE)


def q_project_growth_view(spark, d):
    kind, brand, supplier = PROJECT_ENTITY
    v = growth_view_yoy(yoy_of(spark, d, kind=kind, brand=brand, supplier=supplier), kind, f"{brand} S{supplier}")
    return v.select("Year", "Registrations", "PrevYearRegistrations", "YoYGrowth")


def q_trend_series(spark, d):
    return trend_series(growth_view_qoq(qoq_all(spark, d), lo=SERIES_RANGE[0], hi=SERIES_RANGE[1]), "qoq")


def q_format_growth_table(spark, d):
    return format_growth_table(growth_view_yoy(yoy_all(spark, d)), "yoy")


def q_format_growth_table_qoq(spark, d):
    return format_growth_table(growth_view_qoq(qoq_all(spark, d)), "qoq")


def q_trend_series_yoy(spark, d):
    return trend_series(growth_view_yoy(yoy_all(spark, d), lo=SERIES_RANGE[0], hi=SERIES_RANGE[1]), "yoy")


def q_sql_growth_yoy(spark, d):
    """The growth view through SQL: a table function of the session over registered facts."""
    fs = fact_set(spark, d)
    sql.register_views(spark, grouped(fs.annual), with_month_dates(grouped(fs.monthly())))
    (kind, name), (lo, hi) = YOY_ENTITY, VIEW_RANGE
    return spark.sql("SELECT * FROM growth_yoy(:kind, :name, :lo, :hi)", {"kind": kind, "name": name, "lo": lo, "hi": hi})


def q_sql_growth_qoq(spark, d):
    fs = fact_set(spark, d)
    sql.register_views(spark, grouped(fs.annual), with_month_dates(grouped(fs.monthly())))
    return spark.sql("SELECT DataType, Name, QuarterYear AS X, QoQGrowth AS Y FROM growth_qoq(first_year => :lo, last_year => :hi)",
                     {"lo": SERIES_RANGE[0], "hi": SERIES_RANGE[1]})


def q_sql_rules(spark, d):
    """A user's rule list and the two shipped ones as scalar SQL functions."""
    for function, rules in {**sql.RULE_FUNCTIONS, "custom_group": CUSTOM_RULES}.items():
        sql.register_rules(spark, function, rules)
    _part_text(spark, d).createOrReplaceTempView("part_texts")
    return spark.sql(
        "SELECT p_partkey, file_group(CategoryText) AS FileGroup, store_group(CategoryText) AS StoreGroup, custom_group(p_name) AS CustomGroup FROM part_texts"
    )


# ---------------------------------------------------------------- insights

def q_trend_label(spark, d):
    y = yoy_all(spark, d)
    return y.select("DataType", "Name", "Year", "YoYGrowth", trend_label("YoYGrowth").alias("Trend"))


def q_latest_growth(spark, d):
    lb = latest_and_best(growth_view_yoy(yoy_all(spark, d)), "yoy")
    return lb.select("DataType", "Name", "LatestPeriod", "LatestGrowth")


def q_best_period(spark, d):
    i = insights(growth_view_qoq(qoq_all(spark, d)), "qoq")
    return i.select("DataType", "Name", "BestGrowth", "BestPeriod")


def q_insight_yoy(spark, d):
    return insights(growth_view_yoy(yoy_all(spark, d)), "yoy")


def q_insight_qoq(spark, d):
    return insights(growth_view_qoq(qoq_all(spark, d)), "qoq")


# ---------------------------------------------------------------- profiles and cleaning

def q_keep_positive(spark, d):
    return fact_set(spark, d).monthly(keep_zero=False)


def q_drop_nulls(spark, d):
    wide = fact_set(spark, d).wide_monthly
    long = unpivot_monthly(wide, ids=["Name", "DataType", "Year"], coerce=False)
    return drop_nulls(long, ["MonthlyRegistrations"])


def q_month_dates(spark, d):
    return with_month_dates(fact_set(spark, d).monthly()).select(
        "Name", "DataType", "Year", "Month", "MonthNum", "Date", "MonthlyRegistrations"
    )


def q_unpivot_monthly(spark, d):
    wide = fact_set(spark, d).wide_monthly
    return unpivot_monthly(wide, ids=["Name", "DataType", "Year"], keep_null_cells=False)


def q_unpivot_annual(spark, d):
    wide = wide_csv.wide_annual(fact_set(spark, d).annual)
    return unpivot_annual(wide, ids=["Name", "DataType"], keep_null_cells=False)


def _orders(spark, d):
    return facts.table(spark, d, "orders")


def _mixed_cell() -> F.Column:
    """A text cell by order key: good, bad, suffixed, empty, fractional, beyond 2**53, blank-padded, exponent, null."""
    k = F.pmod("o_orderkey", F.lit(11))
    cells = {1: "12d", 2: "", 3: "12.5", 4: "9007199254740993", 5: "-", 6: " 7 ", 7: "1e3", 8: "0x1F", 9: "-4", 10: None}
    out = F.when(k == 0, F.col("o_custkey").cast("string"))
    for i, x in cells.items():
        out = out.when(k == i, F.lit(x))
    return out


def q_coerce_or_zero(spark, d):
    o = _orders(spark, d).withColumn("cell", _mixed_cell())
    return o.select(
        "o_orderkey",
        coerce_or_zero("o_orderpriority").alias("PriorityValue"),
        coerce_or_zero(F.substring("o_orderpriority", 1, 1)).alias("PriorityCode"),
        coerce_or_zero(F.col("o_totalprice").cast("string")).alias("PriceValue"),
        coerce_or_zero(F.format_number("o_totalprice", 2)).alias("PriceTextValue"),
        coerce_or_zero("cell").alias("CellValue"),
        coerce_count("cell").alias("CellCount"),
    )


def q_clean_numeric(spark, d):
    o = _orders(spark, d).select(
        "o_orderkey",
        F.format_number("o_totalprice", 2).alias("PriceText"),
        F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" ")).alias("CustText"),
        F.col("o_orderpriority").alias("Priority"),
    )
    return clean_numeric(o, ["PriceText", "CustText", "Priority"])


def q_flatten_columns(spark, d):
    o = _orders(spark, d).select(
        F.struct(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust")).alias("order"),
        F.struct(F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority")).alias("value"),
    )
    return flatten_columns(o)


# ---------------------------------------------------------------- rules

def _part_text(spark, d):
    p = facts.table(spark, d, "part")
    return p.select("p_partkey", "p_name", facts.part_category(F.col("p_partkey")).alias("CategoryText"))


def q_category_file_rules(spark, d):
    p = _part_text(spark, d)
    return p.select("p_partkey", "CategoryText", categorize("CategoryText", FILE_RULES).alias("GroupName"))


def q_category_store_rules(spark, d):
    p = _part_text(spark, d)
    return p.select("p_partkey", "CategoryText", categorize("CategoryText", STORE_RULES).alias("GroupName"))


def q_category_custom_rules(spark, d):
    p = _part_text(spark, d)
    return p.select("p_partkey", "p_name", categorize("p_name", CUSTOM_RULES).alias("GroupName"))


def q_group_name(spark, d):
    a = annual_once(spark, d)
    return a.withColumn("GroupName", group_name("DataType", "Name", STORE_RULES))


# ---------------------------------------------------------------- sources

def _write_monthly_reports(spark, d) -> str:
    out = scratch_path(spark, "reports")
    wide_csv.write_reports(fact_set(spark, d).wide_monthly, out, "monthly")
    return out


def _write_annual_reports(spark, d) -> str:
    out = scratch_path(spark, "reports")
    wide_csv.write_reports(wide_csv.annual_report_frame(fact_set(spark, d).annual), out, "annual")
    return out


def q_src_wide_csv(spark, d):
    loaded = wide_csv.load_reports(spark, _write_monthly_reports(spark, d), "monthly", keep_zero=True)
    return loaded.facts.select("Name", "DataType", "Year", "Month", "MonthlyRegistrations")


def q_union_all(spark, d):
    loaded = wide_csv.load_reports(spark, _write_annual_reports(spark, d), "annual", keep_zero=True)
    return loaded.facts


def q_src_file_meta(spark, d):
    src = _write_monthly_reports(spark, d)
    files = wide_csv.list_report_files(spark, src, "monthly")
    loaded = wide_csv.load_reports(spark, src, "monthly", keep_zero=True)
    per_report = loaded.facts.groupBy("DataType", "Year").agg(F.countDistinct("Name").alias("Entities"))
    reports = files.select(
        "Report", F.col("Kind").alias("DataType"), wide_csv.year_of_report(F.col("Report")).alias("Year")
    ).distinct()
    return reports.join(per_report, ["DataType", "Year"]).select("Report", "DataType", "Year", "Entities")


#: Lines of one file of an extra report, about.
EXTRA_ROWS = 1_000_000


def _write_lines(lines: DataFrame, out: str) -> None:
    """(Report, n, line, deal) -> reports of one CSV file for each ``EXTRA_ROWS`` lines, about; line 0 of a report heads every file."""
    rows = lines.where("n > 0")
    chunks = rows.groupBy("Report").agg(F.ceil(F.count(F.lit(1)) / EXTRA_ROWS).cast("int").alias("Chunks"))
    chunks = materialize(chunks, "extra-heads")  # one row per report
    files = chunks.agg(F.sum("Chunks")).first()[0] or 1
    heads = lines.where("n = 0").join(chunks, "Report").withColumn("Chunk", F.explode(F.sequence(F.lit(0), F.col("Chunks") - 1)))
    rows = rows.join(chunks, "Report").withColumn("Chunk", F.pmod("deal", F.col("Chunks")).cast("int"))
    dealt = heads.unionByName(rows).select("Report", "Chunk", "n", "line").repartition(files, "Report", "Chunk")
    wide_csv.write_lines(dealt, out, ["Report", "Chunk"], ["n"])


def _extra_reports(annual: DataFrame, kind: str, prefix: str, suffix: str, head: str, row: str) -> DataFrame:
    """Reports made of the annual facts of one kind, one a year: ``head`` and ``row`` are SQL for their lines; ``deal`` is a hash of a row's name."""
    a = annual.where(F.col("DataType") == kind).withColumn("Report", F.concat(F.lit(prefix), F.col("Year").cast("string"), F.lit(suffix)))
    heads = a.select("Report", "Year").distinct().select("Report", F.lit(0).alias("n"), F.expr(head).alias("line"), F.lit(0).cast("bigint").alias("deal"))
    return heads.unionByName(a.select("Report", F.lit(1).alias("n"), F.expr(row).alias("line"), F.xxhash64("Name").alias("deal")))


def q_src_rejects(spark, d):
    """Good reports beside reports of every reject reason of the annual axis."""
    out = scratch_path(spark, "reports")
    fs = fact_set(spark, d, by_month=False)
    annual = materialize(fs.annual, "annual")
    wide_csv.write_reports(wide_csv.annual_report_frame(annual), out, "annual")
    maker = "Y_Maker_" + wide_csv.ANNUAL_MARKER
    fuel = "Y_Fuel_" + wide_csv.ANNUAL_MARKER
    year = "concat('Maker_Maker,Calendar Year_', Year)"
    for tag, kind, prefix, suffix, head, row in (
        ("fuel", CATEGORY_TYPE, fuel, ".csv", "concat('Fuel_Fuel,Calendar Year_', Year)", "concat(Name, ',', Registrations)"),
        ("totals", MAKER_TYPE, maker, "_totals.csv", "'Maker_Maker,TOTAL_TOTAL'", "concat(Name, ',', Registrations)"),
        ("nameless", MAKER_TYPE, maker, "_nameless.csv", "concat('Other,Calendar Year_', Year)", "concat(Name, ',', Registrations)"),
        ("ragged", MAKER_TYPE, maker, "_ragged.csv", year, "concat(Name, ',', Registrations, ',', '1,234')"),
        ("empty", MAKER_TYPE, maker, "_empty.csv", "' '", "' '"),  # blank lines only
        ("endless", MAKER_TYPE, maker, "_endless.csv", "concat('Maker_Maker,Calendar Year_', Year, ',\"open')", "concat(Name, ',', Registrations)"),
    ):
        _write_lines(_extra_reports(annual, kind, prefix, suffix, head, row), f"{out}/{tag}")
    return wide_csv.load_reports(spark, out, "annual").rejects


def _odd_name() -> F.Column:
    """Names with a comma, quotes and line breaks, by their length and year."""
    n, k = F.col("Name"), F.pmod(F.length("Name") + F.col("Year"), F.lit(4))
    return F.when(k == 0, F.replace(n, F.lit(" "), F.lit("\n"))).when(k == 1, F.concat(F.lit('"'), n, F.lit('",\n'))).when(k == 2, F.concat(n, F.lit(', "x"'))).otherwise(n)


def q_src_quoted_cells(spark, d):
    """Reports whose names hold commas, quotes and line breaks, written and loaded again."""
    out = scratch_path(spark, "reports")
    odd = fact_set(spark, d).annual.withColumn("Name", _odd_name())
    wide_csv.write_reports(wide_csv.annual_report_frame(odd), out, "annual")
    return wide_csv.load_reports(spark, out, "annual").facts


def q_csv_sink(spark, d):
    """Serial numbers and names of the written annual reports, as they stand in the files."""
    out = _write_annual_reports(spark, d)
    _, records = wide_csv.scan_reports(spark, out, "annual")
    return records.select(wide_csv.report_of_path(F.col("path")).alias("Report"), wide_csv.split_line(F.col("record"))[0].cast("bigint").alias("Serial"))


def q_csv_named_sink(spark, d):
    """Annual reports as single named CSV files, each opened by its name with a plain CSV reader."""
    out = scratch_path(spark, "reports")
    names = wide_csv.write_reports(wide_csv.annual_report_frame(fact_set(spark, d).annual), out, "annual", named=True)

    def opened(name):
        df = spark.read.option("header", "true").csv(f"{out}/{name}")
        serial, entity, period, _ = df.columns
        return df.select(F.lit(name).alias("Report"), F.col(serial).cast("bigint").alias("Serial"), F.col(entity).alias("Name"), F.col(period).cast("bigint").alias("Registrations"))

    return reduce(DataFrame.unionByName, map(opened, names))  # one file per kind and year


def q_store_infile_dup(spark, d):
    """Store facts where, beside each maker report, one that holds every key twice arrives before it by name: refused whole."""
    out = scratch_path(spark, "reports")
    annual = materialize(fact_set(spark, d, by_month=False).annual, "annual")
    wide_csv.write_reports(wide_csv.annual_report_frame(annual), out, "annual")
    twice = annual.unionByName(annual.withColumn("Registrations", F.col("Registrations") + 1))
    prefix = "Y_Maker_" + wide_csv.ANNUAL_MARKER + "0_"
    _write_lines(_extra_reports(twice, MAKER_TYPE, prefix, ".csv", "concat('Maker_Maker,Calendar Year_', Year)", "concat(Name, ',', Registrations)"), f"{out}/twice")
    loaded = wide_csv.load_reports(spark, out, "annual", keep_zero=False)
    return wide_csv.unique_reports(loaded, ["Name", "DataType", "Year"]).facts


def q_store_unique_reports(spark, d):
    """Store build over reports where every maker report arrives twice (a
    second copy under a later name): the copies repeat keys and are refused."""
    out = scratch_path(spark, "reports")
    annual = materialize(fact_set(spark, d, by_month=False).annual, "annual")
    wide_csv.write_reports(wide_csv.annual_report_frame(annual), out, "annual")
    prefix = "Y_Maker_" + wide_csv.ANNUAL_MARKER
    copies = _extra_reports(annual, MAKER_TYPE, prefix, "_copy.csv", "concat('Maker_Maker,Calendar Year_', Year)", "concat(Name, ',', Registrations)")
    _write_lines(copies, f"{out}/copies")
    loaded = wide_csv.load_reports(spark, out, "annual", keep_zero=False)
    return wide_csv.unique_reports(loaded, ["Name", "DataType", "Year"]).rejects


def q_store_chain_reports(spark, d):
    """Maker reports of two years each: every report shares keys with the next, so every second one is refused."""
    out = scratch_path(spark, "reports")
    annual = materialize(fact_set(spark, d, by_month=False).annual.where(F.col("DataType") == MAKER_TYPE), "annual")
    after = annual.select("Name", (F.col("Year") - 1).alias("Year"), F.col("Registrations").alias("Next"))
    both = annual.join(after, ["Name", "Year"], "left")
    head = "concat('Maker_Maker,Calendar Year_', Year, ',Calendar Year_', Year + 1)"
    row = "concat(Name, ',', Registrations, ',', coalesce(Next, 0))"
    _write_lines(_extra_reports(both, MAKER_TYPE, "Y_Maker_" + wide_csv.ANNUAL_MARKER, ".csv", head, row), out)
    loaded = wide_csv.load_reports(spark, out, "annual", keep_zero=False)
    return wide_csv.unique_reports(loaded, ["Name", "DataType", "Year"]).rejects


def q_load_file_profile(spark, d):
    loaded = wide_csv.load_reports(spark, _write_monthly_reports(spark, d), "monthly", keep_zero=True)
    f = grouped(loaded.facts, FILE_RULES)
    return f.select("Name", "DataType", "Year", "Month", "MonthNum", "Date", "MonthlyRegistrations")


def q_load_store_profile(spark, d):
    loaded = wide_csv.load_reports(spark, _write_monthly_reports(spark, d), "monthly", keep_zero=False)
    store = FactStore.monthly(spark, scratch_path(spark, "store"))
    store.create(loaded.facts)
    m = with_month_dates(store.read())
    return m.select(
        "Name",
        "DataType",
        "Year",
        "Month",
        "Date",
        "MonthlyRegistrations",
        group_name("DataType", "Name", STORE_RULES).alias("MappedName"),
    )


# ---------------------------------------------------------------- store

def _store_split(spark, d):
    """The store-profile facts split by year into an initial load and a
    later batch that overlaps it by one year."""
    fs = fact_set(spark, d)
    m = fs.monthly_positive
    last = fs.counts.agg(F.max("Year")).first()[0]
    return m.where(F.col("Year") < last), m.where(F.col("Year") >= last - 1)


def q_store_roundtrip(spark, d):
    store = FactStore.monthly(spark, scratch_path(spark, "store"))
    store.create(fact_set(spark, d, reuse=False).monthly_positive)
    return store.read()


def q_store_dup_keys(spark, d):
    initial, batch = _store_split(spark, d)
    store = FactStore.monthly(spark, scratch_path(spark, "store"))
    store.create(initial)
    return store.conflicts(batch)


def q_store_append_new(spark, d):
    initial, batch = _store_split(spark, d)
    store = FactStore.monthly(spark, scratch_path(spark, "store"))
    store.create(initial)
    store.append(batch, on_conflict="skip")
    return store.read()


def q_store_inbatch_dup(spark, d):
    """A batch that holds keys of its last year twice: the lesser row of a key is taken, the other handed back."""
    initial, batch = _store_split(spark, d)
    store = FactStore.monthly(spark, scratch_path(spark, "store"))
    store.create(initial)
    more = batch.withColumn("MonthlyRegistrations", F.col("MonthlyRegistrations") + 5)
    res = store.append(batch.unionByName(more), on_conflict="skip")
    kept = store.read().withColumn("Reason", F.lit(None).cast("string"))
    return kept.unionByName(res.dropped)


def q_store_two_writers(spark, d):
    """Two writers append at the same time; their batches share the facts of the last year."""
    fs = fact_set(spark, d)
    last = fs.counts.agg(F.max("Year")).first()[0]
    m = fs.monthly_positive
    path = scratch_path(spark, "store")
    FactStore.monthly(spark, path).create(m.where(F.col("Year") < last - 1))
    with ThreadPoolExecutor(2) as pool:
        batches = [m.where(F.col("Year") >= last - 1), m.where(F.col("Year") >= last)]
        list(pool.map(lambda b: FactStore.monthly(spark, path).append(b), batches))
    return FactStore.monthly(spark, path).read()


def q_store_read_entity(spark, d):
    """The stored facts of one entity: a name that files without it are skipped for."""
    kind, brand, supplier = PROJECT_ENTITY
    store = FactStore.monthly(spark, scratch_path(spark, "store"))
    store.create(fact_set(spark, d, reuse=False).monthly_positive)
    return filter_entity(store.read(), kind, f"{brand} S{supplier}")


def q_stream_ingest(spark, d):
    """Reports land in a folder; a file stream ingests them into the store. Every maker
    report has a later copy with other counts, which is refused whole."""
    from cadence.streaming.ingest import IngestConfig, ingest_available

    landing = scratch_path(spark, "reports")
    fs = fact_set(spark, d)
    wide_csv.write_reports(fs.wide_monthly, landing, "monthly")
    clash = fs.counts.groupBy("DataType", "Name", "Year").agg(F.min("MonthNum").alias("MonthNum")).withColumn(
        "Registrations", F.lit(77)
    ).withColumn("Month", month_label("MonthNum"))
    clash = materialize(clash, "clash")  # its lines are counted and dealt
    head = "'Maker_Maker,Month Wise_JAN,Month Wise_FEB,Month Wise_MAR,Month Wise_APR,Month Wise_MAY,Month Wise_JUN,Month Wise_JUL,Month Wise_AUG,Month Wise_SEP,Month Wise_OCT,Month Wise_NOV,Month Wise_DEC'"
    row = "concat(Name, ',', array_join(transform(sequence(1, 12), i -> if(i = MonthNum, '77', '0')), ','))"
    copies = _extra_reports(clash, MAKER_TYPE, "Y_Maker_" + wide_csv.MONTHLY_MARKER + "z_Year_", ".csv", head, row)
    _write_lines(copies, landing)
    base = scratch_path(spark, "ingest")
    cfg = IngestConfig(
        landing_glob=f"{landing}/*/*/*.txt",
        axis="monthly",
        store_path=f"{base}/store",
        rejects_path=f"{base}/rejects",
        checkpoint=f"{base}/checkpoint",
        max_files_per_trigger=64,
    )
    return ingest_available(spark, cfg)


def q_stream_growth(spark, d):
    """Annual reports land in several batches; a growth table follows the store, touched entities only."""
    from cadence.streaming import ingest

    landing, base = scratch_path(spark, "reports"), scratch_path(spark, "ingest")
    annual = fact_set(spark, d).annual
    wide_csv.write_reports(wide_csv.annual_report_frame(annual), landing, "annual", named=True)
    cfg = ingest.IngestConfig(
        landing_glob=f"{landing}/*.csv", axis="annual", store_path=f"{base}/store", rejects_path=f"{base}/rejects", checkpoint=f"{base}/checkpoint",
        max_files_per_trigger=5, growth_path=f"{base}/growth", rules=STORE_RULES,
    )
    ingest.ingest_available(spark, cfg)
    return ingest.growth_table(spark, cfg).read()


# ---------------------------------------------------------------- catalog

def q_entity_catalog(spark, d):
    fs = fact_set(spark, d)
    # Names (and years) of the dense monthly facts are those of the counts; the
    # zero rows the dense grid adds never introduce a name.
    return entity_catalog(
        grouped(fs.annual),
        grouped(fs.monthly_positive),
        ensure_groups=("2W", "3W", "4W"),
        grouped_type=CATEGORY_TYPE,
    )


def q_year_bounds(spark, d):
    fs = fact_set(spark, d)
    return year_bounds(fs.annual, fs.monthly_positive)


def q_store_year_bounds(spark, d):
    """Year bounds of a store from the names of its folders."""
    fs, out = fact_set(spark, d), scratch_path(spark, "store")
    FactStore.annual(spark, f"{out}/annual_registrations").create(fs.annual)
    FactStore.monthly(spark, f"{out}/monthly_registrations").create(fs.monthly_positive)
    return app.store_year_range(spark, out)


def q_store_entity_catalog(spark, d):
    """The catalogue from a dictionary of names that followed two appends."""
    initial, batch = _store_split(spark, d)
    out = scratch_path(spark, "store")
    store, names = FactStore.monthly(spark, f"{out}/monthly"), NameDictionary(spark, f"{out}/names")
    for rows in (initial, batch):
        store.append(rows)
        names.refresh(rows)
    known = grouped(names.read())
    return entity_catalog(known, known.limit(0), ensure_groups=("2W", "3W", "4W"), grouped_type=CATEGORY_TYPE)


def q_preview_head(spark, d):
    return preview(annual_once(spark, d), ["DataType", "Name", "Year"], 5)


def q_preview_head_monthly(spark, d):
    return preview(fact_set(spark, d).monthly(), ["DataType", "Name", "Year", "Month"], 5)


def q_fn_safe_name(spark, d):
    p = facts.table(spark, d, "pages")
    return p.select("page_id", safe_name("url").alias("SafeName"))


QUERIES: dict[str, Query] = {
    "agg_annual": q_agg_annual,
    "lag_year": q_lag_year,
    "pct_change": q_pct_change,
    "first_period_mask": q_first_period_mask,
    "yoy_growth": q_yoy_growth,
    "agg_quarterly": q_agg_quarterly,
    "lag_quarter": q_lag_quarter,
    "quarter_label": q_quarter_label,
    "qoq_growth": q_qoq_growth,
    "yoy_growth_store": q_yoy_growth_store,
    "qoq_growth_store": q_qoq_growth_store,
    "filter_entity": q_filter_entity,
    "filter_year_range": q_filter_year_range,
    "growth_view_yoy": q_growth_view_yoy,
    "growth_view_qoq": q_growth_view_qoq,
    "project_growth_view": q_project_growth_view,
    "trend_series": q_trend_series,
    "format_growth_table": q_format_growth_table,
    "format_growth_table_qoq": q_format_growth_table_qoq,
    "trend_series_yoy": q_trend_series_yoy,
    "sql_growth_yoy": q_sql_growth_yoy,
    "sql_growth_qoq": q_sql_growth_qoq,
    "sql_rules": q_sql_rules,
    "trend_label": q_trend_label,
    "latest_growth": q_latest_growth,
    "best_period": q_best_period,
    "insight_yoy": q_insight_yoy,
    "insight_qoq": q_insight_qoq,
    "keep_positive": q_keep_positive,
    "drop_nulls": q_drop_nulls,
    "month_dates": q_month_dates,
    "unpivot_monthly": q_unpivot_monthly,
    "unpivot_annual": q_unpivot_annual,
    "coerce_or_zero": q_coerce_or_zero,
    "clean_numeric": q_clean_numeric,
    "flatten_columns": q_flatten_columns,
    "category_file_rules": q_category_file_rules,
    "category_store_rules": q_category_store_rules,
    "category_custom_rules": q_category_custom_rules,
    "group_name": q_group_name,
    "src_wide_csv": q_src_wide_csv,
    "src_file_meta": q_src_file_meta,
    "src_rejects": q_src_rejects,
    "src_quoted_cells": q_src_quoted_cells,
    "csv_sink": q_csv_sink,
    "csv_named_sink": q_csv_named_sink,
    "union_all": q_union_all,
    "load_file_profile": q_load_file_profile,
    "load_store_profile": q_load_store_profile,
    "store_roundtrip": q_store_roundtrip,
    "store_dup_keys": q_store_dup_keys,
    "store_append_new": q_store_append_new,
    "store_unique_reports": q_store_unique_reports,
    "store_inbatch_dup": q_store_inbatch_dup,
    "store_infile_dup": q_store_infile_dup,
    "store_chain_reports": q_store_chain_reports,
    "store_two_writers": q_store_two_writers,
    "store_read_entity": q_store_read_entity,
    "stream_ingest": q_stream_ingest,
    "stream_growth": q_stream_growth,
    "entity_catalog": q_entity_catalog,
    "year_bounds": q_year_bounds,
    "store_entity_catalog": q_store_entity_catalog,
    "store_year_bounds": q_store_year_bounds,
    "preview_head": q_preview_head,
    "preview_head_monthly": q_preview_head_monthly,
    "fn_safe_name": q_fn_safe_name,
}

"""Registration facts derived from the driver tables.

The driver tables hold no vehicle data, so the data model is re-based:
every ``lineitem`` is one registration on its ``l_shipdate``; its maker (kind
``Manufacturer``) is the part's brand at the line's supplier, fine enough that
months, quarters and whole years without a registration occur; its detailed category (kind
``Vehicle Category``) is a text chosen by the part key, so that every keyword of
the rule sets occurs. Facts come in the two grains of the model: annual and
monthly, and as the wide reports the loader reads.

Plan at scale: lineitem (its needed columns only, projected to year and
month) joins part on the part key (sort-merge; AQE splits a hot part key, or
the lineitem side is pre-aggregated map-side when AQE cannot; auto-broadcast
only under the size threshold), then a partial aggregate in the same stage
collapses the join output to one row per entity and period before the next shuffle.
A selected kind, brand, supplier or category group is filtered below the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.calendar import MONTH_PREFIX, MONTHS, TOTAL_COLUMN, month_label, quarter_label
from cadence.functions.rules import CATEGORY_TYPE, FILE_RULES, MAKER_TYPE, Rules, categorize, group_name
from cadence.operators.reshape import keep_positive, unpivot_monthly
from cadence.session import materialize

# Detailed category texts, by part key (rebase rule).
CATEGORY_TEXTS = (
    "TWO WHEELER(NT)", " two wheeler(t) ", "THREE WHEELER(T)", "THREE WHEELER(NT)", "FOUR WHEELER (INVALID CARRIAGE)",
    "LIGHT MOTOR VEHICLE", "MEDIUM MOTOR VEHICLE", "HEAVY MOTOR VEHICLE", "MOTOR VEHICLE", "LIGHT GOODS VEHICLE",
    "HEAVY GOODS VEHICLE", "MEDIUM PASSENGER VEHICLE", "BUS", "TRACTOR", "CONTRACTOR", "EARTH MOVING EQUIPMENT",
    "DUMPER", "CRANE MOUNTED", "OTHER THAN MENTIONED ABOVE", "THREE WHEELER AND TWO WHEELER", "AMBULANCE",
)


# Columns of the driver tables that the queries read (explicit schemas skip the
# footer-inference job and pin the scan's ReadSchema to these columns).
TABLE_SCHEMAS = {
    "lineitem": "l_partkey bigint, l_suppkey bigint, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "pages": "page_id bigint, url string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = TABLE_SCHEMAS.get(name)
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def part_category(p_partkey) -> F.Column:
    texts = F.array(*[F.lit(t) for t in CATEGORY_TEXTS])
    return F.element_at(texts, (F.pmod(p_partkey, F.lit(len(CATEGORY_TEXTS))) + 1).cast("int"))


def maker_name(brand, supplier) -> F.Column:
    return F.concat(brand, F.lit(" S"), supplier.cast("string"))


def _aqe_splits_skew(spark: SparkSession) -> bool:
    on = lambda k, d: str(spark.conf.get(k, d)).lower() == "true"
    return on("spark.sql.adaptive.enabled", "true") and on("spark.sql.adaptive.skewJoin.enabled", "true")


def monthly_counts(
    spark: SparkSession,
    sf_dir: str,
    pre_aggregate: bool | None = None,
    by_month: bool = True,
    kind: str | None = None,
    brand: str | None = None,
    supplier: int | None = None,
    group: str | None = None,
    rules: Rules = FILE_RULES,
    grouped: bool = False,
) -> DataFrame:
    """(DataType, Name, Year, MonthNum, n): registrations per entity and month
    (``by_month=False``: per entity and year, MonthNum NULL — for annual-only plans).

    ``kind`` keeps one kind and reads only its columns; ``brand`` and
    ``supplier`` select makers, ``group`` (of ``rules``) categories: these
    filters sit on the tables, below the join. ``grouped`` counts categories by
    their group (of ``rules``), mapped once a part, not by their text.

    Every row counts for its maker and for its category in one aggregate, so the
    categories shrink to a few hundred rows a task before the shuffle.

    Join-first plan: one shuffle of the narrow lineitem projection for the join
    (AQE's skew-join splits a hot part key), the partial aggregate in the
    join's stage. Pre-aggregated plan: lineitems are first counted per
    part key (and supplier) and period map-side, so a part key holding a third of all
    rows shuffles at most that many rows per map task without relying on
    AQE, at the cost of a second (smaller) shuffle into the join.
    ``pre_aggregate=None`` picks join-first when the session has AQE skew-join
    splitting on, else the pre-aggregated plan.
    """
    if pre_aggregate is None:
        pre_aggregate = not _aqe_splits_skew(spark)
    makers, categories = kind in (None, MAKER_TYPE), kind in (None, CATEGORY_TYPE)
    period = ["Year", "MonthNum"] if by_month else ["Year"]
    cols = [F.year("l_shipdate").alias("Year")] + ([F.month("l_shipdate").alias("MonthNum")] if by_month else [])
    li = table(spark, sf_dir, "lineitem")
    if supplier is not None:
        li = li.where(F.col("l_suppkey") == supplier)
    keys = ["l_partkey", "l_suppkey"] if makers else ["l_partkey"]
    li = li.select(*keys, *cols)
    if pre_aggregate:
        li = li.groupBy(*keys, *period).agg(F.count(F.lit(1)).alias("k"))
    else:
        li = li.withColumn("k", F.lit(1).cast("bigint"))
    pt = table(spark, sf_dir, "part")
    if brand is not None:
        pt = pt.where(F.col("p_brand") == brand)
    if group is not None:
        pt = pt.where(categorize(part_category(F.col("p_partkey")), rules) == group)
    category = part_category(F.col("p_partkey"))
    category = categorize(category, rules) if grouped else category
    pt = pt.select("p_partkey", *["p_brand"] * makers, *[category.alias(CATEGORY_TYPE)] * categories)
    rows = li.join(pt, li.l_partkey == pt.p_partkey)
    if makers:
        rows = rows.withColumn(MAKER_TYPE, maker_name(F.col("p_brand"), F.col("l_suppkey")))
    kinds = [MAKER_TYPE] * makers + [CATEGORY_TYPE] * categories
    if kind is None:
        named = rows.select(*kinds, *period, "k").unpivot([*period, "k"], kinds, "DataType", "Name")
    else:
        named = rows.select(F.lit(kind).alias("DataType"), F.col(kind).alias("Name"), *period, "k")
    counts = named.groupBy("DataType", "Name", *period).agg(F.sum("k").alias("n"))
    if not by_month:  # keep the shape; MonthNum is not a grouping key, so the
        # (DataType, Name, Year) partitioning carries on to the annual aggregate
        counts = counts.select("DataType", "Name", "Year", F.lit(None).cast("int").alias("MonthNum"), "n")
    return counts


def quarterly_from_counts(counts: DataFrame, rules: Rules | None = FILE_RULES) -> DataFrame:
    """Dense quarterly facts straight from the counts: (DataType, Name, Year, Quarter, QuarterYear, QuarterlyRegistrations).

    Names are mapped by ``rules`` before the sum. A quarter that the (kind,
    year) covers and the entity has no registration in is 0. One aggregate with a column a
    quarter; the covered quarters are one row per kind and year.
    """
    named = counts if rules is None else counts.withColumn("Name", group_name("DataType", "Name", rules))
    last = counts.groupBy("DataType", "Year").agg(F.ceil(F.max("MonthNum") / 3).cast("int").alias("LastQuarter"))
    quarter = F.ceil(F.col("MonthNum") / 3)
    sums = [F.coalesce(F.sum(F.when(quarter == q, F.col("n"))), F.lit(0)).cast("bigint").alias(f"q{q}") for q in range(1, 5)]
    wide = named.where(F.col("Name").isNotNull()).groupBy("DataType", "Name", "Year").agg(*sums).join(last, ["DataType", "Year"])
    long = wide.select("DataType", "Name", "Year", "LastQuarter", F.posexplode(F.array("q1", "q2", "q3", "q4")).alias("pos", "QuarterlyRegistrations"))
    long = long.withColumn("Quarter", F.col("pos") + 1).where(F.col("Quarter") <= F.col("LastQuarter"))
    return long.select(
        "DataType", "Name", "Year", "Quarter", quarter_label(F.col("Year"), F.col("Quarter")).alias("QuarterYear"), "QuarterlyRegistrations"
    )


def wide_monthly(counts: DataFrame) -> DataFrame:
    """Wide monthly report rows: (DataType, Name, Year, 'Month Wise_JAN'.., TOTAL_TOTAL).

    A month the report covers but the entity has no registration in is 0; a
    month after the last covered month of a (kind, year) is NULL (not in the
    report), like a partial-year report with fewer columns.
    """
    last = counts.groupBy("DataType", "Year").agg(F.max("MonthNum").alias("LastMonth"))
    # A conditional aggregate is the pivot in one aggregation (one exchange);
    # DataFrame.pivot would aggregate per month first, then pivot (two).
    by_month = [F.sum(F.when(F.col("MonthNum") == F.lit(i), F.col("n"))).alias(str(i)) for i in range(1, 13)]
    piv = counts.groupBy("DataType", "Name", "Year").agg(*by_month)
    piv = piv.join(last, ["DataType", "Year"])  # one row per report: AQE broadcasts it
    cells = {}
    for i, m in enumerate(MONTHS, 1):
        covered = F.lit(i) <= F.col("LastMonth")
        cells[MONTH_PREFIX + m] = F.when(covered, F.coalesce(F.col(str(i)), F.lit(0))).cast("bigint")
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cells.values()])
    return piv.select(
        "DataType",
        "Name",
        "Year",
        *[c.alias(k) for k, c in cells.items()],
        total.cast("bigint").alias(TOTAL_COLUMN),
    )


def monthly_from_counts(counts: DataFrame, keep_zero: bool = True) -> DataFrame:
    """Long monthly facts (Name, DataType, Year, Month, MonthlyRegistrations).

    keep_zero=True is the file profile (empty covered months are 0 rows);
    False is the store profile (only positive counts are facts).
    """
    long = unpivot_monthly(wide_monthly(counts), ids=["Name", "DataType", "Year"], keep_null_cells=False)
    return long if keep_zero else keep_positive(long, "MonthlyRegistrations")


def annual_from_counts(counts: DataFrame) -> DataFrame:
    """Long annual facts (Name, DataType, Year, Registrations)."""
    return counts.groupBy("Name", "DataType", "Year").agg(F.sum("n").cast("bigint").alias("Registrations"))


class FactSet:
    """The facts of one query over one data folder.

    The per-(kind, entity, year, month) counts are computed once (one pass of
    the scan + join) and written to the shared checkpoint folder; annual,
    monthly and wide facts all derive from that small table. Plans that read
    the counts only once (annual facts) pass ``reuse=False``.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, reuse: bool = True, by_month: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        counts = monthly_counts(spark, sf_dir, by_month=by_month)
        # reuse=False: a plan that reads the counts once keeps them inline (one job).
        self.counts = materialize(counts, "counts") if reuse else counts

    @property
    def annual(self) -> DataFrame:
        return annual_from_counts(self.counts)

    def monthly(self, keep_zero: bool = True) -> DataFrame:
        return monthly_from_counts(self.counts, keep_zero)

    @property
    def monthly_positive(self) -> DataFrame:
        """Store-profile monthly facts (counts > 0) straight from the counts: the
        same rows as ``monthly(keep_zero=False)`` without the dense round trip
        (every count cell is >= 1)."""
        return self.counts.select(
            "Name",
            "DataType",
            "Year",
            month_label("MonthNum").alias("Month"),
            F.col("n").cast("bigint").alias("MonthlyRegistrations"),
        )

    @property
    def wide_monthly(self) -> DataFrame:
        return wide_monthly(self.counts)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def monthly_facts(spark: SparkSession, sf_dir: str, keep_zero: bool = True) -> DataFrame:
    return FactSet(spark, sf_dir).monthly(keep_zero)


def annual_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FactSet(spark, sf_dir).annual

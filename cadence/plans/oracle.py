"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written independently of the Spark plans, constants included (only the parameters of
the dashboard-style queries are shared): CTEs over the raw driver tables,
``lag`` windows, ``round_even`` for the half-even rounding, ``nullif`` for the
zero predecessor, ``row_number`` for latest / best period.
"""

from __future__ import annotations

from cadence.plans import registry as R

# Fixed values, written out here on their own so that a slip in the engine's tables shows.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
FILE_RULES = [
    ("2W", ["TWO WHEELER"]),
    ("3W", ["THREE WHEELER"]),
    ("4W", ["FOUR WHEELER", "GOODS VEHICLE", "PASSENGER VEHICLE", "MOTOR VEHICLE", "TRAC", "EARTH MOVING"]),
]
STORE_RULES = [
    ("2W", ["TWO WHEELER"]),
    ("3W", ["THREE WHEELER"]),
    ("4W", ["FOUR WHEELER", "LIGHT MOTOR VEHICLE", "MEDIUM MOTOR VEHICLE", "HEAVY MOTOR VEHICLE", "GOODS VEHICLE",
            "PASSENGER VEHICLE", "BUS", "TRAC", "EARTH MOVING", "DUMPER", "CRANE"]),
]
CUSTOM_RULES = [("METAL", ["BOLT", "GEAR", "RING", "ROD", "PLATE", "ANVIL"]), ("GADGET", ["WIDGET", "GIZMO"])]
CATEGORY_TEXTS = [
    "TWO WHEELER(NT)", " two wheeler(t) ", "THREE WHEELER(T)", "THREE WHEELER(NT)", "FOUR WHEELER (INVALID CARRIAGE)",
    "LIGHT MOTOR VEHICLE", "MEDIUM MOTOR VEHICLE", "HEAVY MOTOR VEHICLE", "MOTOR VEHICLE", "LIGHT GOODS VEHICLE",
    "HEAVY GOODS VEHICLE", "MEDIUM PASSENGER VEHICLE", "BUS", "TRACTOR", "CONTRACTOR", "EARTH MOVING EQUIPMENT",
    "DUMPER", "CRANE MOUNTED", "OTHER THAN MENTIONED ABOVE", "THREE WHEELER AND TWO WHEELER", "AMBULANCE",
]
YOY_TEXT = {
    "head": "The **{name}** shows a **{trend} YoY growth of {growth}%** in the latest available year within the selected range.",
    "positive": " This indicates a strong expansion compared to the previous year.",
    "negative": " This suggests a contraction in registrations compared to the previous year.",
    "stable": " This indicates a relatively stable registration count compared to the previous year.",
    "best": "\n\nIts highest YoY growth was **{growth}%** in **{period}**.",
}
QOQ_TEXT = {
    "head": "The **{name}** shows a **{trend} QoQ growth of {growth}%** in the latest available quarter within the selected range.",
    "positive": " This indicates healthy sequential growth.",
    "negative": " This suggests a slowdown in registrations compared to the previous quarter.",
    "stable": " This indicates a relatively stable registration count compared to the previous quarter.",
    "best": "\n\nIts highest QoQ growth was **{growth}%** in **{period}**.",
}


def _q(s: str) -> str:
    """A Python string as a DuckDB string expression (newlines via chr(10))."""
    parts = ["'" + p.replace("'", "''") + "'" for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"
MONTH_NUM = "CASE Month " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(MONTHS, 1)) + " END"
CAT_CASE = "[" + ", ".join(f"'{t}'" for t in CATEGORY_TEXTS) + f"][p_partkey % {len(CATEGORY_TEXTS)} + 1]"


def rules_sql(text: str, rules, fallback: str = "Other") -> str:
    t = f"upper(trim(coalesce(CAST({text} AS VARCHAR), 'NAN')))"
    whens = []
    for label, kws in rules:
        cond = " OR ".join(f"contains({t}, '{k}')" for k in kws)
        whens.append(f"WHEN {cond} THEN '{label}'")
    return f"CASE {' '.join(whens)} ELSE '{fallback}' END"


def group_sql(rules, name: str = "Name") -> str:
    return f"CASE WHEN DataType = 'Vehicle Category' THEN {rules_sql(name, rules)} ELSE {name} END"


def growth_sql(cur: str, prev: str) -> str:
    return (
        f"round_even((({cur} - {prev})::DOUBLE / nullif({prev}, 0)::DOUBLE * 100::DOUBLE) * 100::DOUBLE, 0)"
        " / 100::DOUBLE"
    )


PRICE_TEXT = "format('{:,.2f}', o_totalprice)"


NUMBER = "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"


def coz(x: str) -> str:
    return f"CAST(CASE WHEN regexp_full_match(trim({x}), '{NUMBER}') THEN coalesce(TRY_CAST(trim({x}) AS DOUBLE), 0) ELSE 0 END AS DOUBLE)"


def count_of(x: str) -> str:
    return (
        f"CAST(CASE WHEN regexp_full_match(trim({x}), '[+-]?[0-9]+') THEN TRY_CAST(trim({x}) AS BIGINT) "
        f"WHEN regexp_full_match(trim({x}), '{NUMBER}') THEN TRY_CAST(trunc(TRY_CAST(trim({x}) AS DOUBLE)) AS BIGINT) ELSE 0 END AS BIGINT)"
    )


CELL = (
    "CASE o_orderkey % 11 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN '12d' WHEN 2 THEN '' WHEN 3 THEN '12.5' "
    "WHEN 4 THEN '9007199254740993' WHEN 5 THEN '-' WHEN 6 THEN ' 7 ' WHEN 7 THEN '1e3' WHEN 8 THEN '0x1F' WHEN 9 THEN '-4' END"
)


# ---------------------------------------------------------------- shared CTEs

FACTS = f"""
cells AS (
  SELECT p_brand || ' S' || CAST(l_suppkey AS VARCHAR) AS mk, {CAT_CASE} AS vc,
         CAST(year(l_shipdate) AS INTEGER) AS Year, CAST(month(l_shipdate) AS INTEGER) AS MonthNum,
         count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY ALL),
counts AS (
  SELECT 'Manufacturer' AS DataType, mk AS Name, Year, MonthNum, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY ALL
  UNION ALL
  SELECT 'Vehicle Category' AS DataType, vc AS Name, Year, MonthNum, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY ALL),
annual AS (
  SELECT Name, DataType, Year, CAST(sum(n) AS BIGINT) AS Registrations FROM counts GROUP BY ALL),
lastm AS (SELECT DataType, Year, max(MonthNum) AS LastMonth FROM counts GROUP BY ALL),
ey AS (SELECT DISTINCT DataType, Name, Year FROM counts),
grid AS (
  SELECT ey.DataType, ey.Name, ey.Year, g.MonthNum
  FROM ey JOIN lastm ON ey.DataType = lastm.DataType AND ey.Year = lastm.Year
  JOIN (SELECT CAST(range AS INTEGER) AS MonthNum FROM range(1, 13)) g ON g.MonthNum <= lastm.LastMonth),
monthly AS (
  SELECT grid.Name, grid.DataType, grid.Year, {MONTH_LIST}[grid.MonthNum] AS Month,
         CAST(coalesce(c.n, 0) AS BIGINT) AS MonthlyRegistrations
  FROM grid LEFT JOIN counts c
    ON c.DataType = grid.DataType AND c.Name = grid.Name AND c.Year = grid.Year AND c.MonthNum = grid.MonthNum),
mdates AS (
  SELECT Name, DataType, Year, Month, MonthNum, make_date(Year, MonthNum, 1) AS Date, MonthlyRegistrations
  FROM (SELECT *, {MONTH_NUM} AS MonthNum FROM monthly) WHERE MonthNum IS NOT NULL)"""

def growth_ctes(rules=FILE_RULES, sfx: str = "", annual: str = "annual", mdates: str = "mdates") -> str:
    """YoY / QoQ CTEs (names suffixed by ``sfx``) over the given fact CTEs."""
    return f"""
ga{sfx} AS (SELECT {group_sql(rules)} AS Name, DataType, Year, Registrations FROM {annual}),
aa{sfx} AS (
  SELECT DataType, Name, Year, CAST(sum(Registrations) AS BIGINT) AS Registrations
  FROM ga{sfx} WHERE Name IS NOT NULL GROUP BY ALL),
ly{sfx} AS (
  SELECT *, lag(Registrations) OVER (PARTITION BY DataType, Name ORDER BY Year) AS PrevYearRegistrations
  FROM aa{sfx}),
yoy{sfx} AS (
  SELECT DataType, Name, Year, Registrations, PrevYearRegistrations,
         {growth_sql('Registrations', 'PrevYearRegistrations')} AS YoYGrowth
  FROM ly{sfx}),
gm{sfx} AS (SELECT {group_sql(rules)} AS Name, DataType, Year, Month, Date, MonthlyRegistrations FROM {mdates}),
aq{sfx} AS (
  SELECT DataType, Name, CAST(year(Date) AS INTEGER) AS Year, CAST(quarter(Date) AS INTEGER) AS Quarter,
         CAST(year(Date) AS VARCHAR) || '-Q' || CAST(quarter(Date) AS VARCHAR) AS QuarterYear,
         CAST(sum(MonthlyRegistrations) AS BIGINT) AS QuarterlyRegistrations
  FROM gm{sfx} WHERE Name IS NOT NULL GROUP BY ALL),
lq{sfx} AS (
  SELECT *, lag(QuarterlyRegistrations) OVER (PARTITION BY DataType, Name ORDER BY Year, Quarter)
            AS PrevQuarterRegistrations FROM aq{sfx}),
qoq{sfx} AS (
  SELECT DataType, Name, Year, Quarter, QuarterYear, QuarterlyRegistrations, PrevQuarterRegistrations,
         {growth_sql('QuarterlyRegistrations', 'PrevQuarterRegistrations')} AS QoQGrowth
  FROM lq{sfx})"""


GROWTH = growth_ctes()
STORE_FACTS = """
annual_s AS (SELECT * FROM annual WHERE Registrations > 0),
mdates_s AS (SELECT * FROM mdates WHERE MonthlyRegistrations > 0)"""
STORE_GROWTH = growth_ctes(STORE_RULES, "_s", "annual_s", "mdates_s")


def with_ctes(*blocks: str, body: str) -> str:
    return "WITH " + ",".join(blocks) + "\n" + body


def _insight_body(view: str, metric: str) -> str:
    if metric == "yoy":
        g, o, lbl, texts = "YoYGrowth", "CAST(Year AS BIGINT)", "CAST(Year AS VARCHAR)", YOY_TEXT
    else:
        g, o, lbl, texts = "QoQGrowth", "(CAST(Year AS BIGINT) * 4 + Quarter)", "QuarterYear", QOQ_TEXT
    trend = "CASE WHEN LatestGrowth > 0 THEN 'positive' WHEN LatestGrowth < 0 THEN 'negative' ELSE 'stable' END"
    fmt = "CASE WHEN {x} IS NULL THEN 'nan' ELSE printf('%.2f', {x}) END"
    head = texts["head"]
    i_name = head.index("{name}")
    i_trend = head.index("{trend}")
    i_growth = head.index("{growth}")
    head_sql = (
        f"{_q(head[:i_name])} || Name || {_q(head[i_name + 6:i_trend])} || ({trend}) || "
        f"{_q(head[i_trend + 7:i_growth])} || {fmt.format(x='LatestGrowth')} || {_q(head[i_growth + 8:])}"
    )
    tail_sql = (
        f"CASE ({trend}) WHEN 'positive' THEN {_q(texts['positive'])} "
        f"WHEN 'negative' THEN {_q(texts['negative'])} ELSE {_q(texts['stable'])} END"
    )
    best = texts["best"]
    j_g = best.index("{growth}")
    j_p = best.index("{period}")
    best_sql = (
        f"CASE WHEN MaxGrowth > 0 THEN {_q(best[:j_g])} || {fmt.format(x='MaxGrowth')} || "
        f"{_q(best[j_g + 8:j_p])} || MaxPeriod || {_q(best[j_p + 8:])} ELSE '' END"
    )
    return f"""
ranked AS (
  SELECT DataType, Name, {g} AS g, {o} AS o, {lbl} AS lbl,
         row_number() OVER (PARTITION BY DataType, Name ORDER BY {o} DESC) AS rl,
         row_number() OVER (PARTITION BY DataType, Name ORDER BY ({g} IS NULL), {g} DESC, {o} ASC) AS rb
  FROM {view}),
lb AS (
  SELECT DataType, Name,
         max(CASE WHEN rl = 1 THEN lbl END) AS LatestPeriod,
         max(CASE WHEN rl = 1 THEN g END) AS LatestGrowth,
         max(g) AS MaxGrowth,
         max(CASE WHEN rb = 1 AND g IS NOT NULL THEN lbl END) AS MaxPeriod
  FROM ranked GROUP BY ALL),
ins AS (
  SELECT DataType, Name, LatestPeriod, LatestGrowth, ({trend}) AS Trend,
         CASE WHEN MaxGrowth > 0 THEN MaxGrowth END AS BestGrowth,
         CASE WHEN MaxGrowth > 0 THEN MaxPeriod END AS BestPeriod,
         ({head_sql}) || ({tail_sql}) || ({best_sql}) AS Insight
  FROM lb)"""


def _view_yoy(t, n, lo, hi) -> str:
    cond = []
    if t is not None:
        cond.append(f"DataType = '{t}'")
    if n is not None:
        cond.append(f"Name = '{n}'")
    if lo is not None:
        cond.append(f"Year >= {lo}")
    if hi is not None:
        cond.append(f"Year <= {hi}")
    where = " AND ".join(cond) or "true"
    return f"SELECT DataType, Name, Year, Registrations, PrevYearRegistrations, YoYGrowth FROM yoy WHERE {where}"


def _view_qoq(t, n, lo, hi) -> str:
    cond = ["QoQGrowth IS NOT NULL"]
    if t is not None:
        cond.append(f"DataType = '{t}'")
    if n is not None:
        cond.append(f"Name = '{n}'")
    if lo is not None:
        cond.append(f"Year >= {lo}")
    if hi is not None:
        cond.append(f"Year <= {hi}")
    return (
        "SELECT DataType, Name, Year, Quarter, QuarterYear, QuarterlyRegistrations, PrevQuarterRegistrations, "
        f"QoQGrowth FROM qoq WHERE {' AND '.join(cond)}"
    )


def _fmt_count(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'nan' ELSE format('{{:,}}', {x}) END"


def _report(axis_marker: str) -> str:
    return (
        "CASE DataType WHEN 'Manufacturer' THEN 'Y_Maker_' ELSE 'Y_Vehicle_Category_' END || "
        f"'{axis_marker}' || CAST(Year AS VARCHAR) || '.csv'"
    )


def build() -> dict[str, str]:
    F_ = FACTS
    G = GROWTH
    sql: dict[str, str] = {}
    # growth core
    sql["agg_annual"] = with_ctes(F_, G, body="SELECT * FROM aa")
    sql["lag_year"] = with_ctes(F_, G, body="SELECT * FROM ly")
    sql["pct_change"] = with_ctes(F_, G, body="SELECT DataType, Name, Year, YoYGrowth FROM yoy")
    sql["first_period_mask"] = with_ctes(F_, G, body="""SELECT DataType, Name, Year,
      CASE WHEN Year > min(Year) OVER w THEN Registrations END AS Registrations,
      CASE WHEN Year > min(Year) OVER w THEN PrevYearRegistrations END AS PrevYearRegistrations,
      CASE WHEN Year > min(Year) OVER w THEN YoYGrowth END AS YoYGrowth FROM yoy WINDOW w AS (PARTITION BY DataType, Name)""")
    sql["yoy_growth"] = with_ctes(F_, G, body="SELECT * FROM yoy")
    sql["agg_quarterly"] = with_ctes(F_, G, body="SELECT * FROM aq")
    sql["lag_quarter"] = with_ctes(F_, G, body="SELECT * FROM lq")
    sql["quarter_label"] = with_ctes(
        F_,
        body="SELECT Name, DataType, Year, Month, CAST(quarter(Date) AS INTEGER) AS Quarter, "
        "CAST(year(Date) AS VARCHAR) || '-Q' || CAST(quarter(Date) AS VARCHAR) AS QuarterYear FROM mdates",
    )
    sql["qoq_growth"] = with_ctes(F_, G, body="SELECT * FROM qoq")
    sql["yoy_growth_store"] = with_ctes(F_, STORE_FACTS, STORE_GROWTH, body="SELECT * FROM yoy_s")
    sql["qoq_growth_store"] = with_ctes(F_, STORE_FACTS, STORE_GROWTH, body="SELECT * FROM qoq_s")
    # views
    t, n = R.YOY_ENTITY
    lo, hi = R.VIEW_RANGE
    sql["filter_entity"] = with_ctes(F_, G, body=f"SELECT * FROM yoy WHERE DataType = '{t}' AND Name = '{n}'")
    sql["filter_year_range"] = with_ctes(F_, G, body=f"SELECT * FROM yoy WHERE Year BETWEEN {lo} AND {hi}")
    sql["growth_view_yoy"] = with_ctes(F_, G, body=_view_yoy(t, n, lo, hi))
    qt, qn = R.QOQ_ENTITY
    sql["growth_view_qoq"] = with_ctes(F_, G, body=_view_qoq(qt, qn, lo, hi))
    pt, pb, ps = R.PROJECT_ENTITY
    sql["project_growth_view"] = with_ctes(
        F_,
        G,
        body="SELECT Year, Registrations, PrevYearRegistrations, YoYGrowth FROM yoy "
        f"WHERE DataType = '{pt}' AND Name = '{pb} S{ps}'",
    )
    slo, shi = R.SERIES_RANGE
    sql["trend_series"] = with_ctes(
        F_,
        G,
        body=f"SELECT DataType, Name, QuarterYear AS X, QoQGrowth AS Y FROM ({_view_qoq(None, None, slo, shi)})",
    )
    sql["format_growth_table"] = with_ctes(
        F_,
        G,
        body="SELECT DataType, Name, CAST(Year AS VARCHAR) AS Period, "
        f"{_fmt_count('Registrations')} AS RegistrationsText, "
        f"{_fmt_count('PrevYearRegistrations')} AS PreviousText, "
        "CASE WHEN YoYGrowth IS NULL THEN 'nan%' ELSE printf('%.2f%%', YoYGrowth) END AS GrowthText FROM yoy",
    )
    sql["format_growth_table_qoq"] = with_ctes(
        F_,
        G,
        body="SELECT DataType, Name, QuarterYear AS Period, "
        f"{_fmt_count('QuarterlyRegistrations')} AS RegistrationsText, "
        f"{_fmt_count('PrevQuarterRegistrations')} AS PreviousText, "
        "CASE WHEN QoQGrowth IS NULL THEN 'nan%' ELSE printf('%.2f%%', QoQGrowth) END AS GrowthText "
        f"FROM ({_view_qoq(None, None, None, None)})",
    )
    sql["trend_series_yoy"] = with_ctes(
        F_,
        G,
        body=f"SELECT DataType, Name, CAST(Year AS VARCHAR) AS X, YoYGrowth AS Y FROM ({_view_yoy(None, None, slo, shi)})",
    )
    # SQL functions
    sql["sql_growth_yoy"] = sql["growth_view_yoy"]
    sql["sql_growth_qoq"] = sql["trend_series"]
    sql["sql_rules"] = (
        f"SELECT p_partkey, {rules_sql(CAT_CASE, FILE_RULES)} AS FileGroup, {rules_sql(CAT_CASE, STORE_RULES)} AS StoreGroup, "
        f"{rules_sql('p_name', CUSTOM_RULES)} AS CustomGroup FROM part"
    )
    # insights
    sql["trend_label"] = with_ctes(
        F_,
        G,
        body="SELECT DataType, Name, Year, YoYGrowth, CASE WHEN YoYGrowth > 0 THEN 'positive' "
        "WHEN YoYGrowth < 0 THEN 'negative' ELSE 'stable' END AS Trend FROM yoy",
    )
    vy = f"vy AS ({_view_yoy(None, None, None, None)})"
    vq = f"vq AS ({_view_qoq(None, None, None, None)})"
    sql["latest_growth"] = with_ctes(
        F_, G, vy, _insight_body("vy", "yoy"), body="SELECT DataType, Name, LatestPeriod, LatestGrowth FROM ins"
    )
    sql["best_period"] = with_ctes(
        F_, G, vq, _insight_body("vq", "qoq"), body="SELECT DataType, Name, BestGrowth, BestPeriod FROM ins"
    )
    sql["insight_yoy"] = with_ctes(F_, G, vy, _insight_body("vy", "yoy"), body="SELECT * FROM ins")
    sql["insight_qoq"] = with_ctes(F_, G, vq, _insight_body("vq", "qoq"), body="SELECT * FROM ins")
    # profiles and cleaning
    sql["keep_positive"] = with_ctes(F_, body="SELECT * FROM monthly WHERE MonthlyRegistrations > 0")
    sql["drop_nulls"] = with_ctes(F_, body="SELECT * FROM monthly")
    sql["month_dates"] = with_ctes(F_, body="SELECT * FROM mdates")
    sql["unpivot_monthly"] = with_ctes(F_, body="SELECT * FROM monthly")
    sql["unpivot_annual"] = with_ctes(F_, body="SELECT * FROM annual")
    sql["coerce_or_zero"] = (
        f"SELECT o_orderkey, {coz('o_orderpriority')} AS PriorityValue, "
        f"{coz('substring(o_orderpriority, 1, 1)')} AS PriorityCode, "
        f"{coz('CAST(o_totalprice AS VARCHAR)')} AS PriceValue, "
        f"{coz(PRICE_TEXT)} AS PriceTextValue, coalesce({coz(CELL)}, 0) AS CellValue, coalesce({count_of(CELL)}, 0) AS CellCount "
        "FROM orders"
    )
    sql["clean_numeric"] = (
        "SELECT o_orderkey, o_totalprice AS PriceText, o_custkey AS CustText, o_orderpriority AS Priority FROM orders"
    )
    sql["flatten_columns"] = (
        "SELECT o_orderkey AS order_key, o_custkey AS order_cust, o_totalprice AS value_total, "
        "o_orderpriority AS value_priority FROM orders"
    )
    # rules
    sql["category_file_rules"] = (
        f"SELECT p_partkey, {CAT_CASE} AS CategoryText, {rules_sql(CAT_CASE, FILE_RULES)} AS GroupName FROM part"
    )
    sql["category_store_rules"] = (
        f"SELECT p_partkey, {CAT_CASE} AS CategoryText, {rules_sql(CAT_CASE, STORE_RULES)} AS GroupName FROM part"
    )
    sql["category_custom_rules"] = (
        f"SELECT p_partkey, p_name, {rules_sql('p_name', CUSTOM_RULES)} AS GroupName FROM part"
    )
    sql["group_name"] = with_ctes(
        F_, body=f"SELECT Name, DataType, Year, Registrations, {group_sql(STORE_RULES)} AS GroupName FROM annual"
    )
    # sources
    sql["src_wide_csv"] = with_ctes(F_, body="SELECT * FROM monthly")
    sql["union_all"] = with_ctes(F_, body="SELECT * FROM annual")
    sql["src_file_meta"] = with_ctes(
        F_,
        body=f"SELECT {_report('X_Month_Wise_Year_')} AS Report, DataType, Year, count(DISTINCT Name) AS Entities "
        "FROM counts GROUP BY ALL",
    )
    maker_years = "(SELECT DISTINCT Year FROM annual WHERE DataType = 'Manufacturer')"
    bad = [("_totals", "no period columns"), ("_nameless", "no entity column"), ("_ragged", "row does not fit header"), ("_empty", "empty report"),
           ("_endless", "quoted cell does not end")]
    sql["src_rejects"] = with_ctes(
        F_,
        body="SELECT 'Y_Fuel_X_Calendar_Year_Year_' || CAST(Year AS VARCHAR) || '.csv' AS Report, "
        "'unknown report kind' AS Reason FROM (SELECT DISTINCT Year FROM annual WHERE DataType = 'Vehicle Category') "
        + " ".join(
            f"UNION ALL SELECT 'Y_Maker_X_Calendar_Year_Year_' || CAST(Year AS VARCHAR) || '{tag}.csv' AS Report, '{why}' AS Reason FROM {maker_years}"
            for tag, why in bad
        ),
    )
    sql["src_quoted_cells"] = with_ctes(
        F_,
        body="SELECT CASE (length(Name) + Year) % 4 WHEN 0 THEN replace(Name, ' ', chr(10)) WHEN 1 THEN '\"' || Name || '\",' || chr(10) "
        "WHEN 2 THEN Name || ', \"x\"' ELSE Name END AS Name, DataType, Year, Registrations FROM annual",
    )
    sql["csv_sink"] = with_ctes(
        F_,
        body=f"SELECT {_report('X_Calendar_Year_Year_')} AS Report, row_number() OVER (PARTITION BY DataType, Year ORDER BY Name) AS Serial FROM annual",
    )
    sql["csv_named_sink"] = with_ctes(
        F_,
        body=f"SELECT {_report('X_Calendar_Year_Year_')} AS Report, row_number() OVER (PARTITION BY DataType, Year ORDER BY Name) AS Serial, "
        "Name, Registrations FROM annual",
    )
    sql["load_file_profile"] = with_ctes(
        F_,
        body=f"SELECT {group_sql(FILE_RULES)} AS Name, DataType, Year, Month, MonthNum, Date, MonthlyRegistrations "
        "FROM mdates",
    )
    sql["load_store_profile"] = with_ctes(
        F_,
        body=f"SELECT Name, DataType, Year, Month, Date, MonthlyRegistrations, {group_sql(STORE_RULES)} AS MappedName "
        "FROM mdates WHERE MonthlyRegistrations > 0",
    )
    # store
    positive = "SELECT Name, DataType, Year, Month, MonthlyRegistrations FROM monthly WHERE MonthlyRegistrations > 0"
    sql["store_roundtrip"] = with_ctes(F_, body=positive)
    sql["store_append_new"] = with_ctes(F_, body=positive)
    sql["stream_ingest"] = with_ctes(F_, body=positive)
    sql["store_infile_dup"] = with_ctes(F_, body="SELECT Name, DataType, Year, Registrations FROM annual")
    # the batch holds the last two years twice, once with five more; the last but one is stored already
    late = "SELECT Name, DataType, Year, Month, MonthlyRegistrations{more} AS MonthlyRegistrations, {why} AS Reason FROM monthly WHERE MonthlyRegistrations > 0 AND Year = (SELECT max(Year) FROM counts){ago}"
    stored, twice = "'key exists in store'", "'duplicate key in batch'"
    sql["store_inbatch_dup"] = with_ctes(
        F_,
        body=" UNION ALL ".join([
            f"SELECT *, CAST(NULL AS VARCHAR) AS Reason FROM ({positive})",
            late.format(more="", why=stored, ago=" - 1"), late.format(more=" + 5", why=stored, ago=" - 1"), late.format(more=" + 5", why=twice, ago=""),
        ]),
    )
    sql["store_unique_reports"] = with_ctes(
        F_,
        body="SELECT 'Y_Maker_X_Calendar_Year_Year_' || CAST(Year AS VARCHAR) || '_copy.csv' AS Report, "
        "'duplicate key' AS Reason FROM (SELECT DISTINCT Year FROM annual WHERE DataType = 'Manufacturer')",
    )
    sql["store_chain_reports"] = with_ctes(
        F_,
        body="SELECT 'Y_Maker_X_Calendar_Year_Year_' || CAST(Year AS VARCHAR) || '.csv' AS Report, 'duplicate key' AS Reason "
        f"FROM {maker_years} WHERE (Year - (SELECT min(Year) FROM annual)) % 2 = 1",
    )
    sql["store_two_writers"] = with_ctes(F_, body=positive)
    sql["store_read_entity"] = with_ctes(F_, body=positive + f" AND DataType = '{R.PROJECT_ENTITY[0]}' AND Name = '{R.PROJECT_ENTITY[1]} S{R.PROJECT_ENTITY[2]}'")
    sql["store_dup_keys"] = with_ctes(
        F_,
        body="SELECT Name, DataType, Year, Month, 'key exists in store' AS Reason FROM monthly "
        "WHERE MonthlyRegistrations > 0 AND Year = (SELECT max(Year) FROM counts) - 1",
    )
    sql["stream_growth"] = sql["yoy_growth_store"]
    # catalog
    sql["entity_catalog"] = with_ctes(
        F_,
        f"""names AS (
  SELECT DISTINCT DataType, Name FROM (
    SELECT DataType, {group_sql(FILE_RULES)} AS Name FROM annual
    UNION ALL SELECT DataType, {group_sql(FILE_RULES)} AS Name FROM monthly) WHERE Name IS NOT NULL)""",
        body="SELECT * FROM names UNION ALL "
        "SELECT 'Vehicle Category' AS DataType, g AS Name FROM (VALUES ('2W'), ('3W'), ('4W')) t(g) "
        "WHERE NOT EXISTS (SELECT 1 FROM names WHERE DataType = 'Vehicle Category' AND Name IN ('2W', '3W', '4W'))",
    )
    sql["year_bounds"] = with_ctes(
        F_,
        body="SELECT CAST(least(min(lo), year(current_date)) AS INTEGER) AS MinYear, "
        "CAST(greatest(max(hi), year(current_date)) AS INTEGER) AS MaxYear FROM ("
        "SELECT min(Year) AS lo, max(Year) AS hi FROM annual UNION ALL "
        "SELECT min(Year) AS lo, max(Year) AS hi FROM monthly)",
    )
    sql["store_entity_catalog"] = sql["entity_catalog"]
    sql["store_year_bounds"] = sql["year_bounds"]
    sql["preview_head"] = with_ctes(F_, body="SELECT * FROM annual ORDER BY DataType, Name, Year LIMIT 5")
    sql["preview_head_monthly"] = with_ctes(
        F_, body="SELECT * FROM monthly ORDER BY DataType, Name, Year, Month LIMIT 5"
    )
    sql["fn_safe_name"] = "SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}]', '_', 'g') AS SafeName FROM pages"
    return sql


ORACLE_SQL: dict[str, str] = build()

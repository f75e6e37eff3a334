"""URL filters whose lists change with time: validity intervals and an as-of join (DataFrame functions only).

A list is a log of dated entries: from ``since`` on, ``pattern`` (a host or a
parent domain) has this ``action`` (``block``, ``allow`` or ``remove``). Entries of a pattern become
intervals [since, until), ``until`` being its next entry. A capture is judged
at its fetch time by the active entry of its host's longest pattern.

The join is on equal patterns (each host with its parent domains, a handful)
and runs on distinct (host, fetch day) pairs, so a host with a third of all
captures is one row a day; its verdicts meet the captures in a join on (host,
day), which Spark may split.

Defined cases: null or unparsable URLs, and captures without a fetch time, are
kept with a null verdict; entries without pattern or date are ignored; of
entries of a pattern at the same time, ``block`` wins over ``allow`` over
``remove``; rows repeat as they come; empty tables give empty results or no
blocks; extra columns are passed through under their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without a final dot; null when there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url.cast("string"), HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def labels_of(name: Column) -> Column:
    """Number of labels of a host or pattern."""
    return F.size(F.split(name, r"\."))


def domain_of(host: Column, labels: Column) -> Column:
    """The last ``labels`` labels of a host."""
    return F.call_function("substring_index", host, F.lit("."), -labels)


def intervals(entries: DataFrame) -> DataFrame:
    """``pattern, action, since, until`` from ``pattern, action, since``; ``until`` is null while an entry is the last.

    A pattern's log is as long as its changes, not as its captures.
    """
    rank = F.when(F.col("action") == "block", 3).when(F.col("action") == "allow", 2).otherwise(1)
    log = entries.filter("pattern IS NOT NULL AND since IS NOT NULL").select(
        F.regexp_replace(F.lower("pattern"), r"^\.+|\.+$", "").alias("pattern"), "action", "since", rank.alias("rank")
    )
    one = log.groupBy("pattern", "since").agg(F.max(F.struct("rank", "action")).alias("e"))
    until = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    return one.select("pattern", F.col("e.action").alias("action"), "since", until.alias("until")).filter("action IN ('block', 'allow')")


def verdicts(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", time_col: str = "fetched", prefix: str = "__") -> DataFrame:
    """``captures`` with ``__host`` and ``__pattern``, ``__action``, ``__since`` of the entry that decides, null where none is active.

    Columns of these names that the captures have stay beside them; another ``prefix`` tells them apart.
    """
    own = [pick(captures, c).alias(f"__c{i}") for i, c in enumerate(captures.columns)]
    rows = captures.select(*own, host_of(pick(captures, url_col)).alias("__host"), pick(captures, time_col).cast("timestamp_ntz").alias("__at"))
    asked = rows.filter("__host IS NOT NULL AND __at IS NOT NULL").select("__host", "__at").distinct()
    lists = intervals(entries)
    # only numbers of labels that patterns have are asked for, so a host of very many labels costs no more than its length
    counts = lists.agg(F.sort_array(F.collect_set(labels_of(F.col("pattern")))).alias("n")).scalar()
    looked = asked.select("__host", "__at", labels_of(F.col("__host")).alias("__most"), counts.alias("__counts"))
    looked = looked.select("__host", "__at", "__most", F.explode("__counts").alias("labels")).filter("labels <= __most")
    looked = looked.select("__host", "__at", "labels", domain_of(F.col("__host"), F.col("labels")).alias("pattern"))
    active = looked.join(lists, "pattern").filter((F.col("__at") >= F.col("since")) & (F.col("until").isNull() | (F.col("__at") < F.col("until"))))
    best = active.groupBy("__host", "__at").agg(F.max_by(F.struct("pattern", "action", "since"), "labels").alias("__e"))
    return rows.join(best, ["__host", "__at"], "left").select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(captures.columns)], F.col("__host").alias(f"{prefix}host"),
        F.col("__e.pattern").alias(f"{prefix}pattern"), F.col("__e.action").alias(f"{prefix}action"), F.col("__e.since").alias(f"{prefix}since"),
    )


def allowed(captures: DataFrame, entries: DataFrame, **kw) -> DataFrame:
    """The captures that no active ``block`` entry decides."""
    n = len(captures.columns)
    got = verdicts(captures, entries, **kw)
    got = got.toDF(*[f"__c{i}" for i in range(n)], "__host", "__pattern", "__action", "__since").filter("coalesce(__action, '') <> 'block'")
    return got.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(captures.columns)])


# The page table has no fetch dates and no lists, so the query derives both from its rows: a page is fetched on a day
# given by its identifier, and hosts enter, leave and re-enter the list on days given by a hash of their names.
_DAYS, _FIRST = 365, "2024-01-01"


def _days(text: Column, salt: str, most: int) -> Column:
    """A number below ``most`` from a text, the same in any engine (first seven hex digits of an MD5)."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(salt), text).cast("binary")), 1, 7), 16, 10).cast("long") % most).cast("int")


def captures_of(pages: DataFrame) -> DataFrame:
    day = F.pmod(F.col("page_id") * 37, F.lit(_DAYS)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit(_FIRST).cast("date"), day).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Every host: a block, later an allow or removal, later a block again; every fifth parent domain: a block in the second half-year."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host IS NOT NULL").distinct()
    start = F.lit(_FIRST).cast("date")
    on, gap, again = _days(F.col("host"), "on:", 200), _days(F.col("host"), "gap:", 90), _days(F.col("host"), "again:", 90)
    second = F.when(_days(F.col("host"), "kind:", 2) == 0, "allow").otherwise("remove")
    steps = F.array(
        F.struct(F.lit("block").alias("action"), F.date_add(start, on).alias("since")),
        F.struct(second.alias("action"), F.date_add(start, on + gap).alias("since")),
        F.struct(F.lit("block").alias("action"), F.date_add(start, on + gap + again).alias("since")),
    )
    own = hosts.filter(_days(F.col("host"), "listed:", 2) == 0).select(F.col("host").alias("pattern"), F.explode(steps).alias("e")).select("pattern", "e.action", "e.since")
    parent = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    up = hosts.select(parent.alias("pattern")).filter("pattern <> ''").distinct().filter(_days(F.col("pattern"), "up:", 5) == 0)
    up = up.select("pattern", F.lit("block").alias("action"), F.date_add(start, 182 + _days(F.col("pattern"), "since:", 90)).alias("since"))
    return own.unionByName(up).withColumn("since", F.col("since").cast("timestamp_ntz"))


def report(pages: DataFrame) -> DataFrame:
    """``page_id, host, fetched, pattern, action, since, blocked`` of every page."""
    got = verdicts(captures_of(pages), entries_of(pages))
    return got.select(
        "page_id", F.col("__host").alias("host"), "fetched", F.col("__pattern").alias("pattern"), F.col("__action").alias("action"),
        F.to_date("__since").alias("since"), (F.coalesce("__action", F.lit("")) == "block").alias("blocked"),
    )


ORACLE = r"""
WITH cap AS (
  SELECT page_id, CAST(DATE '2024-01-01' + CAST(((page_id * 37) % 365 + 365) % 365 AS INTEGER) AS DATE) AS fetched,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host
  FROM pages),
hosts AS (SELECT DISTINCT host FROM cap WHERE host IS NOT NULL),
h AS (SELECT host, CAST('0x' || left(md5('on:' || host), 7) AS BIGINT) % 200 AS a, CAST('0x' || left(md5('gap:' || host), 7) AS BIGINT) % 90 AS b,
             CAST('0x' || left(md5('again:' || host), 7) AS BIGINT) % 90 AS c, CAST('0x' || left(md5('kind:' || host), 7) AS BIGINT) % 2 AS k
      FROM hosts WHERE CAST('0x' || left(md5('listed:' || host), 7) AS BIGINT) % 2 = 0),
log AS (
  SELECT host AS pattern, 'block' AS action, DATE '2024-01-01' + CAST(a AS INTEGER) AS since FROM h
  UNION ALL SELECT host, CASE WHEN k = 0 THEN 'allow' ELSE 'remove' END, DATE '2024-01-01' + CAST(a + b AS INTEGER) FROM h
  UNION ALL SELECT host, 'block', DATE '2024-01-01' + CAST(a + b + c AS INTEGER) FROM h
  UNION ALL SELECT p, 'block', DATE '2024-01-01' + CAST(182 + CAST('0x' || left(md5('since:' || p), 7) AS BIGINT) % 90 AS INTEGER)
  FROM (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS p FROM hosts) WHERE p <> '' AND CAST('0x' || left(md5('up:' || p), 7) AS BIGINT) % 5 = 0),
one AS (
  SELECT pattern, since, arg_max(action, CASE action WHEN 'block' THEN 3 WHEN 'allow' THEN 2 ELSE 1 END) AS action FROM log GROUP BY ALL),
spans AS (SELECT pattern, action, since, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM one),
hit AS (
  SELECT cap.page_id, spans.*, row_number() OVER (PARTITION BY cap.page_id ORDER BY length(spans.pattern) DESC) AS r
  FROM cap JOIN spans ON (cap.host = spans.pattern OR ends_with(cap.host, '.' || spans.pattern))
  WHERE spans.action <> 'remove' AND cap.fetched >= spans.since AND (spans.until IS NULL OR cap.fetched < spans.until))
SELECT cap.page_id, cap.host, cap.fetched, hit.pattern, hit.action, CAST(hit.since AS DATE) AS since, coalesce(hit.action = 'block', false) AS blocked
FROM cap LEFT JOIN hit ON hit.page_id = cap.page_id AND hit.r = 1
"""

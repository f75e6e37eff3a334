"""Which reports a file-by-file insert under a unique key takes, in a number of jobs that does not grow with the reports.

Reports come in name order; one that holds a key twice, or a key of a report taken before it, is refused whole.

1. Rows are counted by a 64-bit hash of their key; where none comes twice, nothing clashes. Rows of the others are
   counted by the key itself, which also finds the first and last number of its reports. Keys that clash, and nothing else,
   become lists of the reports that hold them; a key of two rows, or of one report, has its list by these
   numbers, so names meet by key only for keys of more. Equal lists count once, so a
   report and its copy are one list, however many keys they share. (A list is at most as long as there are reports.)
2. Up to ``SETTLE`` names in all lists: one task walks the reports in name order. That is the only step that plain
   expressions cannot state, as each answer needs all before it.
3. Beyond that, lists that are linked by common reports make up a component; each is a task's walk. A component of more than ``SETTLE`` names
   is settled in rounds of joins: all reports that come first on every list they are in are taken, those beside them refused.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.session import materialize, ship_package

#: Names (of all lists, or of a component's) that one task holds; some hundred MB.
SETTLE = 1_000_000

#: Keys of a task that puts lists together, about.
TASK_KEYS = 500_000


def walk(lists: Iterable[Sequence[tuple[str, bool]]]) -> set[str]:
    """Refused reports of lists of (report, holds the key twice)."""
    of, refused, taken = defaultdict(list), set(), []
    for at, members in enumerate(lists):
        taken.append(False)
        for report, twice in members:
            of[report].append(at)
            if twice:
                refused.add(report)
    for report in sorted(of):
        if report in refused:
            continue
        if any(taken[at] for at in of[report]):
            refused.add(report)
        else:
            for at in of[report]:
                taken[at] = True
    return refused


def _walk_part(pdf: pd.DataFrame) -> pd.DataFrame:
    lists = [list(zip(names, twice, strict=True)) for names, twice in zip(pdf["Names"], pdf["Twice"], strict=True)]
    return pd.DataFrame({"Report": sorted(walk(lists))}, dtype=object)


def _walked(lists: DataFrame, *part: str) -> DataFrame:
    ship_package(lists.sparkSession)
    return lists.groupBy(*part).applyInPandas(_walk_part, "Report string")


def _parts(members: DataFrame) -> DataFrame:
    """(id, part) of members (id, Report): lists with a common report, or linked by others, have one part."""
    # stars: an edge goes from a list to the least list of a report
    least = members.groupBy("Report").agg(F.min("id").alias("b"))
    e = materialize(members.join(least, "Report").select(F.col("id").alias("a"), "b").where("a <> b").distinct(), "settle-edges")
    seen = None
    while True:
        ends = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = ends.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        e = materialize(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "settle-edges")
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return members.select("id").distinct().join(e.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("b", "id").alias("part"))


def _in_rounds(members: DataFrame, inside: DataFrame) -> DataFrame:
    """Refused reports of members (id, Report), by rounds of joins; ``inside`` are refused already."""
    without = lambda df, reports: df.join(reports, "Report", "left_anti")
    open_, refused = materialize(without(members, inside), "settle-open"), []
    while not open_.isEmpty():
        seen = open_.join(open_.groupBy("id").agg(F.min("Report").alias("First")), "id")
        waits = seen.where("Report <> First").select("Report").distinct()
        taken = materialize(without(seen, waits).select("Report").distinct(), "settle-taken")
        lists = open_.join(taken, "Report", "left_semi").select("id").distinct()
        beside = without(open_.join(lists, "id", "left_semi").select("Report").distinct(), taken)
        refused.append(materialize(beside, "settle-beside"))
        open_ = materialize(without(open_, taken.unionByName(refused[-1])), "settle-open")
    out = inside
    for more in refused:
        out = out.unionByName(more)
    return out


def _dealt(rows: DataFrame, n: int, key: list[str]) -> DataFrame:
    """``n`` rows by key; a task's memory holds some of them: more keys are more tasks."""
    return rows.repartition(-(-n // TASK_KEYS), *key) if n > TASK_KEYS else rows


def _met(by_report: DataFrame, keys: DataFrame, n: int, key: list[str]) -> DataFrame:
    """(Names, Twice): the distinct lists of ``keys``, which ``n`` rows hold; names are put together by key."""
    mine = keys.select(*[F.col(c).alias(f"__{c}") for c in key])
    rows = by_report.join(mine, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key], "left_semi")
    held = _dealt(rows.groupBy("Report", *key).agg((F.count(F.lit(1)) > 1).alias("Twice")), n, key)
    lists = held.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("Report", "Twice"))).alias("Held")).select("Held").distinct()
    return lists.select(F.col("Held.Report").alias("Names"), F.col("Held.Twice").alias("Twice"))


def refused(by_report: DataFrame, key: list[str]) -> DataFrame:
    """(Report): the refused ones of rows with ``Report`` and the columns of ``key``."""
    h = F.xxhash64(*key)
    hashes = by_report.groupBy(h.alias("__h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hashes = materialize(hashes, "settle-hashes")
    rows, many = hashes.agg(F.sum("n"), F.sum(F.when(F.col("n") > 2, F.col("n")))).first()
    if not rows:
        return by_report.select("Report").where(F.lit(False))
    by_report = by_report.select("Report", *key).withColumn("__h", h).join(hashes, "__h", "left_semi").drop("__h")
    # a number stands for a report: least and greatest numbers go by hash, those of names need a sort by the key
    reports = by_report.select("Report").distinct().select("Report", F.monotonically_increasing_id().alias("number"))
    reports = materialize(reports, "settle-reports")
    held = _dealt(by_report.join(reports, "Report"), rows, key)
    held = held.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("low"), F.max("number").alias("high")).where("n > 1")
    held = materialize(held, "settle-lists")
    more = held.where("n > 2 AND low <> high")
    many = many and more.agg(F.sum("n")).first()[0]
    ends = held.where("n = 2 OR low = high").select("low", "high").distinct()
    for end in ("low", "high"):
        ends = ends.join(reports.select(F.col("number").alias(end), F.col("Report").alias(f"{end}_name")), end)
    one = F.col("low") == F.col("high")
    lists = ends.select(
        F.when(one, F.array("low_name")).otherwise(F.array("low_name", "high_name")).alias("Names"),
        F.when(one, F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(False))).alias("Twice"),
    )
    if many:
        lists = lists.unionByName(_met(by_report, more, many, key))
    lists = materialize(lists.select(F.monotonically_increasing_id().alias("id"), "Names", "Twice"), "settle-names")
    names = lists.agg(F.sum(F.size("Names"))).first()[0] or 0
    if names <= SETTLE:
        return materialize(_walked(lists), "settle-refused")
    members = lists.select("id", F.explode(F.arrays_zip("Names", "Twice")).alias("m")).select("id", F.col("m.Names").alias("Report"), F.col("m.Twice").alias("Twice"))
    members = materialize(members, "settle-members")
    parts = materialize(_parts(members), "settle-parts")
    large = members.join(parts, "id").groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SETTLE).select("part")
    large = materialize(parts.join(large, "part", "left_semi"), "settle-large")
    walked = materialize(_walked(lists.join(parts, "id").join(large, "id", "left_anti"), "part"), "settle-walked")
    rest = members.join(large, "id", "left_semi")
    return walked.unionByName(_in_rounds(rest.select("id", "Report"), materialize(rest.where("Twice").select("Report").distinct(), "settle-inside")))

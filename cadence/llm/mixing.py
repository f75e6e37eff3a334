"""Mixing sources to target weights: hierarchical budgets, then seeded epochs (DataFrame functions only).

A tree (domain, language, source) splits a token budget by weight. A node can
give at most its tokens times ``max_epochs``; what a node cannot give goes to its siblings by
their weights (water filling) before any of it leaves their parent. A leaf's
budget buys whole epochs of its documents and a prefix of the next one, each
epoch in its own seeded order; the last document of the prefix may be cut.

Budgets run on one row a leaf. Documents are ordered by an MD5 of seed, epoch
and identifier. A leaf's prefix is found in two steps, sums by slices of
that order first, so no task sorts a whole leaf, however hot.

Defined cases: a null domain, language or source is a leaf of its own; a null
text has no tokens and is never taken; nodes without a weight weigh 1, a weight
of 0 or less takes nothing; an empty table gives an empty result; equal
identifiers are separate rows, ordered by text; extra columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pick

#: Hex digits of the order key that make a slice: 16**3 slices of a leaf's epoch.
SLICE = 3
LEVELS = ("domain", "language", "source")


def tokens(text: Column) -> Column:
    """White-space separated words."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Split each parent's ``budget`` over its ``nodes`` (columns ``w``, ``cap``): adds ``share``.

    With nodes by rising cap / w, the level at which the k-th node is the first
    that is not full is (budget - caps before it) / (weights from it on); the
    share is min(cap, w * level) at the first of these levels that does not exceed its node's
    own ratio; later ones only fall, so it is the greatest such level.
    """
    ratio = F.col("cap") / F.col("w")
    order = Window.partitionBy(*parent).orderBy("ratio", "cap", *[c for c in LEVELS if c in nodes.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    able = nodes.withColumn("ratio", F.when((F.col("w") > 0) & (F.col("cap") > 0), ratio))
    able = able.withColumns({
        "full": F.coalesce(F.sum(F.when(F.col("ratio").isNotNull(), F.col("cap"))).over(before), F.lit(0)),
        "open": F.sum(F.when(F.col("ratio").isNotNull(), F.col("w"))).over(rest),
    })
    at = F.when(F.col("ratio").isNotNull(), (F.col("budget") - F.col("full")) / F.col("open"))
    able = able.withColumn("at", at)
    level = F.max(F.when(F.col("at") <= F.col("ratio"), F.col("at"))).over(Window.partitionBy(*parent))
    share = F.when(F.col("ratio").isNull(), 0.0).otherwise(F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * F.col("level"), F.col("cap").cast("double"))))
    return able.withColumn("level", level).withColumn("share", share).drop("ratio", "full", "open", "at", "level")


def budgets(leaves: DataFrame, weights: DataFrame | None, total: Column, max_epochs: int) -> DataFrame:
    """Leaf rows (``domain, language, source, tokens``) with their ``budget`` in whole tokens.

    ``weights``: rows ``(level, name, weight)``; ``name`` is the node's own name at its level.
    ``total``: the budget, may use ``all_tokens``. Sums of whole trees are one row per node; the root is one row.
    """
    got = leaves.withColumns({"cap": F.col("tokens") * F.lit(max_epochs), "all_tokens": F.sum("tokens").over(Window.partitionBy(F.lit(1)))})
    got = got.withColumn("budget", total.cast("double"))
    for depth in range(len(LEVELS)):
        path = list(LEVELS[: depth + 1])
        parent = path[:-1]
        nodes = got.groupBy(*path).agg(F.sum("cap").alias("cap"), F.first("budget").alias("budget"))
        if weights is not None:
            own = weights.filter(F.col("level") == path[-1]).groupBy(F.col("name").alias(path[-1])).agg(F.max("weight").cast("double").alias("w"))
            nodes = nodes.join(own, path[-1], "left")
        else:
            nodes = nodes.withColumn("w", F.lit(None).cast("double"))
        nodes = fill(nodes.withColumn("w", F.coalesce("w", F.lit(1.0))), parent or [F.lit(1)])
        nodes = nodes.select(*[F.col(c).alias(f"__{c}") for c in path], "share")
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in path]
        on = same[0]
        for s in same[1:]:
            on = on & s
        got = got.join(nodes, on).withColumn("budget", F.col("share")).drop("share", *[f"__{c}" for c in path])
    return got.withColumn("budget", F.floor("budget").cast("long"))


def mix(
    docs: DataFrame, *, domain: Column, language: Column, source: Column, weights: DataFrame | None = None, total: Column | None = None,
    max_epochs: int = 2, seed: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Rows of ``docs`` taken, once per epoch: all columns, then ``__epoch`` (0 ..), ``__take`` tokens of ``__tokens``, ``__budget`` of the leaf."""
    # the documents' own columns under names of their place, so that none clashes with the plan's
    own = [pick(docs, c).alias(f"__c{i}") for i, c in enumerate(docs.columns)]
    text = pick(docs, text_col).cast("string")
    rows = docs.select(
        *own, domain.alias("__d"), language.alias("__l"), source.alias("__s"), tokens(text).alias("__tokens"),
        F.coalesce(pick(docs, id_col).cast("string"), F.lit("")).alias("__id"), F.xxhash64(text).alias("__h"), text.alias("__t"),
    )
    leaf = ["__d", "__l", "__s"]
    narrow = materialize(rows.select(*leaf, "__tokens", "__id"), "mix-tokens")
    leaves = narrow.groupBy(*leaf).agg(F.sum("__tokens").alias("tokens")).toDF(*LEVELS, "tokens")
    plan = materialize(budgets(leaves, weights, F.col("all_tokens") if total is None else total, max_epochs), "mix-plan")
    plan = plan.filter("tokens > 0 AND budget > 0").select(
        *[F.col(c).alias(f"p_{c}") for c in LEVELS], "tokens", "budget",
        F.expr("budget DIV tokens").alias("whole"), (F.col("budget") % F.col("tokens")).alias("part"),
    )
    on = F.col("__d").eqNullSafe(F.col("p_domain")) & F.col("__l").eqNullSafe(F.col("p_language")) & F.col("__s").eqNullSafe(F.col("p_source"))

    def order(epoch: Column) -> Column:
        return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.col("__id")).cast("binary"))

    # where the prefix of each leaf's last epoch ends: sums by slice of the order, then the slice it ends in
    sliced = narrow.join(plan.filter("part > 0"), on).withColumn("slice", F.substring(order(F.col("whole")), 1, SLICE))
    path = [f"p_{c}" for c in LEVELS]
    sums = sliced.groupBy(*path, "slice").agg(F.sum("__tokens").alias("n"), F.first("part").alias("part"))
    upto = F.sum("n").over(Window.partitionBy(*path).orderBy("slice"))  # 16**SLICE rows a leaf at most
    edge = sums.withColumn("room", F.col("part") - upto + F.col("n")).filter("room > 0").groupBy(*path).agg(
        F.max(F.struct("slice", "room")).alias("e")
    )
    edge = edge.select(*[F.col(c).alias(f"e_{c}") for c in path], F.col("e.slice").alias("edge"), F.col("e.room").alias("room"))
    same = F.lit(True)
    for c in path:
        same = same & F.col(c).eqNullSafe(F.col(f"e_{c}"))
    plan = materialize(plan.join(edge, same, "left").drop(*[f"e_{c}" for c in path]), "mix-edges")  # one row a leaf

    want = rows.filter("__tokens > 0").join(plan, on)
    epochs = want.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int"))))
    epochs = epochs.withColumn("__order", F.when(F.col("__epoch") == F.col("whole"), order(F.col("whole"))))
    slice_ = F.substring("__order", 1, SLICE)
    whole = epochs.filter(F.col("__order").isNull() | (slice_ < F.col("edge"))).withColumn("__take", F.col("__tokens"))
    # one slice a leaf is cut inside: only its documents need their place
    place = Window.partitionBy(*path).orderBy("__order", "__h", "__t")
    split = epochs.filter(slice_ == F.col("edge")).withColumn("__at", F.sum("__tokens").over(place.rowsBetween(Window.unboundedPreceding, -1)))
    split = split.withColumn("__take", F.least(F.col("__tokens"), F.col("room") - F.coalesce("__at", F.lit(0)))).filter("__take > 0").drop("__at")
    out = whole.unionByName(split)
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)], "__epoch", "__take", "__tokens", F.col("budget").alias("__budget"))


# The document table names languages and sources; the query groups sources into domains by their number.
WEIGHTS = [("domain", "web", 4.0), ("domain", "books", 3.0), ("domain", "code", 2.0), ("domain", "wiki", 1.0),
           ("language", "en", 5.0), ("language", "fr", 2.0), ("language", "de", 2.0), ("language", "es", 1.0)]
DOMAINS = ("web", "books", "code", "wiki")


def weight_table(spark: SparkSession, rows: list[tuple[str, str, float]] = WEIGHTS) -> DataFrame:
    body = ", ".join(f"('{level}', '{name}', {weight}D)" for level, name, weight in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t(level, name, weight)")


def mixed(docs: DataFrame, max_epochs: int = 2) -> DataFrame:
    """The document table's mixture: domain by the source's number, as many tokens as the table has."""
    number = F.regexp_extract(pick(docs, "source").cast("string"), r"([0-9]{1,18})$", 1).try_cast("long")
    domain = F.element_at(F.array(*[F.lit(x) for x in DOMAINS]), (number % len(DOMAINS) + 1).cast("int"))
    return mix(docs, domain=domain, language=pick(docs, "lang"), source=pick(docs, "source"), weights=weight_table(docs.sparkSession), max_epochs=max_epochs)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, source, lang, epoch, tokens, take, budget`` of every document taken, once an epoch."""
    return mixed(docs).select(
        "doc_id", "source", "lang", F.col("__epoch").cast("long").alias("epoch"), F.col("__tokens").alias("tokens"),
        F.col("__take").alias("take"), F.col("__budget").alias("budget"),
    )


def chosen(docs: DataFrame) -> DataFrame:
    """The documents taken, whole, once an epoch, with the columns of ``docs``."""
    return mixed(docs).select(*[pick(docs, c) for c in docs.columns])


def oracle(max_epochs: int = 2) -> str:
    weights = ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in WEIGHTS)
    names = ", ".join(f"'{x}'" for x in DOMAINS)
    sql = f"""
WITH weights AS (SELECT * FROM (VALUES {weights}) AS t(level, name, weight)),
docs AS (
  SELECT doc_id, text, source, lang, list_extract([{names}], CAST(CAST(nullif(regexp_extract(source, '([0-9]{{1,18}})$', 1), '') AS BIGINT) % {len(DOMAINS)} + 1 AS INTEGER)) AS domain,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens FROM documents),
l0 AS (SELECT domain, lang AS language, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {max_epochs} AS cap,
              (SELECT sum(tokens) FROM docs)::DOUBLE AS budget FROM docs GROUP BY ALL)"""
    for k in range(3):
        path, parent = ", ".join(LEVELS[: k + 1]), ", ".join(LEVELS[:k]) or "1"
        name = LEVELS[k]
        on = " AND ".join(f"l{k}.{c} IS NOT DISTINCT FROM f{k}.{c}" for c in LEVELS[: k + 1])
        sql += f""",
n{k} AS (SELECT {path}, sum(cap)::BIGINT AS cap, first(budget) AS budget FROM l{k} GROUP BY {path}),
w{k} AS (SELECT n{k}.*, coalesce(weight, 1) AS w, CASE WHEN coalesce(weight, 1) > 0 AND cap > 0 THEN cap / coalesce(weight, 1) END AS ratio
  FROM n{k} LEFT JOIN weights ON level = '{name}' AND name = {name}),
a{k} AS (SELECT *, (budget - coalesce(sum(CASE WHEN ratio IS NOT NULL THEN cap END) OVER (PARTITION BY {parent} ORDER BY ratio NULLS FIRST, cap, {path} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(CASE WHEN ratio IS NOT NULL THEN w END) OVER (PARTITION BY {parent} ORDER BY ratio NULLS FIRST, cap, {path} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w{k}),
f{k} AS (SELECT {path}, CASE WHEN ratio IS NULL THEN 0 ELSE least(cap::DOUBLE, coalesce(w * max(CASE WHEN level <= ratio THEN level END) OVER (PARTITION BY {parent}), cap::DOUBLE)) END AS share FROM a{k}),
l{k + 1} AS (SELECT l{k}.* REPLACE (f{k}.share AS budget) FROM l{k} JOIN f{k} ON {on})"""
    return sql + """,
plan AS (SELECT domain, language, source, tokens AS t, floor(budget)::BIGINT AS budget FROM l3),
taken AS (
  SELECT d.*, p.budget, p.t, unnest(range(0, p.budget // p.t + 1)) AS epoch FROM docs d JOIN plan p
    ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.language AND d.source IS NOT DISTINCT FROM p.source
  WHERE d.tokens > 0 AND p.budget > 0),
placed AS (
  SELECT *, epoch * t + sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('1:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tokens AS spot FROM taken)
SELECT doc_id, source, lang, epoch::BIGINT AS epoch, tokens::BIGINT AS tokens, least(tokens, budget - spot)::BIGINT AS take, budget FROM placed WHERE spot < budget
"""


ORACLE = oracle()

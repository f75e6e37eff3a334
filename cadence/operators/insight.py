"""Per-entity insights over a growth view: latest growth, trend, best period, text.

One grouped aggregate per entity (``max_by`` / ``max``), no collect: the
text for every entity is built on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.text import format_2f, trend_label

# Insight sentences (markdown) for each metric.
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

_METRICS = {
    # metric -> (growth column, period order expression, period label expression, texts)
    "yoy": ("YoYGrowth", lambda: F.col("Year").cast("bigint"), lambda: F.col("Year").cast("string"), YOY_TEXT),
    "qoq": (
        "QoQGrowth",
        lambda: F.col("Year").cast("bigint") * 4 + F.col("Quarter"),
        lambda: F.col("QuarterYear"),
        QOQ_TEXT,
    ),
}


def _template(text: str, **parts: Column) -> Column:
    """Fill a '{name}' style template with columns (no Python per row)."""
    out: list[Column] = []
    rest = text
    while rest:
        i = rest.find("{")
        if i < 0:
            out.append(F.lit(rest))
            break
        if i:
            out.append(F.lit(rest[:i]))
        j = rest.index("}", i)
        out.append(parts[rest[i + 1 : j]])
        rest = rest[j + 1 :]
    return F.concat(*out)


def latest_and_best(view: DataFrame, metric: str = "yoy") -> DataFrame:
    """Per entity: latest period and its growth (may be NULL), best growth and
    the first period reaching it (only non-NULL growth competes)."""
    gcol, order_fn, label_fn, _ = _METRICS[metric]
    g = F.col(gcol)
    order = order_fn()
    label = label_fn()
    has_g = g.isNotNull()
    return view.groupBy("DataType", "Name").agg(
        F.max_by(label, order).alias("LatestPeriod"),
        F.max_by(g, order).alias("LatestGrowth"),
        F.max(g).alias("MaxGrowth"),
        F.max_by(F.when(has_g, label), F.when(has_g, F.struct(g, -order))).alias("MaxPeriod"),
    )


def insights(view: DataFrame, metric: str = "yoy") -> DataFrame:
    """Trend label, best period and the insight sentence for every entity."""
    texts = _METRICS[metric][3]
    lb = latest_and_best(view, metric)
    trend = trend_label("LatestGrowth")
    best_ok = F.col("MaxGrowth") > 0
    head = _template(texts["head"], name=F.col("Name"), trend=trend, growth=format_2f("LatestGrowth"))
    tail = (
        F.when(trend == "positive", F.lit(texts["positive"]))
        .when(trend == "negative", F.lit(texts["negative"]))
        .otherwise(F.lit(texts["stable"]))
    )
    best = F.when(
        best_ok, _template(texts["best"], growth=format_2f("MaxGrowth"), period=F.col("MaxPeriod"))
    ).otherwise(F.lit(""))
    return lb.select(
        "DataType",
        "Name",
        "LatestPeriod",
        "LatestGrowth",
        trend.alias("Trend"),
        F.when(best_ok, F.col("MaxGrowth")).alias("BestGrowth"),
        F.when(best_ok, F.col("MaxPeriod")).alias("BestPeriod"),
        F.concat(head, tail, best).alias("Insight"),
    )

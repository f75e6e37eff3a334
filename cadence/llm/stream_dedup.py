"""Exact deduplication with durable keyed state (Structured Streaming, DataFrame functions only).

Every row's digest, stable identifier and content locator (file, row in it) go
into a *landing* table. A stream over that table keeps, for each digest, the
first row (smallest identifier, then locator) and a count in a RocksDB state
store without watermark, so nothing ever expires. The state lives in the
stream's checkpoint folder: a later delivery that lands in the same folders
continues it. On a hit (a row whose digest the state knows under another
locator) the full normalised bytes of both rows are compared; rows that share
a digest only are grouped again by their whole text.

Defined cases: null text counts as empty; null identifiers come last; of rows
with the same identifier and text the first by locator stays; an empty table
gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, materialize, pick, scratch_path

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Members of a group that one task compares with their kept row; larger groups are salted.
COMPARE_ROWS = 1000


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def file_backed(docs: DataFrame) -> DataFrame:
    """``docs`` itself when its rows come straight from Parquet files, else a copy written to the scratch folder."""
    try:
        docs.select(docs.metadataColumn("_metadata").getField("row_index")).schema  # noqa: B018  analysed here
        return docs
    except AnalysisException:
        return materialize(docs, "dedup-docs")


def located(docs: DataFrame) -> DataFrame:
    """A file-backed frame with its content locator (``__file``, ``__row``)."""
    m = docs.metadataColumn("_metadata")
    return docs.withColumns({"__file": m.getField("file_path"), "__row": m.getField("row_index")})


def placed(docs: DataFrame) -> DataFrame:
    """A file-backed frame's columns under names of their place (``__c0`` ..), and its content locator."""
    m = docs.metadataColumn("_metadata")
    own = [pick(docs, c).alias(f"__c{i}") for i, c in enumerate(docs.columns)]
    return docs.select(*own, m.getField("file_path").alias("__file"), m.getField("row_index").alias("__row"))


def update_state(spark: SparkSession, landing: str, state: str, files_per_trigger: int = 1000) -> None:
    """Fold the landing files that the state has not seen yet into it.

    The result does not depend on how files fall into micro-batches: the state
    holds a minimum and a count.
    """
    conf = {
        "spark.sql.streaming.stateStore.providerClass": PROVIDER,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # one small store a partition: no megabytes set aside for logs that stay short
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    was = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.readStream.schema(spark.read.parquet(landing).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(landing)
        keyed = rows.groupBy("key").agg(
            F.min(F.struct(F.col("id").isNull().alias("last"), "id", "file", "row")).alias("first"),
            F.count(F.lit(1)).alias("n"),
        )
        query = (
            keyed.writeStream.format("noop").outputMode("update")
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


def decisions(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    key_of: Callable[[Column], Column] | None = None,
    landing: str | None = None,
    state: str | None = None,
    files_per_trigger: int = 1000,
) -> DataFrame:
    """One row per input row: ``id, file, row, sha, keep_id, keep_file, keep_row, n``.

    ``key_of`` maps the SHA-256 of a normalised text to the state's key (default:
    the SHA-256 itself); full bytes are compared whatever it is. With ``landing``
    and ``state`` given, the rows join those of earlier deliveries, whose decisions
    come back too when ``docs`` still holds their files.
    """
    spark = docs.sparkSession
    landing = landing or scratch_path(spark, "dedup-landing")
    state = state or scratch_path(spark, "dedup-state")
    key_of = key_of or (lambda sha: sha)
    rows = located(file_backed(docs))
    text = normalised(pick(rows, text_col))
    sha = F.unhex(F.sha2(text, 256))
    seen = rows.select(pick(rows, id_col).alias("id"), F.col("__file").alias("file"), F.col("__row").alias("row"), sha.alias("sha"))
    seen = seen.withColumn("key", key_of(F.col("sha")))
    seen.write.mode("append").parquet(landing)
    if spark.read.parquet(landing).isEmpty():
        return spark.read.parquet(landing).select(
            "id", "file", "row", "sha", F.col("id").alias("keep_id"), F.col("file").alias("keep_file"),
            F.col("row").alias("keep_row"), F.lit(0).cast("long").alias("n"),
        )
    update_state(spark, landing, state, files_per_trigger)

    held = spark.read.format("statestore").load(state).select("key.key", "value.*").toDF("key", "first", "n")
    # one row per input row meets the one state row of its key: a hot key's rows are split by Spark's skew join
    found = materialize(
        spark.read.parquet(landing).join(held, "key").select(
            "id", "file", "row", "sha", "key", "n",
            F.col("first.id").alias("keep_id"), F.col("first.file").alias("keep_file"), F.col("first.row").alias("keep_row"),
        ),
        "dedup-found",
    )

    # full bytes of every hit against its kept row, `COMPARE_ROWS` members a task at most
    salts = F.ceil(F.col("n") / COMPARE_ROWS).cast("int")
    hits = rows.select(F.col("__file").alias("file"), F.col("__row").alias("row"), text.alias("body")).join(
        found.filter("n > 1").select("key", "id", "file", "row", "keep_file", "keep_row", salts.alias("salts")), ["file", "row"]
    )
    # a copy of the hits' texts only, so that the shuffle of all texts runs once
    hits = materialize(hits, "dedup-hits")
    own = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    kept = hits.filter(own).select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("body").alias("kept_body"))
    spread = F.pmod(F.xxhash64("file", "row"), F.col("salts")).cast("int")
    odd = (
        hits.filter(~own).select("key", spread.alias("salt"), "id", "file", "row", "body")
        .join(kept, ["key", "salt"]).filter(F.col("body") != F.col("kept_body"))
        .select("key", "id", "file", "row", "body")
    )
    odd = materialize(odd, "dedup-collisions")
    if odd.isEmpty():
        return found.drop("key")

    # rows that share the key but not the text: their own groups, by whole text
    again = odd.groupBy("key", "body").agg(
        F.min(F.struct(F.col("id").isNull().alias("last"), "id", "file", "row")).alias("first"), F.count(F.lit(1)).alias("n2")
    )
    moved = odd.join(again, ["key", "body"]).select("file", "row", "n2", "first")
    lost = odd.groupBy("key").agg(F.count(F.lit(1)).alias("lost"))
    swap = lambda was, now: F.when(F.col("n2").isNull(), F.col(was)).otherwise(F.col(f"first.{now}")).alias(was)
    return found.join(lost, "key", "left").join(moved, ["file", "row"], "left").select(
        "id", "file", "row", "sha", swap("keep_id", "id"), swap("keep_file", "file"), swap("keep_row", "row"),
        F.coalesce("n2", F.col("n") - F.coalesce("lost", F.lit(0))).alias("n"),
    )


def report(docs: DataFrame, **kw) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``."""
    d = decisions(docs, **kw)
    return d.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"),
        ((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = file_backed(docs)
    d = decisions(docs, **kw)
    stays = d.filter((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row")))
    stays = stays.select(F.col("file").alias("__file"), F.col("row").alias("__row"))
    return placed(docs).join(stays, ["__file", "__row"], "left_semi").select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""

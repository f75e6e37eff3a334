"""Incremental ingest of report files into the fact store.

New wide reports landing in a folder (one per kind x axis x year, e.g. from
a scraper run) are picked up by a Structured Streaming file source. Each
micro-batch carries only file paths (the ``binaryFile`` source with just
``path`` selected reads no content); ``foreachBatch`` loads those reports with the batch loader.

A report that repeats a key -- in itself, of a report taken before it in the
batch (by name), or of the store -- is refused whole, with a reason, as a
file-by-file insert would; so the store does not depend on how many files a batch holds.

Fault tolerance: the stream's offsets live in a checkpoint folder on shared
storage. A batch writes its decision (which reports it takes, which it refuses and
why) under its number before it appends, and a replayed batch finds that decision
again; the append skips keys that a first try has already written. Keys meet the store once a batch, for the decision: the append of
a new decision checks again only if another writer has come between. A growth table, if one is
named, follows after each batch: only the entities that the batch added facts of are computed anew. So does a
dictionary of names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cadence.functions.rules import Rules
from cadence.session import materialize, path_exists
from cadence.sources import wide_csv
from cadence.sources.names import NameDictionary
from cadence.sources.store import FactStore
from cadence.streaming.growth_table import GrowthTable

PATH_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


@dataclass
class IngestConfig:
    landing_glob: str  # e.g. ".../landing/*.csv", or ".../landing/*/*/*.txt" for report folders that write_reports made
    axis: str  # "annual" | "monthly"
    store_path: str
    rejects_path: str
    checkpoint: str
    max_files_per_trigger: int = 1000
    keep_zero: bool = False  # the store profile keeps positive counts only
    growth_path: str | None = None  # a growth table that follows the store
    rules: Rules | None = None  # its grouping of categories
    names_path: str | None = None  # a dictionary of the store's names


def report_paths_stream(spark: SparkSession, cfg: IngestConfig) -> DataFrame:
    return (
        spark.readStream.format("binaryFile")
        .schema(PATH_SCHEMA)
        .option("maxFilesPerTrigger", cfg.max_files_per_trigger)
        .load(cfg.landing_glob)
        .select("path")
    )


def _store(spark: SparkSession, cfg: IngestConfig) -> FactStore:
    return FactStore.annual(spark, cfg.store_path) if cfg.axis == "annual" else FactStore.monthly(spark, cfg.store_path)


def growth_table(spark: SparkSession, cfg: IngestConfig) -> GrowthTable:
    """The growth table of an ingest: year over year for annual facts, quarter over quarter for monthly ones."""
    return GrowthTable(spark, cfg.growth_path, _store(spark, cfg), "yoy" if cfg.axis == "annual" else "qoq", cfg.rules)


R_STORED = "key exists in store"
_DECISION = "Report string, Reason string"  # a taken report has no reason


def _decide(spark: SparkSession, store: FactStore, loaded: wide_csv.Loaded) -> DataFrame:
    """(Report, Reason) of every report of the batch."""
    rows = loaded.by_report
    refused = wide_csv.refused_reports(rows, store.key)
    rest = rows.join(refused.select("Report"), "Report", "left_anti")
    clash = store.holders(rest, "Report").select("Report", F.lit(R_STORED).alias("Reason"))
    out = materialize(loaded.rejects.unionByName(refused).unionByName(clash), "ingest-refused")
    taken = rows.select("Report").distinct().join(out.select("Report"), "Report", "left_anti")
    return out.unionByName(taken.withColumn("Reason", F.lit(None).cast("string")))


def make_batch_writer(cfg: IngestConfig):
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        # One row per new file in this micro-batch (bounded by maxFilesPerTrigger).
        paths = sorted(r[0] for r in batch.select("path").distinct().collect())
        if not paths:
            return
        store = _store(spark, cfg)
        loaded = wide_csv.load_reports(spark, paths, cfg.axis, keep_zero=cfg.keep_zero)
        decided = f"{cfg.rejects_path}-decisions/batch={int(epoch_id)}"
        clear_at = None  # a replayed batch may be stored in part
        if not path_exists(spark, f"{decided}/_SUCCESS"):
            clear_at = store.version()  # before the table is read: what comes later is checked by the append
            _decide(spark, store, loaded).write.mode("overwrite").parquet(decided)
        decision = spark.read.schema(_DECISION).parquet(decided)
        refused = decision.where(F.col("Reason").isNotNull())
        refused.coalesce(1).write.mode("overwrite").parquet(f"{cfg.rejects_path}/batch={int(epoch_id)}")
        taken = loaded.by_report.join(decision.where(F.col("Reason").isNull()).select("Report"), "Report", "left_semi")
        store.append(taken.drop("Report"), on_conflict="skip", clear_at=clear_at)
        if cfg.growth_path:
            growth_table(spark, cfg).refresh(taken)
        if cfg.names_path:
            NameDictionary(spark, cfg.names_path).refresh(taken)
        loaded.warnings.write.mode("overwrite").parquet(f"{cfg.rejects_path}-warnings/batch={int(epoch_id)}")

    return write_batch


def start_ingest(spark: SparkSession, cfg: IngestConfig, available_now: bool = True) -> StreamingQuery:
    """Start the ingest stream (``availableNow``: process what has landed, then stop)."""
    store = _store(spark, cfg)
    store.create(replace=False)
    writer = (
        report_paths_stream(spark, cfg)
        .writeStream.foreachBatch(make_batch_writer(cfg))
        .option("checkpointLocation", cfg.checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def ingest_available(spark: SparkSession, cfg: IngestConfig) -> DataFrame:
    """Run the stream over every file that has landed so far; return the store."""
    q = start_ingest(spark, cfg, available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return _store(spark, cfg).read()

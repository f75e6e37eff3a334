"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hard_negatives, id_files, jaccard_join, lang_id, mixing, packing, pii, quality, repeat_removal, simhash, stream_dedup, url_lists, whitening
from .common import scratch_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_id_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    id_files.write_ids(table(spark, sf_dir, "documents"), path)
    return id_files.read_ids(spark, path)


def op2_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.report(table(spark, sf_dir, "documents"))


def op4_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.report(table(spark, sf_dir, "documents"))


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.report(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_removal.removed(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.report(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_id_codec": op1_id_codec,
    "op2_pii_deobfuscation": op2_pii_deobfuscation,
    "op3_language_id": op3_language_id,
    "op4_stream_dedup": op4_stream_dedup,
    "op5_url_lists": op5_url_lists,
    "op6_mixing": op6_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_repeat_removal": op8_repeat_removal,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_packing": op10_packing,
    "op11_simhash": op11_simhash,
    "op12_whitening": op12_whitening,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL: dict[str, str] = {
    "op4_stream_dedup": stream_dedup.ORACLE,
    "op5_url_lists": url_lists.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}

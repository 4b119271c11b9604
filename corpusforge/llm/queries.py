"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, jaccard_join, language_id, lm_scoring, mixing, oracle, pii, prefix_trie, quality_classifier, quality_rules, runs, sharding, warc
from .common import read_table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_digest(read_table(spark, sf_dir, "conversations"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(read_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(read_table(spark, sf_dir, "documents"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.corpus_scores(read_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(read_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op11 that SQL can express: counts and the base score."""
    return op11_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9 that SQL can express: base matches of each kind."""
    return op9_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def shard_law_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the law of op6 promises, as one row: totals, gapless slots, near equal sizes, and
    groups of equal texts in one shard each unless they are a twentieth of it."""
    placed = op6_sharding(spark, sf_dir)
    shards = placed.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots"), F.max("size").alias("largest"))
    mean = F.sum("bytes") / sharding.SHARDS
    even = F.greatest(F.max("bytes") - mean, mean - F.min("bytes")) <= F.max("largest") + (sharding.SPLIT_OVER + 0.01) * mean
    totals = shards.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.bool_and((F.col("n") == F.col("slots")) & (F.col("last") + 1 == F.col("n"))).alias("gapless"), (even | (F.count("*") < sharding.SHARDS)).alias("near_equal"), mean.alias("mean"))
    groups = placed.groupBy("text_crc32", "size").agg(F.sum("size").alias("bytes"), F.count_distinct("shard").alias("held"))
    split = groups.where("held > 1").agg(F.min("bytes").alias("least"))
    whole = F.coalesce(F.col("least") > sharding.SPLIT_OVER * F.col("mean"), F.lit(True))
    return totals.crossJoin(split).select("n", "bytes", "gapless", "near_equal", whole.alias("groups_whole"))  # one row each


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_warc, op2_mixing, op3_chat_formatting, op4_quality_classifier, op5_ngram_jaccard_join, op6_sharding, op7_decontamination, op8_language_id, op9_pii, op10_quality_rules, op11_lm_scoring, op12_periodic_runs, op13_prefix_trie, lm_base_scores, pii_base_counts, shard_law_holds)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": oracle.OP1,
        "op2_mixing": oracle.OP2,
        "op3_chat_formatting": oracle.OP3,
        "op5_ngram_jaccard_join": oracle.OP5,
        "op7_decontamination": oracle.OP7,
        "op10_quality_rules": oracle.OP10,
        "op13_prefix_trie": oracle.OP13,
        "lm_base_scores": oracle.LM_BASE,
        "pii_base_counts": oracle.PII_BASE,
        "shard_law_holds": oracle.SHARD_LAW,
    }

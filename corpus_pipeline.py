"""Corpus pipeline: rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a
DataFrame; ``run`` writes each stage's result as Parquet below the shared folder of
``spark.checkpoint.dir`` and reads it back as the next stage's input.

Edge cases, in every stage: an empty table gives an empty table; repeated rows are judged
alike; columns of any name are kept as they are, up to the last stage, which has its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm import decontam, jaccard_join, mixing, quality_rules, sharding
from corpusforge.llm.common import Scratch, drop_path, owning, read_table


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and wordless texts have fewer than fifty words and go.
    """
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: five words, similarity 0.75.

    That with the smallest id stays, one row of it.  Rows without an id stay only where
    nothing alike has one; rows without words link with nothing.
    """
    return jaccard_join.keep_one_per_component(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with an item of the benchmark.

    Texts without words share none and stay; so do all if there is no item.
    """
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, each as often as it is taken.

    A null source is a source; texts without words are never taken; a document is taken
    three times at most, a repeated row as often for each of its rows.
    """
    return mixing.take_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document of the mix.

    A null text has no bytes; null and repeated ids are rows like others.
    """
    return sharding.assign_shards(docs)


STAGES = [
    ("quality_rules", apply_rules),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_text),
    ("source_mixing", mix),
    ("sharding", shard),
]

#: SQL has no counterpart of the hash-ordered mix and the sampled splitters; the tests
#: compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents of ``sf_dir``; the stored table belongs to the
    caller, who may work inside ``owning(spark)``."""
    folder = Scratch(spark).path("pipeline", keep=True)
    docs, last = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        with owning(spark):  # what the stage's result reads goes once it is stored
            made = stage(spark, docs, sf_dir)
            made.write.parquet(out)
        docs = spark.read.schema(made.schema).parquet(out)
        if last is not None:
            drop_path(spark, last)
        last = out
    return docs

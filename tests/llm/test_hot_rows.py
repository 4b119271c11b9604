"""Equal rows, texts of one word, and many sources."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from corpusforge.llm import decontam, language_id, mixing
from corpusforge.operators.indexing import running_total


@pytest.mark.parametrize("doc_id", [1, 3, 4, 8, 15])
def test_a_language_of_equal_rows_is_learned(spark, doc_id):
    from zlib import crc32

    if crc32(str(doc_id).encode()) % 4 == 2:
        doc_id += 100
    same = spark.range(20_000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit("zwölf boxkämpfer jagen viktor quer über den großen sylter deich").alias("text"), F.lit("de").alias("lang"))
    other = spark.range(50).select((F.col("id") + 1000).alias("doc_id"), F.lit("the quick brown fox jumps over the lazy dog").alias("text"), F.lit("en").alias("lang"))
    profiles = language_id.learn_profiles(same.union(other))
    assert profiles.predict("boxkämpfer jagen viktor")[0] == "de" and profiles.predict("brown fox jumps over")[0] == "en"


def test_an_item_of_one_long_word_is_not_collected(spark, monkeypatch):
    monkeypatch.setattr(decontam.ItemBlock, "build", None)  # the path that gathers texts fails
    word = F.repeat(F.lit("語"), 14 << 20)
    items = spark.range(1).select(F.col("id").alias("item_id"), word.alias("text"))
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 1, word).otherwise(F.lit("other words")).alias("text"))
    got = {r["doc_id"]: r["n_hit"] for r in decontam.contamination_report(docs, items).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_the_bound_of_bytes_changes_nothing(spark, docs, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = lambda **o: sorted(map(tuple, decontam.contamination_report(docs, items, **o).collect()))
    assert rows() == rows(block_bytes=10)


def brute_targets(sizes, weights, epochs):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > epochs * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("range_rows", [40, 100_000])
def test_targets_of_many_sources(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "running_total", functools.partial(running_total, range_rows=range_rows))
    rng = random.Random(3)
    sizes = {f"s{rng.random()}": int(rng.paretovariate(0.7) * 10) for _ in range(1500)} | {None: 77, "": 5, "zero": 0}
    df = spark.createDataFrame([(f"s{k}" if k is not None else "null", k, v) for k, v in sizes.items()], "q string, source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes, mixing.WEIGHTS, mixing.EPOCHS)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)

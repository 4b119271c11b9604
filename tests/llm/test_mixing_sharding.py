import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import mixing, sharding
from corpusforge.llm.common import Scratch


def fill(sizes, weights, epochs=3):
    """Targets by resharing the excess again and again."""
    target, total = {}, float(sum(sizes.values()))
    open_ = [s for s in sizes if sizes[s] or True]
    left = total
    while open_:
        w = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > epochs * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        for s in over:
            target[s] = float(epochs * sizes[s])
        left = total - sum(target.values())
        open_ = [s for s in open_ if s not in target]
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 50, "d": 3}, {"a": 5, "b": 5}, {"z": 7}, {"a": 0, "b": 9}, {"a": 1, "b": 1, "c": 1000, None: 2}])
def test_targets(spark, sizes):
    names = sorted((s for s in sizes if s), key=lambda s: s) + [s for s in sizes if s is None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    df = spark.createDataFrame([(str(s), s, n) for s, n in sizes.items()], "q string, source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(fill(sizes, weights))


def test_mix(spark, docs):
    rows = mixing.mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert (rows["taken"] <= 3 * rows["size"]).all() and (rows["taken"] % rows["size"].clip(lower=1) == 0).all()
    total = rows["size"].sum()
    assert total - rows["size"].max() * 3 <= rows["taken"].sum() <= total
    for _, g in rows.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 2 * g["size"].max() + 0.05 * g["target"].iloc[0] + rows["size"].max()
    again = mixing.mix_sources(docs.repartition(7)).toPandas()
    assert rows[["doc_id", "taken"]].sort_values("doc_id").values.tolist() == again[["doc_id", "taken"]].sort_values("doc_id").values.tolist()
    mixed = Counter(r["doc_id"] for r in mixing.take_mix(docs).collect())
    assert dict(mixed) == {int(a): int(b // c) for a, b, c in rows[["doc_id", "taken", "size"]].values.tolist() if b}


def test_mix_of_repeated_and_missing_ids(spark):
    """A third of the rows without id, ids repeated across sources, equal rows."""
    rows = [(None if i % 3 == 0 else i % 50, f"{'word ' * (5 + i % 7)}{i % 40}", f"s{i % 3 if i < 400 else 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    mixed = mixing.mix_sources(df)
    assert mixed.count() == 3000
    want = mixed.agg(F.sum("taken"), F.max(F.col("taken") / F.col("size"))).first()
    taken = mixing.take_mix(df).withColumn("n", mixing.word_count("text"))
    assert taken.agg(F.sum("n")).first()[0] == want[0] and want[1] <= 3
    budget = sum(len(t.split()) for _, t, _ in rows)
    assert budget - 40 <= want[0] <= budget
    by_source = {r["source"]: r["n"] for r in taken.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    goal = {r["source_size"]: r["target"] for r in mixed.select("source_size", "target").distinct().collect()}
    for name in ("s0", "s1", "s2"):
        size = sum(len(t.split()) for _, t, s in rows if s == name)
        assert abs(by_source[name] - goal[size]) <= 40
    again = mixing.take_mix(df.repartition(3))
    assert Counter(map(tuple, again.collect())) == Counter(tuple(r)[:3] for r in taken.collect())


def test_mix_divides_the_last_range(spark, docs, monkeypatch):
    want = Counter(map(tuple, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "SORTED", 2)
    monkeypatch.setattr(mixing, "RANGES", 4)
    assert Counter(map(tuple, mixing.mix_sources(docs).collect())) == want


def test_rows_without_id_are_spread(spark):
    """Equal rows are one entry a partition, and rows of equal text and id have different keys."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id"))).otherwise("the same text").alias("text"), F.lit("s").alias("source")).repartition(8)
    with Scratch(spark) as scope:
        rows = scope.write(mixing._sized(mixing._numbered(df)), "sized")
        mixed = mixing._mix(rows, scope, (1,), 3)
        assert mixed.count() == 6000 and mixed.select("row").distinct().count() == 6000
    placed = sharding.assign_shards(df).collect()
    verify(placed, [(r["doc_id"], r["text"]) for r in df.collect()])
    assert len({r["shard"] for r in placed if r["doc_id"] is None}) > 5


def test_mix_odd(spark, odd):
    out = mixing.mix_sources(odd).toPandas()
    assert len(out) == odd.count() and (out["taken"] <= 3 * out["size"]).all()
    assert mixing.take_mix(odd).columns == odd.columns
    assert mixing.mix_sources(odd.limit(0)).count() == 0 and mixing.mix_sources(odd.where("doc_id = 2")).first()["taken"] == 0


def test_plan_has_no_python(spark, docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def verify(rows, texts, shards=40):
    total = sum(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        assert r["law"] == "bytes" and 0 <= r["shard"] < shards and r["grown_shard"] is None
        by[r["shard"]].append(r)
    for group in by.values():
        assert sorted(r["slot"] for r in group) == list(range(len(group)))
    sizes = [sum(r["size"] for r in by[s]) for s in range(shards)] if len(by) == shards else []
    slack = max(r["size"] for r in rows) + 0.06 * total / shards
    assert all(abs(s - total / shards) <= slack for s in sizes)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)


def test_shards(spark, docs):
    rows = sharding.assign_shards(docs).collect()
    verify(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_hot_group_is_split(spark):
    """A third of all rows are one text, most of the bytes one other text."""
    texts = [(i, "same text" if i % 3 == 0 else f"text number {i}" if i % 3 == 1 else "long " * 300) for i in range(6000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = sharding.assign_shards(df).collect()
    verify(rows, texts)
    assert len({r["shard"] for r in rows}) == 40
    again = sharding.assign_shards(df.repartition(5)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_small_groups_stay_together(spark):
    texts = [(i, f"group {i // 4} " * 5) for i in range(8000)]
    by = defaultdict(set)
    for r in sharding.assign_shards(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        by[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in by.values())


def test_shards_odd(spark, odd):
    verify(sharding.assign_shards(odd).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], 40)
    assert sharding.assign_shards(odd.limit(0)).count() == 0


def test_splitters():
    keys = sharding._pairs(np.array([5] * 90 + list(range(10, 20))), np.arange(100))
    cut = sharding.choose_splitters(keys, 10)
    assert (5, np.iinfo(np.int64).min) in [tuple(x) for x in cut.tolist()] and sum(x[0] == 5 for x in cut.tolist()) > 5
    assert len(sharding.choose_splitters(keys[:0], 10)) == 0

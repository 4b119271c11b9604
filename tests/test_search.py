"""Search semantics on hand-made rows."""

from math import inf

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import embedding
from corpusforge.operators import search
from corpusforge.operators.ann import IvfIndex, should_build
from corpusforge.operators.search import SearchConfig
from corpusforge.plans.queries import QUERIES

SCHEMA = "chunk_id long, file string, content string, vector array<float>"
PLAIN = SearchConfig(semantic_weight=1.0, recency_boost=0.0)


def rows(spark, *r):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(r)], SCHEMA)


def files(df):
    return [r["file"] for r in df.collect()]


def test_index_too_small_falls_back(spark):
    c = rows(spark, ("a.js", "alpha", [1.0, 0.0]), ("b.js", "beta", [0.0, 1.0]))
    few = spark.createDataFrame([(0,), (0,)], "chunk_id long")
    assert "b.js" in files(search.hybrid_search(c, "beta", [1.0, 0.0], k=2, config=PLAIN, candidates=few))


def test_exact_match_outside_of_the_index(spark):
    c = rows(spark, ("a.js", "alpha content", [1.0, 0.0]), ("b.js", "exact match term", [0.0, 1.0]))
    one = spark.createDataFrame([(0,)], "chunk_id long")
    assert files(search.hybrid_search(c, "exact", [0.0, 1.0], k=1, config=PLAIN, candidates=one)) == ["b.js"]


def test_null_content_and_foreign_dimension(spark):
    c = rows(spark, ("a.js", None, [1.0, 0.0]), ("b.js", "x", [1.0, 0.0, 0.0]), ("c.js", "y", None))
    assert files(search.hybrid_search(c, "match", [1.0, 0.0], k=5, config=PLAIN)) == ["a.js"]


def test_partial_and_short_words(spark):
    c = rows(spark, ("a.js", "some longcontent here", [1.0, 0.0]))
    config = SearchConfig(semantic_weight=0.0, recency_boost=0.0)
    assert search.hybrid_search(c, "longcontent missing", [1.0, 0.0], config=config).first()["score"] == pytest.approx(0.15)
    assert search.hybrid_search(c, "is missingword", [1.0, 0.0], config=config).first()["score"] == 0


@pytest.mark.parametrize(("age_days", "days", "want"), [(0, 0, 1.5), (5, 10, 1.25), (400, 30, 1.0)])
def test_recency(spark, age_days, days, want):
    c = rows(spark, ("a.js", "zzz", [1.0, 0.0]))
    times = spark.createDataFrame([("a.js", 1e12 - age_days * 86_400_000.0)], "file string, mtime_ms double")
    config = SearchConfig(semantic_weight=1.0, recency_boost=0.5, recency_days=days)
    assert search.hybrid_search(c, "q", [1.0, 0.0], 10**12, config=config, mtimes=times).first()["score"] == pytest.approx(want)


def test_call_graph_boost(spark):
    c = rows(spark, ("source", "function seed() {}", [1.0, 0.0]), ("related", "", [0.9, 0.0]), ("unrelated", "", [0.8, 0.0]))
    edges = spark.createDataFrame([("seed", "related")], "symbol string, file string")
    out = search.hybrid_search(c, "q", [1.0, 0.0], config=SearchConfig(semantic_weight=1.0, call_graph_boost=10.0), call_edges=(edges.limit(0), edges))
    scores = {r["file"]: r["score"] for r in out.collect()}
    assert scores["related"] > 10 and scores["unrelated"] < 1


def test_blank_query_and_empty_table(spark):
    with pytest.raises(ValueError):
        search.hybrid_search(rows(spark).limit(0), "  ", [1.0])
    assert search.hybrid_search(spark.createDataFrame([], SCHEMA), "abc", [1.0, 0.0]).count() == 0


def test_similar_leaves_the_input_out(spark):
    c = rows(spark, ("a", "same  code ", [1.0, 0.0]), ("b", "other code", [0.0, 1.0]))
    assert files(search.find_similar(c, [1.0, 0.0], "same code", min_similarity=0)) == ["b"]


def test_similar_rescans_after_repeated_labels(spark):
    c = rows(spark, ("a", "alpha", [1.0, 0.0]), ("b", "beta", [0.5, 0.5]))
    twice = spark.createDataFrame([(0,), (0,)], "chunk_id long")
    assert search.find_similar(c, [1.0, 0.0], k=2, min_similarity=0, candidates=twice).count() == 2


def test_similar_without_a_limit(spark, sf):
    c = rows(spark, *[(f"f{i}", f"text {i}", [1.0, 0.0]) for i in range(9)], ("far", "other", [0.0, 1.0]))
    first = spark.createDataFrame([(0,)], "chunk_id long")
    for candidates in (None, first):
        found = search.find_similar(c, [1.0, 0.0], "text  3", inf, 0.8, candidates, rescan_limit=0)
        assert sorted(files(found)) == [f"f{i}" for i in range(9) if i != 3]
    million = spark.range(1_000_003).select(F.col("id").alias("chunk_id"), F.lit("f").alias("file"), F.lit("x").alias("content"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    assert search.find_similar(million, [1.0, 0.0], "y", inf, 0.8).count() == 1_000_003
    assert "Limit" not in QUERIES["similar_text_excluding_input"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_format(spark):
    c = rows(spark, ("a.js", "body", [1.0, 0.0]))
    text = search.format_results(search.hybrid_search(c, "q", [1.0, 0.0], config=PLAIN)).first()["markdown"]
    assert "Result 1" in text and "100.0%" in text and "a.js" in text and "body" in text


def test_ranking_is_a_heap_per_task(spark, sf):
    from corpusforge.plans.queries import vectors

    plan = vectors(spark, sf).select("chunk_id", search.semantic_score([0.1] * 64).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_index_recall_add_store(spark, sf, tmp_path):
    import numpy as np

    from corpusforge.plans.queries import vectors

    v = vectors(spark, sf)
    index = IvfIndex.build(v, path=f"file://{tmp_path}/ann")
    t = v.orderBy("chunk_id").toPandas()
    m = np.stack(t["vector"]).astype(float)
    hits = 0
    for i in range(0, len(m), 50):
        exact = set(np.lexsort((np.arange(len(m)), -(m @ m[i])))[:10].tolist())
        hits += len(exact & {r["chunk_id"] for r in index.search(m[i], 10).collect()})
    index.set_effort(index.meta.lists)
    all_lists = {r["chunk_id"] for r in index.search(m[0], 10).collect()}
    assert all_lists == set(np.lexsort((np.arange(len(m)), -(m @ m[0])))[:10].tolist())
    assert hits / (10 * len(range(0, len(m), 50))) >= 0.9
    again = IvfIndex.load(spark, f"file://{tmp_path}/ann", "hashing", 64)
    assert again.rows.count() == len(m) and IvfIndex.load(spark, f"file://{tmp_path}/ann", "other", 64) is None
    more = again.add(spark.createDataFrame([(10**6, [1.0] + [0.0] * 63)], "chunk_id long, vector array<float>"))
    assert more.rows.count() == len(m) + 1
    assert more.stats().first()["lists"] == index.meta.lists
    with pytest.raises(ValueError):
        index.set_effort(0)
    assert not should_build(4999, 64) and should_build(5000, 64)


def test_embedder_agrees_with_expressions(spark):
    texts = spark.createDataFrame([(1, "Hello hello world_2 a"), (2, ""), (3, None)], "doc_id int, text string")
    long = {(r["doc_id"], r["bucket"]): r["weight"] for r in embedding.token_weights(texts).collect()}
    v = embedding.HashingEmbedder(normalize=False)("Hello hello world_2 a")
    assert {(1, i): int(x) for i, x in enumerate(v) if x} == long
    assert embedding._hash("hello") == 1335831723
    assert embedding.HashingEmbedder()("")[0] == 1


def test_bad_text_costs_its_own_row(spark):
    def make():
        def model(texts):
            if any(t == "bad" for t in texts):
                raise RuntimeError("no")
            return [[float(len(t))] for t in texts]

        return model

    out = embedding.embed_with_status(spark.createDataFrame([("ok",), ("bad",), ("fine",)], "text string"), make)
    got = {r["text"]: (r["embedding"]["success"], r["embedding"]["vector"]) for r in out.collect()}
    assert got == {"ok": (True, [2.0]), "bad": (False, None), "fine": (True, [4.0])}

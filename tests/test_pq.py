"""Product-quantised lists against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.operators import pq
from corpusforge.operators.pq import PqIndex
from corpusforge.plans.queries import turned_vectors


@pytest.fixture(scope="module")
def rows(spark, sf, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('turned')}/v"
    turned_vectors(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('pq')}/i"
    PqIndex.build(rows, path, lists=40)
    return PqIndex.load(spark, path, "hashing", 64)


def test_recall_of_few_lists(rows, index):
    held = rows.orderBy("chunk_id").collect()
    m = np.array([r["vector"] for r in held])
    ids = np.array([r["chunk_id"] for r in held])
    assert index.meta.lists == 40 and index.meta.nprobe <= 13 and index.rows.count() == len(held)
    hits = 0
    for i in range(0, 200, 20):
        best = ids[np.lexsort((ids, -(m @ m[i])))[:10]]
        got = [r["chunk_id"] for r in index.search(m[i].tolist(), 10, rows).collect()]
        hits += len(set(best.tolist()) & set(got))
    assert hits >= 95


def test_estimates_are_near_and_read_codes_only(rows, index):
    q = rows.where("chunk_id = 0").first()["vector"]
    named = index.nominees(q, 50)
    exact = {r["chunk_id"]: r["s"] for r in rows.select("chunk_id", pq.semantic_score(q).alias("s")).collect()}
    assert max(abs(exact[r["chunk_id"]] - r["estimate"]) for r in named.collect()) < 0.2
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert "vector" not in plan and "PartitionFilters: []" not in plan


def test_codewords(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    w = pq.train_codewords(x)
    near = pq.nearest(x, w)
    assert np.array_equal(near, np.argmin(((x[:, None] - w[None]) ** 2).sum(axis=2), axis=1))
    assert ((x - w[near]) ** 2).sum() < 0.1 * (x**2).sum()
    same = np.ones((3, 4))
    assert np.allclose(pq.train_codewords(same), 1)


def test_edge_cases(spark, rows, index, tmp_path):
    assert index.search([1.0, 0.0], 5, rows).count() == 0
    left = rows.where("chunk_id % 2 = 1")
    q = rows.where("chunk_id = 0").first()["vector"]
    assert all(r["chunk_id"] % 2 == 1 for r in index.search(q, 5, left).collect())
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [1.0, 0.0])], "chunk_id long, vector array<float>")
    small = PqIndex.build(odd, f"file://{tmp_path}/s")
    assert [r["chunk_id"] for r in small.search([1.0, 0.0], 2, odd).collect()] == [1, 4]
    empty = PqIndex.build(odd.limit(0), f"file://{tmp_path}/e")
    assert empty.search([1.0], 3, odd).count() == 0
    assert PqIndex.load(spark, f"file://{tmp_path}/s", "other", 2) is None and PqIndex.load(spark, f"file://{tmp_path}/none", "hashing", 2) is None
    assert small.rows.agg(F.count("*")).first()[0] == 3


def test_probes_are_those_of_all_rows(rows, tmp_path, monkeypatch):
    """A thin sample's own neighbours lie in more lists than the real ones."""
    monkeypatch.setattr(pq, "SAMPLE", 300)
    monkeypatch.setattr(pq, "SAMPLE_A_LIST", 1)
    thin = PqIndex.build(rows, f"file://{tmp_path}/i", lists=40)
    assert thin.meta.lists == 40 and thin.meta.nprobe <= 13

"""Trigram postings and lookups by id."""

import random

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import substring
from corpusforge.operators.search import augment_exact
from corpusforge.operators.substring import SubstringIndex, by_id, grams
from corpusforge.sources import stores

TEXTS = ["Hello World", "hello", "he", "h", "", None, "über die Brücke", "ΣΑΣ sas", "a\x00b", "ab", "日本語のテキスト", "x" * 500, "aXbXc", "😀😀 smile"]


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "Alphabet", "beautiful", "é", "日本"]
    rows = [(i * 7000, t) for i, t in enumerate(TEXTS)] + [(200_000 + i, " ".join(rng.choice(words) for _ in range(12))) for i in range(300)]
    return spark.createDataFrame(rows, "chunk_id long, content string")


def ids(df):
    return sorted(r["chunk_id"] for r in df.collect())


NEEDLES = ["hello", "HELLO WORLD", "he", "h", "lo", "ld", "ü", "brücke", "σας", "a\x00b", "b", "本語", "日本 ", "xxxxxxxxxx", "xbx", "😀", "alphabet beta", "gamma delta gamma", "absent words", "ab", "alpha"]


@pytest.mark.parametrize("literal", [0, 1000])
def test_search_equals_the_scan(spark, chunks, tmp_path, monkeypatch, literal):
    monkeypatch.setattr(substring, "LITERAL", literal)
    SubstringIndex.build(chunks, f"file://{tmp_path}/i")
    index = SubstringIndex.load(spark, f"file://{tmp_path}/i")
    for needle in NEEDLES:
        want = ids(chunks.where(F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lower(F.lit(needle)))))
        assert ids(index.search(needle, chunks)) == want, needle
        assert set(want) <= set(ids(index.candidates(needle)))


def test_candidates_are_few(spark, chunks, tmp_path):
    index = SubstringIndex.build(chunks, f"file://{tmp_path}/i")
    assert len(ids(index.candidates("hello world"))) == 1 and not ids(index.candidates("hello there"))
    plan = index.search("hello world", chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert "chunk_id" in plan and "Join" not in plan


def test_additions_and_stale_ids(spark, chunks, tmp_path):
    index = SubstringIndex.build(chunks.where("chunk_id < 200100"), f"file://{tmp_path}/i")
    grown = index.add(chunks)
    assert len(grown.parts) == 2 and grown.last_id == 200_299
    assert ids(grown.search("alphabet", chunks)) == ids(chunks.where("content ilike '%alphabet%'"))
    left = chunks.where("chunk_id % 2 = 0")
    assert ids(grown.search("alphabet", left)) == ids(left.where("content ilike '%alphabet%'"))
    assert grown.add(chunks).parts == grown.parts
    empty = SubstringIndex.build(chunks.limit(0), f"file://{tmp_path}/e")
    assert ids(empty.search("a", chunks)) == [] and ids(empty.add(chunks).search("hello", chunks)) == [0, 7000]
    assert SubstringIndex.load(spark, f"file://{tmp_path}/none") is None


def test_augmented_candidates(spark, chunks, tmp_path):
    index = SubstringIndex.build(chunks, f"file://{tmp_path}/i")
    some = chunks.where("chunk_id in (0, 14000)").select("chunk_id")
    for needed in (1, 2, 5):
        assert ids(augment_exact(some, chunks, "hello", needed, index=index)) == ids(augment_exact(some, chunks, "hello", needed))


def test_grams_cover_every_place():
    assert grams("") == set() and grams("ab") == {"ab\x00", "b\x00\x00"} and len(grams("abcd")) == 4


def test_lookup_reads_few_row_groups(spark, tmp_path):
    store = stores.VersionedStore(spark, f"file://{tmp_path}/s")
    n = 200_000
    rows = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("chunk_id"), F.concat(F.lit("f"), F.floor(F.col("id") / 10)).alias("file"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.sha2(F.col("id").cast("string"), 256).alias("content"), F.lit(None).cast("array<float>").alias("vector"))
    store.save(stores.StoreMeta(), chunks=rows)
    wanted = [17, 4711, 99_999, n + 5, -3]
    found = by_id(store.read("chunks"), wanted).select("chunk_id", "file")
    assert ids(found) == [17, 4711, 99_999] and ids(by_id(store.read("chunks"), [])) == []
    assert ids(by_id(store.read("chunks"), list(range(100, 200)))) == list(range(100, 200))
    read = by_id(store.read("chunks"), [n + 5, -3]).select("chunk_id")
    read.collect()
    scan = read._jdf.queryExecution().executedPlan()
    while "Scan" not in scan.nodeName():
        scan = scan.finalPhysicalPlan() if "AdaptiveSparkPlan" in scan.nodeName() else scan.children().head()
    assert scan.metrics().get("numOutputRows").get().value() < n / 2


def test_a_task_brings_postings_together(monkeypatch):
    """Not a row for each place: a task's lists hold many ids, also over several parts and batches."""
    import pyarrow as pa

    from corpusforge.operators import substring as s

    monkeypatch.setattr(s, "ROWS_A_BATCH", 3)
    far = s.PART + 1
    rows = [(5, "abcabc"), (2, "abc"), (far, "zabc"), (7, None), (8, ""), (9, "ab")]
    for held, most in ((1000, 1), (1, 4)):
        monkeypatch.setattr(s, "HELD_POSTINGS", held)
        out = [r for b in s._list_grams(iter([pa.RecordBatch.from_pylist([{"chunk_id": i, "content": t} for i, t in rows])])) for r in b.to_pylist()]
        lists = [(r["gram"], r["part"]) for r in out]
        assert max(lists.count(x) for x in lists) <= most
        got = sorted((r["gram"], r["part"] * s.PART + i) for r in out for i in r["ids"])
        assert got == sorted((g, i) for i, t in rows for g in s.grams(t or ""))
    assert {r["gram"]: r["ids"] for r in out if r["gram"] == "ab\x00"} == {"ab\x00": [9]}

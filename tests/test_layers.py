"""Layered stores, resumed index runs and the stored approximate index."""

import os

import pytest
from pyspark.sql import functions as F

from corpusforge import workspace
from corpusforge.operators import ann, search
from corpusforge.sources import stores
from corpusforge.workspace import Workspace


def chunk(i, file, content="text", vector=None):
    return (i, file, 1, 2, content, vector)


def chunks(spark, rows):
    return spark.createDataFrame(rows, stores.CHUNK_SCHEMA)


def hashes(spark, counts):
    return spark.createDataFrame([(f, "h", 1.0, 2, n) for f, n in counts.items()], stores.VersionedStore.TABLES["file_hashes"])


def bytes_below(path):
    return sum(f.stat().st_size for f in path.rglob("*") if f.is_file())


def files(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "file string")


def test_one_changed_file_writes_little_and_reads_as_a_rewrite(spark, tmp_path):
    store = stores.VersionedStore(spark, f"file://{tmp_path}/s")
    rows = spark.range(20_000).select("id", (F.col("id") / 2).cast("int").cast("string").alias("file"), F.lit(1).alias("a"), F.lit(2).alias("b"), F.sha2(F.col("id").cast("string"), 256).alias("content"), F.lit(None).cast("array<float>"))
    base = rows.toDF(*stores.CHUNK_SCHEMA.names)
    store.save(stores.StoreMeta(), chunks=base, file_hashes=base.groupBy("file").agg(F.lit("h").alias("hash"), F.lit(1.0).alias("mtime_ms"), F.lit(2).cast("long").alias("size"), F.count("*").alias("chunks")))
    before = bytes_below(tmp_path / "s")
    store.apply(stores.StoreMeta(), files(spark, "77"), chunks=chunks(spark, [chunk(90_000, "77", "new")]), file_hashes=hashes(spark, {"77": 1}))
    assert bytes_below(tmp_path / "s") - before < before / 20
    got = {tuple(r) for r in store.read("chunks").select("chunk_id", "file", "content").collect()}
    want = {tuple(r) for r in base.where("file <> '77'").select("chunk_id", "file", "content").collect()} | {(90_000, "77", "new")}
    assert got == want and store.meta().chunks_stored == 19_999 and store.meta().next_chunk_id == 90_001
    assert len(store.meta().layers) == 2 and store.compact() is None
    assert store.compact(all_layers=True) and len(store.meta().layers) == 1
    assert {tuple(r) for r in store.read("chunks").select("chunk_id", "file", "content").collect()} == want
    store.vacuum()
    assert store.read("chunks").count() == 19_999 and len(list((tmp_path / "s" / "layers").iterdir())) == 1


def test_layers_in_any_order_equal_a_dictionary(spark, tmp_path, monkeypatch):
    import random

    rng, state, next_id = random.Random(4), {}, 0
    store = stores.VersionedStore(spark, f"file://{tmp_path}/s")
    monkeypatch.setattr(stores, "GROWTH", 1)
    monkeypatch.setattr(stores, "LAYERS", 2)
    for step in range(7):
        touched = rng.sample("abcdefgh", rng.randint(1, 4))
        kept, only_hash = touched[: len(touched) // 2 + 1], [f for f in state if f not in touched][:1]
        rows = []
        for f in touched:
            state.pop(f, None)
        for f in kept:
            new = [next_id + i for i in range(rng.randint(0, 3))]
            next_id += len(new)
            state[f] = (new, step)
            rows += [chunk(i, f, str(step)) for i in new]
        for f in only_hash:
            state[f] = (state[f][0], step)
        made = spark.createDataFrame([(f, "h", float(state[f][1]), 2, len(state[f][0])) for f in [*kept, *only_hash]], stores.VersionedStore.TABLES["file_hashes"])
        store.apply(stores.StoreMeta(), files(spark, *touched), files(spark, *only_hash) if only_hash else None, chunks=chunks(spark, rows), file_hashes=made)
        assert sorted(r["chunk_id"] for r in store.read("chunks").collect()) == sorted(i for ids, _ in state.values() for i in ids)
        assert {r["file"]: r["mtime_ms"] for r in store.read("file_hashes").collect()} == {f: t for f, (_, t) in state.items()}
        assert store.meta().chunks_stored == sum(len(ids) for ids, _ in state.values())


def test_a_crash_before_the_pointer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = stores.VersionedStore(spark, f"file://{tmp_path}/s")
    store.apply(stores.StoreMeta(), files(spark), chunks=chunks(spark, [chunk(0, "a"), chunk(1, "b")]), file_hashes=hashes(spark, {"a": 1, "b": 1}))

    def crash(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", crash)
        with pytest.raises(OSError):
            store.apply(stores.StoreMeta(), files(spark, "a"), chunks=chunks(spark, [chunk(2, "a")]), file_hashes=hashes(spark, {"a": 1}))
    assert sorted(r["chunk_id"] for r in store.read("chunks").collect()) == [0, 1]
    store.vacuum()
    assert len(list((tmp_path / "s" / "layers").iterdir())) == 1


def write_files(root, n):
    root.mkdir(exist_ok=True)
    for i in range(n):
        (root / f"f{i}.py").write_text(f"def function_{i}(argument):\n    return argument + {i}  # some words to fill the chunk")
        os.utime(root / f"f{i}.py", (1_600_000_000, 1_600_000_000))


def test_a_killed_run_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    write_files(tmp_path / "p", 40)
    monkeypatch.setattr(workspace, "FILES_A_BATCH", 10)
    w = Workspace(spark, str(tmp_path / "p"), f"file://{tmp_path}/cache")
    commit, calls = w._commit, []

    def dies(*a):
        if len(calls) == 2:
            raise RuntimeError("killed")
        calls.append(1)
        commit(*a)

    with monkeypatch.context() as m:
        m.setattr(w, "_commit", dies)
        with pytest.raises(RuntimeError):
            w.index()
    held = w._total()
    assert 0 < held < 40
    again = Workspace(spark, str(tmp_path / "p"), f"file://{tmp_path}/cache")
    report = again.index()
    assert report.processed == 40 - held and report.chunks == 40
    ids = [r["chunk_id"] for r in again.chunks().collect()]
    assert len(set(ids)) == 40


def test_one_edit_adds_one_layer(spark, tmp_path):
    write_files(tmp_path / "p", 300)
    w = Workspace(spark, str(tmp_path / "p"), f"file://{tmp_path}/cache")
    w.index()
    size = bytes_below(tmp_path / "cache")
    (tmp_path / "p/f7.py").write_text("def edited_function(argument):\n    return argument  # other words to fill it")
    assert w.index().processed == 1
    assert bytes_below(tmp_path / "cache") - size < size / 3
    assert w.chunks().where("content like '%edited_function%'").count() == 1 and w._total() == w.chunks().count() == 300


def test_stored_index_is_loaded_and_added_to(spark, tmp_path, monkeypatch):
    write_files(tmp_path / "p", 60)
    config = search.SearchConfig(ann_min_chunks=20)
    w = Workspace(spark, str(tmp_path / "p"), f"file://{tmp_path}/cache", config=config)
    w.index()

    def refuse(*_, **__):
        raise AssertionError("built")

    with monkeypatch.context() as m:
        m.setattr(ann.IvfIndex, "build", refuse)
        second = Workspace(spark, str(tmp_path / "p"), f"file://{tmp_path}/cache", config=config)
        found = second.search("function_7", 5)
        plan = found._jdf.queryExecution().toString()
        assert "MapInArrow" not in plan and "list_no" in plan
        assert found.count() == 5
        write_files(tmp_path / "p", 63)
        assert second.index().processed == 3
        assert second.index_.meta.count == 63 and len(second.index_.meta.parts) == 2
        (tmp_path / "p/f3.py").unlink()
        second.index()
        assert not [r for r in second.search("function_3", 60).collect() if r["file"].endswith("/f3.py")]
    assert second.ann_config("rebuild").first()["count"] == 62
    third = ann.IvfIndex.load(spark, second._ann_path(), "hashing", second.dimension)
    assert third.meta.count == 62 and ann.IvfIndex.load(spark, f"file://{tmp_path}/none", "hashing", 1) is None

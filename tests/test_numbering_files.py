"""Numbering and ranks beyond one range, guarded reading, cache folders, store pieces, and
events that tie."""

import datetime
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.functions import embedding, paths
from corpusforge.operators import indexing
from corpusforge.operators.ann import IvfIndex, capacity
from corpusforge.operators.retention import retention
from corpusforge.sources import caches, files, stores
from corpusforge.streaming import watch
from corpusforge.workspace import Workspace


@pytest.mark.parametrize("range_rows", [20_000, 1_000_000])
def test_numbers_are_gapless_on_many_rows_of_several_columns(spark, range_rows):
    rows = spark.range(300_000).select((F.col("id") * 7919 % 300_007).alias("chunk_id"), F.repeat(F.lit("x"), 20).alias("content"), F.rand(1).alias("other"))
    out = indexing.dense_index(rows, range_rows=range_rows)
    got = out.agg(F.count("*").alias("n"), F.count_distinct("index").alias("d"), F.min("index").alias("a"), F.max("index").alias("b")).first()
    assert (got["n"], got["d"], got["a"], got["b"]) == (300_000, 300_000, 0, 299_999)
    some = {r["chunk_id"]: r["index"] for r in out.select("chunk_id", "index").where("index % 1000 = 0").collect()}
    order = sorted(i * 7919 % 300_007 for i in range(300_000))
    assert all(order[n] == c for c, n in some.items()) and len(some) == 300
    assert out.select("index").distinct().count() == 300_000  # another set of columns, the same numbers


def test_numbers_by_struct_null_and_tied_keys(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.randrange(50), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "f string, n long, i long").withColumn("key", F.struct("f", "n"))
    got = sorted((x["index"], x["f"] or "", x["n"]) for x in indexing.dense_index(df, "key", range_rows=100).collect())
    assert [g[0] for g in got] == list(range(5000)) and [g[1:] for g in got] == sorted((f or "", n) for f, n, _ in rows)
    assert indexing.dense_index(df.limit(0), "key").count() == 0


def test_totals_and_ranks_of_hot_groups(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.col("id") * 31 % 9973).alias("v"))
    got = {r["g"]: r["value"] for r in indexing.nearest_rank(df, "g", "v", 95).collect()}
    table = df.toPandas()
    assert got == {g: sorted(x.v)[min(len(x) - 1, int(len(x) * 0.95))] for g, x in table.groupby("g")}
    listed = indexing.group_by_file(df.select(F.col("g").alias("file"), F.col("v").alias("chunk_id")).distinct())
    assert listed.groupBy("file").agg((F.max("place") + 1 == F.count("*")).alias("ok")).where("not ok").count() == 0


def test_breaker(spark):
    rows = [("a", i, i not in (3, 4, 5, 7, 8)) for i in range(12)] + [("b", i, i % 2 == 0) for i in range(12)] + [("c", i, False) for i in range(5)]
    out = {r["scope"]: (r["tripped_at"], r["failures"]) for r in indexing.breaker(spark.createDataFrame(rows, "scope string, seq long, success boolean"), 3).collect()}
    assert out == {"a": (5, 5), "c": (2, 5)}


def test_embedding_stops_after_failures_in_a_row(spark):
    def make():
        def model(texts):
            if any(t.startswith("bad") for t in texts):
                raise RuntimeError("dead")
            return [[1.0] for _ in texts]

        return model

    texts = spark.createDataFrame([(f"bad{i}",) for i in range(9)], "text string").coalesce(1)
    assert embedding.embed_with_status(texts, make).where("embedding.success").count() == 0
    with pytest.raises(Exception, match="failures one after the other"):
        embedding.embed_with_status(texts, make, fail_fast=8).select("embedding.error").collect()
    mixed = spark.createDataFrame([(f"{'ok' if i % 5 == 0 else 'bad'}{i}",) for i in range(40)], "text string").coalesce(1)
    assert embedding.embed_with_status(mixed, make, batch=4, fail_fast=8).where("embedding.success").count() == 8


def test_every_status_of_a_read(spark, tmp_path, monkeypatch):
    (tmp_path / "ok.py").write_bytes(b"caf\xc3\xa9 \xff")
    (tmp_path / "big.py").write_bytes(b"x" * 200)
    (tmp_path / "dir").mkdir()
    names = [str(tmp_path / n) for n in ("ok.py", "big.py", "dir", "gone.py")]
    rows = {os.path.basename(r["file"]): r for r in files.read_files(spark.createDataFrame([(n,) for n in [*names, None]], "file string"), 100).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"ok.py": "", "big.py": "too_large", "dir": "is_directory", "gone.py": "stat_failed"}
    assert rows["ok.py"]["content"] == "café �" and rows["big.py"]["content"] is None and rows["big.py"]["size"] == 200

    class Broken:
        def __init__(self, size, body):
            self.size, self.body = size, body

        def get_file_info(self, _):
            return type("Info", (), {"type": files.pafs.FileType.File, "size": self.size, "mtime_ns": 5_000_000})

        def open_input_stream(self, *_, **__):
            if self.body is None:
                raise OSError("unreadable")
            return __import__("io").BytesIO(self.body)

    monkeypatch.setattr(files, "open_path", lambda p: (Broken(3, None), p))
    assert files._read_one("x", 10)[0] == "read_failed"
    monkeypatch.setattr(files, "open_path", lambda p: (Broken(3, b"grown " * 9), p))
    assert files._read_one("x", 10)[:2] == ("too_large_after_read", 11)


def test_links_that_lead_out_are_not_contained(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("a")
    (tmp_path / "out.py").write_text("b")
    (tmp_path / "in" / "link.py").symlink_to(tmp_path / "out.py")
    df = spark.createDataFrame([(str(tmp_path / "in" / n),) for n in ("a.py", "link.py", "../out.py")], "file string")
    assert [os.path.basename(r["file"]) for r in files.contained(df, str(tmp_path / "in")).collect()] == ["a.py"]


def test_cache_folders(spark, tmp_path):
    now = 1_700_000_000_000
    iso = lambda ms: datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")

    def cache(name, ago_h, **bodies):
        d = tmp_path / "caches" / name
        d.mkdir(parents=True)
        for part, body in bodies.items():
            f = d / part.replace("_json", ".json").replace("server", "server.lock").replace("vectors", "vectors.bin")
            f.write_text(body if isinstance(body, str) else json.dumps(body))
            os.utime(f, ((now - ago_h * 3_600_000) / 1000,) * 2)
        os.utime(d, ((now - ago_h * 3_600_000) / 1000,) * 2)

    work = tmp_path / "work"
    work.mkdir()
    meta = lambda ago_h, where=str(work): {"workspace": where, "lastSaveTime": iso(now - ago_h * 3_600_000), "embeddingModel": "m", "embeddingDimension": 64, "filesIndexed": 3, "chunksStored": 9}
    cache("good", 100, meta_json=meta(48), vectors="v")
    cache("locked", 100, meta_json=meta(900), server_json={"pid": 4242, "startedAt": iso(now - 90 * 3_600_000)})
    cache("broken", 100, meta_json="{not json")
    cache("empty", 30)
    cache("moved", 300, meta_json=meta(200, "/nowhere/at/all"))
    cache("stuck", 100, meta_json=meta(40), progress_json={"updatedAt": iso(now - 8 * 3_600_000)})
    facts = caches.scan_caches(spark, f"file://{tmp_path}/caches", lambda pid: pid == 4242)
    rows = {r["cache_id"]: r for r in facts.collect()}
    assert set(rows) == {"good", "locked", "broken", "empty", "moved", "stuck"}
    assert rows["good"]["last_activity_ms"] == now - 48 * 3_600_000 and rows["good"]["workspace_exists"] and rows["good"]["dimension"] == 64
    assert rows["locked"]["is_active"] and rows["locked"]["last_activity_ms"] == now - 90 * 3_600_000
    assert not rows["broken"]["has_meta"] and rows["empty"]["last_activity_ms"] == now - 30 * 3_600_000
    assert rows["stuck"]["progress_ms"] == now - 8 * 3_600_000 and not rows["moved"]["workspace_exists"]
    work_is_not_temporary = facts.withColumn("workspace", F.when(F.col("workspace") == str(work), "/home/w").otherwise(F.col("workspace")))
    reasons = {r["cache_id"]: r["reason"] for r in retention(work_is_not_temporary, now, remove_duplicates=False).collect()}
    assert reasons == {"good": "valid_cache", "locked": "active_lock", "broken": "no_meta_stale", "empty": "no_meta_stale", "moved": "workspace_missing", "stuck": "stuck_indexing"}
    assert caches.is_running(os.getpid()) and not caches.is_running(2**30)


@pytest.mark.parametrize("kind", ["binary", "sqlite"])
def test_store_pieces(spark, tmp_path, kind, monkeypatch):
    monkeypatch.setattr(stores, "PIECE_ROWS", 40)
    df = spark.range(300).select(F.col("id").alias("chunk_id"), F.concat(F.lit("f"), F.col("id") % 7).alias("file"), F.lit(1).alias("start_line"), F.col("id").cast("int").alias("end_line"), F.concat(F.lit("é "), "id").alias("content"), F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("vector")).repartition(3)
    manifest = stores.write_pieces(df, f"file://{tmp_path}/s", kind)
    assert manifest.agg(F.sum("chunks")).first()[0] == 300 and manifest.count() >= 8
    (tmp_path / "s" / "pieces" / "piece-00").mkdir()
    (tmp_path / "s" / "pieces" / "piece-00" / ("files.json" if kind == "binary" else "lost.txt")).write_text("left by a lost task")
    back = stores.read_pieces(spark, f"file://{tmp_path}/s", kind)
    got = sorted((r["file"], r["end_line"], r["content"], tuple(r["vector"])) for r in back.collect())
    assert got == sorted((r["file"], r["end_line"], r["content"], tuple(r["vector"])) for r in df.collect())


def test_ties_and_settled_files(spark):
    at = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([("a", "unlink", at, 2), ("a", "add", at, 3), ("a", "change", at, 1)], "path string, event_type string, ts timestamp, seq long")
    assert watch.debounce(events).first()["event_type"] == "add"
    assert watch.debounce(events.drop("seq")).first()["event_type"] == "unlink"
    seen = [("a", 1, 5.0, 0), ("a", 9, 5.0, 500), ("a", 9, 5.0, 2100), ("b", 1, 5.0, 0), ("b", 2, 5.0, 1200), ("b", 2, 6.0, 2000), ("c", 4, 1.0, 0)]
    out = watch.settled(spark.createDataFrame(seen, "path string, size long, mtime_ms double, seen_ms long"), 2100)
    assert {(r["path"], r["stable_ms"]) for r in out.collect()} == {("a", 1600), ("c", 2100)}


def test_a_backlog_loses_no_path(spark):
    events = spark.range(12_000).select(F.concat(F.lit("p"), "id").alias("path"), F.lit("add").alias("event_type"), F.timestamp_seconds("id").alias("ts"))
    none = spark.createDataFrame([], "file string, v int")
    assert watch.apply_batch(none, events, lambda f: f.select("file", F.lit(1).alias("v"))).count() == 12_000
    pending = indexing.coalesce_events(events.withColumn("seq", F.col("ts")))
    assert indexing.trim_pending(pending).count() == 5000 and indexing.trim_pending(pending.limit(9999)).count() == 9999


def test_index_adds_once_and_within_its_capacity(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(2000, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "chunk_id long, vector array<float>")
    index = IvfIndex.build(df.where("chunk_id < 1000"), path=f"file://{tmp_path}/i")
    grown = index.add(df.where("chunk_id < 1200")).add(df.where("chunk_id < 1200"))
    assert grown.rows.count() == grown.meta.count == 1200 and grown.rows.select("chunk_id").distinct().count() == 1200
    assert capacity(1000) == 2024 and grown.add(df.selectExpr("chunk_id + 5000 as chunk_id", "vector")) is None
    again = IvfIndex.build(df.where("chunk_id < 900"), path=f"file://{tmp_path}/i")
    assert again.rows.count() == 900
    assert len(list((tmp_path / "i" / again.meta.parts[-1]).glob("list_no=*/*.parquet"))) == again.rows.select("list_no").distinct().count()


@pytest.mark.parametrize(("name", "want"), [(".env", ""), (".env.local", ".local"), (".23.html", ".html"), ("a.", "."), ("..", ""), ("x.PY", ".py"), ("d.e/f", ""), ("..a", ".a"), ("a.b/", ".b")])
def test_extension(spark, name, want):
    assert spark.createDataFrame([(name,)], "p string").select(paths.extension("p").alias("e")).first()["e"] == want


def test_workspace_with_a_model(spark, tmp_path):
    root = tmp_path / "proj"
    root.mkdir()
    for i in range(30):
        (root / f"m{i}.py").write_text("\n".join(f"def f{i}_{j}(a, b):\n    return a * {j} + b * {i}  # a line of some length here" for j in range(60)))
    (root / "bad.py").write_text("def poison(): return 'a text that the model does not take'")
    (root / "huge.py").write_text("x = 1\n" * 300_000)

    def make():
        one = embedding.HashingEmbedder()

        def model(texts):
            if any("poison" in t for t in texts):
                raise RuntimeError("refused")
            return [one(t) for t in texts]

        return model

    w = Workspace(spark, str(root), f"file://{tmp_path}/cache", make_model=make)
    report = w.index()
    ids = [r["chunk_id"] for r in w.chunks().select("chunk_id").collect()]
    assert report.chunks == len(ids) == len(set(ids)) and len(ids) >= 60 and sorted(ids) == list(range(min(ids), min(ids) + len(ids)))
    assert w.chunks().where("file like '%bad.py' or file like '%huge.py'").count() == 0
    assert {(os.path.basename(e["scope"]), e["stage"], e["message"]) for e in w.errors} == {("bad.py", "embed", "refused"), ("huge.py", "read", "too_large")}
    assert w.index().processed == 2  # both are tried again


def test_a_store_read_by_ranges(tmp_path):
    rows = [{"file": f"f{i % 3}", "start_line": i, "end_line": i + 2, "content": f"é {i}" * i, "vector": [i / 8, 0.5]} for i in range(40)]
    for name, raw in stores.pack_binary_store(rows, 9).items():
        (tmp_path / name).write_bytes(raw)
    held = stores.BinaryStoreFile(str(tmp_path))
    held.verify()
    for i in (0, 7, 39):
        r = held.record(i)
        assert (r["file"], r["start_line"], held.content(i), held.vector(i)) == (rows[i]["file"], i, rows[i]["content"], rows[i]["vector"])
    assert held.record(40) is held.vector(-1) is held.content(10**9) is None
    raw = (tmp_path / "content.bin").read_bytes()
    (tmp_path / "content.bin").write_bytes(raw[:-1] + b"?")
    with pytest.raises(stores.StoreCorrupt):
        held.verify()
    (tmp_path / "content.bin").write_bytes(stores.pack_binary_store(rows, 8)["content.bin"])
    with pytest.raises(stores.StoreCorrupt):
        stores.BinaryStoreFile(str(tmp_path))


def test_a_text_that_fails_once_is_tried_again(spark):
    def make():
        seen = set()

        def model(texts):
            for t in texts:
                if t.startswith("slow") and t not in seen:
                    seen.add(t)
                    raise RuntimeError("busy")
                if t == "bad":
                    raise RuntimeError("never")
            return [[1.0] for _ in texts]

        return model

    texts = spark.createDataFrame([("slow1",), ("slow2",), ("bad",), ("ok",)], "text string").coalesce(1)
    done = {r["text"]: r["embedding"]["success"] for r in embedding.embed_with_status(texts, make, retries=2, wait_s=0.01).collect()}
    assert done == {"slow1": True, "slow2": True, "bad": False, "ok": True}


def test_progress_is_told(spark, tmp_path):
    import time

    told = []
    listener = watch.ProgressListener(told.append)
    spark.streams.addListener(listener)
    try:
        spark.range(7).select(F.col("id").cast("string").alias("path"), F.lit("add").alias("event_type"), F.timestamp_seconds("id").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/log")
        q = watch.read_events(spark, f"{tmp_path}/log").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(60)
        for _ in range(100):
            if any(t["phase"] == "ended" for t in told):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [t["phase"] for t in told][0] == "started" and sum(t.get("rows", 0) for t in told) == 7 and told[-1]["phase"] == "ended"
    assert sum(p["rows"] for p in watch.progress_events(q)) == 7

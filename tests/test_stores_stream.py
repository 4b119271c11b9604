"""Stores, file sources, incremental indexing, retention and the watcher."""

import datetime
import zlib

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import indexing, retention
from corpusforge.operators.chunking import chunk_files
from corpusforge.plans.queries import QUERIES
from corpusforge.sources import files, stores
from corpusforge.streaming import watch

NOW = 1_700_000_000_000
CHUNKS = [{"file": f"f{i % 8}", "start_line": i, "end_line": i + 1, "content": f"text é {i}", "vector": [i / 100, i / 200, i / 300]} for i in range(512)]


def frame(spark, rows):
    return spark.createDataFrame([(i, c["file"], c["start_line"], c["end_line"], c["content"], c["vector"]) for i, c in enumerate(rows)], stores.CHUNK_SCHEMA)


def test_versioned_store(spark, tmp_path):
    store = stores.VersionedStore(spark, f"file://{tmp_path}/s")
    assert store.current() is None and store.load("hashing") is None
    store.save(stores.StoreMeta(dimension=3, chunks_stored=512), chunks=frame(spark, CHUNKS), file_hashes=spark.createDataFrame([("f0", "h", 1.0, 2)], stores.FILE_HASH_SCHEMA))
    assert store.load("hashing", 3).count() == 512 and store.load("other") is None and store.load("hashing", 4) is None
    store.save(stores.StoreMeta(dimension=3), chunks=store.read("chunks").where("file <> 'f0'"))
    assert store.read("chunks").count() == 448 and store.read("file_hashes").count() == 1
    store.rollback()
    assert store.read("chunks").count() == 512
    store.vacuum()
    assert store.read("chunks").count() == 512
    store.clear()
    assert store.current() is None


def test_json_store(spark, tmp_path):
    stores.write_json_store(frame(spark, CHUNKS[:20]), f"file://{tmp_path}/j")
    back = stores.read_json_store(spark, f"file://{tmp_path}/j")
    assert sorted(r["content"] for r in back.collect()) == sorted(c["content"] for c in CHUNKS[:20])


def test_binary_store(spark, tmp_path):
    packed = stores.pack_binary_store(CHUNKS, 7)
    for name, raw in packed.items():
        (tmp_path / "b").mkdir(exist_ok=True)
        (tmp_path / "b" / name).write_bytes(raw)
    back = stores.read_binary_stores(spark, f"file://{tmp_path}/b")
    assert back.count() == 512 and back.where("chunk_id = 5").first()["content"] == "text é 5"
    for name in ("vectors.bin", "records.bin", "content.bin"):
        bad = dict(packed)
        bad[name] = bad[name][:-1] + bytes([bad[name][-1] ^ 1])
        with pytest.raises(stores.StoreCorrupt):
            stores.unpack_binary_store(bad)
    mixed = packed | {"content.bin": stores.pack_binary_store(CHUNKS, 8)["content.bin"]}
    with pytest.raises(stores.StoreCorrupt):
        stores.unpack_binary_store(mixed)
    with pytest.raises(ValueError):
        stores.pack_binary_store([{"file": "a", "start_line": 1, "end_line": 1, "content": "", "vector": [1.0]}, {"file": "a", "start_line": 1, "end_line": 1, "content": "", "vector": []}], 1)


def test_sqlite_store(spark, tmp_path):
    (tmp_path / "x.sqlite").write_bytes(stores.pack_sqlite_store(CHUNKS[:9]))
    assert stores.read_sqlite_stores(spark, f"file://{tmp_path}").count() == 9


def test_files(spark, tmp_path):
    for name, body in {"a.py": "def f(): pass\n" * 5, "sub/b.js": "x", "node_modules/c.js": "y", "big.py": "z" * 200, "Makefile": "all:", "n.bin": "q"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(body)
    found = files.discover(spark, str(tmp_path), ["py", ".js"], ["Makefile"], ["sub/**"])
    read = {r["relative"]: r for r in files.read_texts(found, 100).collect()}
    assert set(read) == {"a.py", "big.py", "Makefile"}
    assert read["big.py"]["status"] == "too_large" and read["big.py"]["content"] is None and read["a.py"]["status"] == ""
    listed = files.list_resources(files.scan(spark, str(tmp_path)), ["py"])
    assert [r["name"] for r in listed.collect()] == ["a.py", "big.py"]
    assert files.read_resource(spark, str(tmp_path), listed.first()["uri"]).first()["text"].startswith("def f")
    with pytest.raises(ValueError):
        files.read_resource(spark, str(tmp_path), f"file://{tmp_path}/../x")
    made = chunk_files(files.read_texts(found, 100).where("status = ''").select("file", "content"))
    assert made.where(F.col("file").endswith("a.py")).count() == 1


def test_revisit_new_forgotten_and_edited(spark):
    found = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0)], "file string, size long, mtime_ms double")
    known = spark.createDataFrame([("a", "ha", 1.0, 1), ("b", "hb", 2.0, 2)], "file string, hash string, mtime_ms double, size long")
    todo = lambda f, k: sorted(r["file"] for r in indexing.detect_changes(f, k, NOW).where("not unchanged").collect())
    assert todo(found, known) == []
    assert todo(found.union(spark.createDataFrame([("c", 3, 3.0)], found.schema)), known) == ["c"]
    assert todo(found, known.where("file = 'a'")) == ["b"]
    assert todo(found.withColumn("size", F.col("size") + 1).where("file = 'a'"), known) == ["a"]
    fresh = spark.createDataFrame([("a", 1, float(NOW))], found.schema)
    assert todo(fresh, known.where("file = 'a'").withColumn("mtime_ms", F.lit(float(NOW)))) == ["a"]
    assert indexing.index_mode(False, 5, 1, 3, 1) == indexing.IndexMode("incremental", "resume-partial")
    assert indexing.index_mode(False, 0, 3, 3, 3).mode == "initial" and indexing.index_mode(True, 5, 3, 3, 0).mode == "full"


def facts(spark, **change):
    base = dict(cache_id="c", workspace="/home/w", workspace_exists=True, model="m", dimension=64, files_indexed=50, chunks_stored=500, has_meta=True, is_active=False, last_activity_ms=NOW - 48 * 3_600_000, dir_mtime_ms=NOW - 48 * 3_600_000, progress_ms=None) | change
    kinds = "cache_id string, workspace string, workspace_exists boolean, model string, dimension int, files_indexed int, chunks_stored int, has_meta boolean, is_active boolean, last_activity_ms long, dir_mtime_ms long, progress_ms long"
    return spark.createDataFrame([tuple(base.values())], kinds)


@pytest.mark.parametrize(
    ("change", "action", "reason"),
    [
        ({}, "KEEP", "valid_cache"),
        ({"is_active": True, "files_indexed": 0}, "KEEP", "active_lock"),
        ({"files_indexed": 0, "last_activity_ms": NOW - 25 * 3_600_000}, "REMOVE", "empty_cache"),
        ({"workspace": "/tmp/x", "last_activity_ms": NOW - 25 * 3_600_000}, "REMOVE", "temp_workspace"),
        ({"last_activity_ms": NOW}, "KEEP", "recent_activity"),
        ({"workspace": "C:\\Program Files\\x", "last_activity_ms": NOW}, "REMOVE", "system_workspace_cache"),
        ({"has_meta": False}, "REMOVE", "no_meta_stale"),
        ({"workspace_exists": False}, "KEEP", "workspace_grace_period"),
        ({"progress_ms": NOW - 7 * 3_600_000}, "REMOVE", "stuck_indexing"),
        ({"last_activity_ms": NOW - 31 * 86_400_000}, "REMOVE", "long_unused"),
    ],
)
def test_retention(spark, change, action, reason):
    r = retention.retention(facts(spark, **change), NOW).first()
    assert (r["action"], r["reason"]) == (action, reason)


def test_attach(spark):
    c = spark.createDataFrame([("/w/a", "meta", 1), ("/w/a", "lock:1", 5), ("/w/b", "meta", 2)], "workspace string, source string, rank long")
    assert retention.attach_candidate(c).count() == 0
    assert retention.attach_candidate(c, "/w/b").first()["workspace"] == "/w/b"
    assert retention.attach_candidate(c.where("workspace = '/w/a'")).first()["rank"] == 5


def test_attach_query_asks_all_workspaces(spark, sf, monkeypatch):
    asked, operator = [], retention.attach_candidate
    monkeypatch.setattr(retention, "attach_candidate", lambda c, *preferred: asked.append(c) or operator(c, *preferred))
    assert QUERIES["attach_candidate"](spark, sf).count() == 1
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    assert asked[0].count() == orders.count() and asked[0].select("workspace").distinct().count() == orders.select("o_custkey").distinct().count() > 1


def test_watcher(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    events = [("a", "add", at(0)), ("a", "change", at(1)), ("b", "add", at(2)), ("b", "unlink", at(3)), ("c", "unlink", at(4))]
    spark.createDataFrame(events, watch.EVENT_SCHEMA).write.parquet(f"{tmp_path}/log")
    state = {"t": spark.createDataFrame([("b", 1), ("c", 1), ("d", 1)], "file string, v int")}

    def save(df):
        path = f"{tmp_path}/out{len(list(tmp_path.iterdir()))}"
        df.write.parquet(path)
        state["t"] = spark.read.parquet(path)

    q = watch.run_watcher(watch.read_events(spark, f"{tmp_path}/log"), lambda: state["t"], save, lambda f: f.select("file", F.lit(2).alias("v")), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert {(r["file"], r["v"]) for r in state["t"].collect()} == {("a", 2), ("d", 1)}


def test_debounce_stream_equals_batch(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    ms = lambda n: base + datetime.timedelta(milliseconds=n)
    rows = [("a", "add", ms(0)), ("a", "change", ms(200)), ("a", "change", ms(900)), ("b", "unlink", ms(100)), ("z", "add", ms(3_600_000))]
    spark.createDataFrame(rows, watch.EVENT_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/log")
    want = {(r["path"], r["event_type"], r["n_events"]) for r in watch.debounce(spark.read.parquet(f"{tmp_path}/log")).collect()}
    assert ("a", "change", 2) in want and ("a", "change", 1) in want
    q = watch.debounce(watch.read_events(spark, f"{tmp_path}/log"), late="1 second").writeStream.format("memory").queryName("debounced").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["path"], r["event_type"], r["n_events"]) for r in spark.sql("select * from debounced").collect()}
    assert got == {w for w in want if w[0] != "z"} or got == want


def test_percentile_matches_rule(spark):
    v = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 5.0)] * 7 + [(None, 1.0), ("c", None)], "g string, v double")
    got = {r["g"]: r["p"] for r in indexing.nearest_rank(v, "g", "v", 95, "p").collect()}
    assert got == {"a": 9.0, "b": 5.0, None: 1.0}
    assert {r["g"]: r["p"] for r in indexing.nearest_rank(v, "g", "v", 50, "p").collect()} == {"a": 5.0, "b": 5.0, None: 1.0}


def test_crc(spark):
    assert spark.sql("select crc32(cast('abc' as binary)) as c").first()["c"] == zlib.crc32(b"abc")

"""A stream of events applied to a layered store, batch by batch."""

from pyspark.sql import functions as F

from corpusforge.sources import stores
from corpusforge.streaming.watch import EVENT_SCHEMA, watch_store


def test_batches_are_layers_and_a_restart_goes_on(spark, tmp_path):
    store, log = stores.VersionedStore(spark, f"file://{tmp_path}/store"), f"file://{tmp_path}/log"

    def happen(*events):
        spark.createDataFrame([(p, e, t) for p, e, t in events], "path string, event_type string, t long").select("path", "event_type", F.timestamp_millis("t").alias("ts")).coalesce(1).write.mode("append").parquet(log)

    looked = []

    def index(files):
        looked.append(sorted(r["file"] for r in files.collect()))
        body = files.where("file <> 'empty'").select("file", F.explode(F.array(F.lit(1), F.lit(5))).alias("start_line"))
        return body.select("file", "start_line", (F.col("start_line") + 3).alias("end_line"), F.lit(f"run {len(looked)}").alias("content"), F.lit(None).cast("array<float>").alias("vector"))

    def run():
        stream = spark.readStream.schema(EVENT_SCHEMA).parquet(log)
        watch_store(stream, store, index, f"file://{tmp_path}/checkpoint").awaitTermination(300)

    happen(("a", "add", 1), ("b", "add", 2), ("a", "change", 3), ("empty", "add", 4))
    run()
    assert looked == [["a", "b", "empty"]] and store.meta().chunks_stored == 4
    happen(("b", "change", 10), ("a", "unlink", 11), ("c", "add", 12), ("c", "unlink", 13))
    run()
    run()
    assert looked[1:] == [["b"]]
    rows = sorted((r["file"], r["start_line"], r["content"]) for r in store.read("chunks").collect())
    assert rows == [("b", 1, "run 2"), ("b", 5, "run 2")]
    assert store.meta().chunks_stored == 2 and len({r["chunk_id"] for r in store.read("chunks").collect()}) == 2
    assert sorted(r["file"] for r in store.read("file_hashes").collect()) == ["b", "empty"]
    assert len(store.meta().layers) == 2

"""Watch events as a stream: debounce, coalesce, apply to a chunk table.

Events are rows ``(path, event_type, ts)`` with event_type add, change or unlink, read from
any streaming source.  A path's events closer than the gap are one session, and its last
event counts; ``foreachBatch`` then replaces the rows of the files in a batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.indexing import coalesce_events, dense_index, replace_by_file
from ..sources.shared import Scratch, owning
from ..sources.stores import StoreMeta, VersionedStore

#: Milliseconds of silence after which a path's last event is passed on; and for writes.
DEBOUNCE, STABILITY = 300, 1500
EVENT_SCHEMA = "path string, event_type string, ts timestamp"


def read_events(spark, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Event log of Parquet files as a stream; back pressure by files a trigger."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def debounce(events: DataFrame, gap: str = f"{DEBOUNCE} milliseconds", late: str = "10 minutes") -> DataFrame:
    """One row per path and session: path, first_ts, last_ts, event_type (the last), n_events.

    Of events at one time the last is that with the greatest ``seq``, if there is such a
    column, else the greatest type.  Works on batch and stream; a stream keeps a session's
    state until the watermark passes.
    """
    source = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = source.groupBy(F.session_window("ts", gap), "path")
    order = F.struct("ts", "seq" if "seq" in events.columns else "event_type")
    out = grouped.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("event_type", order).alias("event_type"), F.count("*").alias("n_events"))
    return out.drop("session_window")


def settled(seen: DataFrame, as_of_ms: int, stability: int = STABILITY) -> DataFrame:
    """Files that are no longer being written: (path, size, mtime_ms, stable_ms).

    ``seen(path, size, mtime_ms, seen_ms)`` are looks at files.  A file is settled if size
    and time are those of its last look for ``stability`` ms up to ``as_of_ms`` or more.
    """
    by = Window.partitionBy("path").orderBy("seen_ms")
    changed = F.lag("seen_ms").over(by).isNull() | ~F.lag("size").over(by).eqNullSafe(F.col("size")) | ~F.lag("mtime_ms").over(by).eqNullSafe(F.col("mtime_ms"))
    looks = seen.where(F.col("seen_ms") <= as_of_ms).withColumn("since", F.when(changed, F.col("seen_ms")))
    last = looks.groupBy("path").agg(F.max_by("size", "seen_ms").alias("size"), F.max_by("mtime_ms", "seen_ms").alias("mtime_ms"), F.max("since").alias("since"))
    return last.withColumn("stable_ms", F.lit(as_of_ms) - F.col("since")).where(F.col("stable_ms") >= stability).drop("since")


def apply_batch(chunks: DataFrame, events: DataFrame, index: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Chunk table after a batch: unlinked files lose their rows, others are indexed anew.

    ``index`` makes chunks of ``(file)`` rows.
    """
    tie = "seq" if "seq" in events.columns else "event_type"
    last = coalesce_events(events.withColumn("seq", F.struct("ts", tie)))
    touched = last.select(F.col("path").alias("file"), "event_type")
    return replace_by_file(chunks, touched, index(touched.where("event_type <> 'unlink'").select("file")))


def run_watcher(events: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame], None], index: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Start the stream that applies each micro-batch and saves; returns the query.

    Batches run one after the other, so a path is never indexed twice at once; what arrives
    meanwhile waits in the source.  Restarting from the checkpoint resumes after the last
    saved batch; saving a batch again gives the same table.
    """

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            save(apply_batch(load(), batch, index))

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_store(events: DataFrame, store: VersionedStore, index: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Start the stream that applies each micro-batch to a store as a layer; returns the query.

    ``index`` makes (file, start_line, end_line, content, vector) of ``(file)`` rows.  A batch
    writes the chunks of its files and the names of what they replace, nothing else.  Their hash
    rows have no hash, so the next index run looks at these files again.  A batch that is applied
    again after a crash replaces its own rows.
    """

    def step(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        tie = "seq" if "seq" in batch.columns else "event_type"
        with owning(batch.sparkSession), Scratch(batch.sparkSession) as scope:
            touched = scope.write(coalesce_events(batch.withColumn("seq", F.struct("ts", tie))).select(F.col("path").alias("file"), "event_type"), "touched")
            alive = touched.where("event_type <> 'unlink'").select("file")
            made = scope.write(index(alive), "made")
            meta = store.meta() or StoreMeta()
            numbered = dense_index(made.withColumn("_key", F.struct("file", "start_line", "end_line")), "_key", "_n")
            counts = made.groupBy("file").agg(F.count("*").alias("chunks"))
            store.apply(
                replace(meta),
                touched.select("file"),
                chunks=numbered.select((F.col("_n") + meta.next_chunk_id).alias("chunk_id"), "file", "start_line", "end_line", "content", "vector"),
                file_hashes=alive.join(counts, "file", "left").select("file", F.lit(None).cast("string").alias("hash"), F.lit(None).cast("double").alias("mtime_ms"), F.lit(None).cast("long").alias("size"), F.coalesce("chunks", F.lit(0)).alias("chunks")),
            )

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_events(query) -> list[dict]:
    """Rows and times of the query's recent batches."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "ts": p["timestamp"], "ms": p["durationMs"].get("triggerExecution", 0)} for p in (x if isinstance(x, dict) else json.loads(x.json) for x in query.recentProgress)]


class ProgressListener(StreamingQueryListener):
    """Passes each batch and the end of a query on to ``tell`` as a dictionary.

    Register it with ``spark.streams.addListener``; it sees every query of the session.
    """

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell({"phase": "started", "run": str(event.runId)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"phase": "batch", "run": str(p.runId), "batch": p.batchId, "rows": p.numInputRows, "ms": p.durationMs.get("triggerExecution", 0)})

    def onQueryIdle(self, event) -> None:
        self.tell({"phase": "idle", "run": str(event.runId)})

    def onQueryTerminated(self, event) -> None:
        self.tell({"phase": "failed" if event.exception else "ended", "run": str(event.runId), "error": event.exception})

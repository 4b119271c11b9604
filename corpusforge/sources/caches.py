"""Facts about stored indexes: one row for each folder below a cache root.

A cache folder holds ``meta.json``, ``progress.json`` and ``server.lock.json`` beside its
data files; all of them may be missing or broken.  The rows are what ``retention.decide``
takes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retention import activity
from .files import open_path
from .shared import Scratch

#: Names of the files of a cache folder.
META, PROGRESS, LOCK = "meta.json", "progress.json", "server.lock.json"
VECTOR_FILES = ["vectors.bin", "vectors.sqlite", "embeddings.json"]
ANN_FILE = "ann-index.bin"
#: Folders that a task looks into.
FOLDERS_A_TASK = 2000
_META = "workspace string, lastSaveTime string, embeddingModel string, embeddingDimension int, filesIndexed long, chunksStored long"


def is_running(pid: int) -> bool:
    """Whether a process of this machine has the number; one of another user has it too."""
    try:
        os.kill(pid, 0)
    except PermissionError:
        return True
    except (OSError, OverflowError):
        return False
    return True


def _exists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            try:
                fs, name = open_path(path)
                found.append(fs.get_file_info(name).type != pafs.FileType.NotFound)
            except (OSError, ValueError):
                found.append(False)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.bool_())], names=["workspace", "workspace_exists"])


def _folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the folders directly below each root."""
    for batch in batches:
        for root in batch.column(0).to_pylist():
            fs, base = open_path(root)
            if isinstance(fs, pafs.LocalFileSystem):
                with os.scandir(base) as found:
                    names = [e.name for e in found if e.is_dir()]
            else:
                names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(base)) if i.type == pafs.FileType.Directory]
            for at in range(0, len(names), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 10_000], pa.string())], names=["cache_id"])


_TIMES = [PROGRESS, *VECTOR_FILES, ANN_FILE]
_FACTS = pa.schema([("cache_id", pa.string()), ("dir_mtime", pa.float64()), *((c, pa.string()) for c in ("meta", "progress", "lock")), ("progress_file", pa.int64()), *((f"_{i}", pa.int64()) for i in range(len(_TIMES) - 1))])


def _text(fs: pafs.FileSystem, path: str) -> str | None:
    try:
        with fs.open_input_stream(path, compression=None) as source:
            return source.read().decode()
    except (OSError, UnicodeDecodeError):
        return None


def _read_facts(root: str):
    """Folder names to what their files say: three texts, and times in ms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_path(root)
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                folder = f"{base}/{name}"
                info = fs.get_file_info(folder)
                if info.type == pafs.FileType.NotFound:  # it went meanwhile
                    continue
                try:
                    held = {i.base_name: i for i in fs.get_file_info(pafs.FileSelector(folder)) if i.type == pafs.FileType.File}
                except OSError:
                    held = {}
                ms = lambda i: None if i is None or i.mtime_ns is None else i.mtime_ns // 1_000_000
                bodies = [_text(fs, f"{folder}/{n}") if n in held else None for n in (META, PROGRESS, LOCK)]
                rows.append((name, float(ms(info) or 0), *bodies, *(ms(held.get(n)) for n in _TIMES)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FACTS, strict=True)], schema=_FACTS)

    return run


def scan_caches(spark: SparkSession, root: str, alive: Callable[[int], bool] = is_running) -> DataFrame:
    """Rows of facts, one a folder directly below ``root``.

    Last activity is the latest of save time, progress, lock start and the times of the
    vector and index files; without any of them that of the folder.  A lock counts if
    ``alive`` says so of its process.  A JSON file that can't be read counts as missing.

    One task lists the names, which are dealt out; each task looks into its own folders.  The
    facts are a stored table that belongs to the caller.
    """
    top = re.sub("^file:/+", "/", root.rstrip("/"))
    with Scratch(spark) as names:
        listed = names.write(spark.createDataFrame([(top,)], "root string").mapInArrow(_folders, "cache_id string"), "cache_names")
        dealt = listed.repartition(max(1, -(-listed.count() // FOLDERS_A_TASK)))
        kinds = "cache_id string, dir_mtime double, meta string, progress string, lock string, progress_file long, " + ", ".join(f"_{i} long" for i in range(len(_TIMES) - 1))
        facts = Scratch(spark).write(dealt.mapInArrow(_read_facts(top), kinds), "caches", keep=True)
    read = lambda c, schema: F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))
    facts = facts.select(
        "cache_id", "dir_mtime", read("meta", _META).alias("m"), read("progress", "updatedAt string").alias("p"), read("lock", "pid long, startedAt string").alias("l"), "progress_file", F.coalesce("_0", "_1", "_2").alias("vectors"), F.col("_3").alias("index")
    )
    time = lambda c: F.unix_millis(F.try_to_timestamp(c))
    progressed = F.when(F.col("p").isNotNull(), F.coalesce(time(F.col("p.updatedAt")), F.col("progress_file")))
    pids = facts.select("l.pid").where("pid is not null").distinct().toArrow()["pid"].to_pylist()  # as many as a machine has numbers
    running = spark.createDataFrame(pa.table({"pid": pa.array([p for p in pids if alive(p)], pa.int64())})).withColumn("_runs", F.lit(True))
    known = facts.select(F.col("m.workspace").alias("workspace")).where("workspace is not null").distinct().mapInArrow(_exists, "workspace string, workspace_exists boolean")
    out = facts.join(running, F.col("l.pid") == F.col("pid"), "left").select(
        "cache_id", F.col("m.workspace").alias("workspace"), F.col("m.embeddingModel").alias("model"), F.col("m.embeddingDimension").alias("dimension"), F.col("m.filesIndexed").alias("files_indexed"), F.col("m.chunksStored").alias("chunks_stored"),
        F.col("m").isNotNull().alias("has_meta"), F.coalesce("_runs", F.lit(False)).alias("is_active"),
        activity(time(F.col("m.lastSaveTime")), progressed, time(F.col("l.startedAt")), F.col("vectors"), F.col("index"), fallback=F.col("dir_mtime").cast("long")).alias("last_activity_ms"),
        F.col("dir_mtime").cast("long").alias("dir_mtime_ms"), progressed.alias("progress_ms"),
    )
    return out.join(known, "workspace", "left").withColumn("workspace_exists", F.coalesce("workspace_exists", F.lit(False)))

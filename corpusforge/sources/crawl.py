"""Listing of a folder tree by the tasks, whatever its files are called.

A round lists the folders of its frontier: each task goes down from its folders until it has
seen ENTRIES of them, and hands the folders it has not entered to the next round, which deals
them out anew.  A small tree takes one round; a deep or wide one is shared by all tasks.
Folders that can hold nothing wanted are never entered.  Between rounds only a count reaches
the driver.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from .shared import Scratch

#: Entries after which a task passes the rest of a folder's tree on; folders of one task.
ENTRIES, FOLDERS_A_TASK = 20_000, 64

_SCHEMA = "kind string, file string, relative string, size long, mtime_ms double"
_FIELDS = pa.schema([("kind", pa.string()), ("file", pa.string()), ("relative", pa.string()), ("size", pa.int64()), ("mtime_ms", pa.float64())])


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and name of a path or URI."""
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (pafs.LocalFileSystem(), path)


def folder_rules(exclude: list[str], ignore_lines: list[str]) -> list[re.Pattern]:
    """Patterns of relative folder paths of which every file is excluded.

    A pattern that ends in ``/**`` excludes all below what is before it.  Rules of an ignore
    file count only if none of them is negated, as that could take a file back.
    """
    out = [P.glob_to_regex(x.removesuffix("/**")) for x in exclude if x.endswith("/**") and x != "/**"]
    rules = [x.strip() for x in ignore_lines if x.strip() and not x.startswith("#")]
    if not any(x.startswith("!") for x in rules):
        for rule in rules:
            name = rule.rstrip("/")
            deep = "/" in name
            out.append(("^" if deep else "^(?:.*/)?") + P.glob_to_regex(name.lstrip("/"))[1:])
    return [re.compile(x) for x in out]


def _entries(fs: pafs.FileSystem, name: str) -> Iterator[tuple[str, bool, int | None, float | None]]:
    """(name, is folder, size, mtime_ms) of a folder's entries; none if it can't be read.

    Links to folders are left out, as they may lead back; links to files are files.
    """
    if isinstance(fs, pafs.LocalFileSystem):
        try:
            with os.scandir(name) as found:
                for entry in found:
                    try:
                        if entry.is_dir(follow_symlinks=False):
                            yield entry.name, True, None, None
                        elif entry.is_file():
                            stat = entry.stat()
                            yield entry.name, False, stat.st_size, stat.st_mtime_ns // 1_000_000 * 1.0
                    except OSError:  # it went meanwhile
                        continue
        except OSError:
            return
        return
    try:
        found = fs.get_file_info(pafs.FileSelector(name))
    except OSError:
        return
    for info in found:
        if info.type in (pafs.FileType.Directory, pafs.FileType.File):
            folder = info.type == pafs.FileType.Directory
            yield info.base_name, folder, None if folder else info.size, None if folder or info.mtime_ns is None else info.mtime_ns // 1_000_000 * 1.0


def _lister(root: str, shown: str, pruned: frozenset[str], rules: list[re.Pattern], budget: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_path(root)
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)
            rows.clear()
            return made

        for batch in batches:
            for start in batch.column(0).to_pylist():
                waiting, seen = [start], 0
                while waiting and seen < budget:
                    folder = waiting.pop()
                    for name, is_folder, size, mtime in _entries(fs, f"{base}/{folder}".rstrip("/") or "/"):
                        relative = f"{folder}/{name}" if folder else name
                        seen += 1
                        if not is_folder:
                            rows.append(("file", f"{shown}/{relative}", relative, size, mtime))
                        elif name not in pruned and not any(r.match(relative) for r in rules):
                            waiting.append(relative)
                        if len(rows) >= 10_000:
                            yield flush()
                rows.extend(("folder", None, folder, None, None) for folder in waiting)
        if rows:
            yield flush()

    return walk


def crawl(spark: SparkSession, root: str, exclude: list[str] = (), ignore_lines: list[str] = (), pruned: tuple[str, ...] = P.PRUNED_DIRECTORIES, budget: int = ENTRIES) -> DataFrame:
    """(file, relative, size, mtime_ms) of all files below ``root``, names beginning with ``_``
    or ``.`` among them.

    Folders named in ``pruned``, or that ``exclude`` or ``ignore_lines`` exclude as a whole,
    are not entered; single files aren't filtered here.  A folder that is missing or can't be
    read has no files.  The listing is a stored table that belongs to the caller.
    """
    top = root.rstrip("/")
    shown = re.sub("^file:/+", "/", top)
    lister = _lister(top if "://" in top and not top.startswith("file:") else shown, shown, frozenset(pruned), folder_rules(list(exclude), list(ignore_lines)), budget)
    scope = Scratch(spark)
    folder, number = scope.path("crawl", keep=True), 0
    frontier = spark.createDataFrame([("",)], "relative string")
    while True:
        path = f"{folder}/round={number}"
        # A large folder's names come from one task; stored in many files, they are looked through by all.
        frontier.mapInArrow(lister, _SCHEMA).repartition(max(frontier.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)).write.parquet(path)
        left = spark.read.schema(_SCHEMA).parquet(path).where("kind = 'folder'").select("relative")
        n = left.count()
        if n == 0:
            break
        frontier, number = left.repartition(max(1, min(-(-n // FOLDERS_A_TASK), 100 * spark.sparkContext.defaultParallelism), min(n, spark.sparkContext.defaultParallelism))), number + 1
    return spark.read.schema(_SCHEMA).option("recursiveFileLookup", True).parquet(folder).where("kind = 'file'").drop("kind")

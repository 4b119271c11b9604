"""Files of a workspace as DataFrames: discovery, guarded reading, resources, logs."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from .crawl import crawl, open_path

MAX_FILE_SIZE = 1 << 20
#: Resources listed at most, and folders below the root.
MAX_RESOURCES, MAX_DEPTH = 500, 10


def _plain(path: Column) -> Column:
    """Path without the scheme that Hadoop puts before it."""
    return F.regexp_replace(path, "^file:/+", "/")


def scan(spark: SparkSession, root: str, exclude: list[str] = (), ignore_lines: list[str] = ()) -> DataFrame:
    """(file, relative, size, mtime_ms) of the files below ``root``; see ``crawl``."""
    return crawl(spark, root, exclude, ignore_lines)


def ignore_file(root: str, name: str = ".gitignore") -> list[str]:
    """Lines of the root's ignore file; none if there is no such file."""
    try:
        fs, path = open_path(root.rstrip("/").removeprefix("file://") if root.startswith("file:") else root.rstrip("/"))
        with fs.open_input_stream(f"{path}/{name}", compression=None) as source:
            return source.read(MAX_FILE_SIZE).decode("utf-8", "replace").splitlines()
    except OSError:
        return []


def discover(spark: SparkSession, root: str, extensions: list[str], names: list[str] = (), exclude: list[str] = (), ignore_lines: list[str] = ()) -> DataFrame:
    """Files with a listed extension or name that nothing excludes."""
    found = scan(spark, root, exclude, ignore_lines)
    keep = P.allowed_file("relative", list(extensions), list(names)) & ~P.in_pruned_directory("relative")
    if exclude:
        keep = keep & ~P.exclude_predicate("relative", list(exclude))
    if ignore_lines:
        keep = keep & ~P.gitignore_predicate("relative", list(ignore_lines))
    return found.where(keep)


def read_texts(files: DataFrame, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """``files(file, relative, ...)`` with status, content as text and its md5."""
    return files.select("file", "relative").join(read_files(files, max_size), "file")


def _read_one(path: str, max_size: int) -> tuple[str, int | None, float | None, bytes | None]:
    """(status, size, mtime_ms, content) of a file, content only if the status is ''."""
    try:
        fs, name = open_path(path)
        info = fs.get_file_info(name)
    except (OSError, ValueError):
        return "stat_failed", None, None, None
    if info.type == pafs.FileType.NotFound:
        return "stat_failed", None, None, None
    mtime = None if info.mtime_ns is None else info.mtime_ns // 1_000_000 * 1.0
    if info.type == pafs.FileType.Directory:
        return "is_directory", None, mtime, None
    if info.size > max_size:
        return "too_large", info.size, mtime, None
    try:
        with fs.open_input_stream(name, compression=None) as source:
            body = source.read(max_size + 1)
    except OSError:
        return "read_failed", info.size, mtime, None
    if len(body) > max_size:  # it grew since
        return "too_large_after_read", len(body), mtime, None
    return "", len(body), mtime, body


#: Bytes of files that a task holds before it hands them on, about.
PIECE_BYTES = 1 << 20


def read_files(listed: DataFrame, max_size: int = MAX_FILE_SIZE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``listed(file)`` to (file, status, size, mtime_ms, content, content_hash), and its columns ``keep``.

    Each task reads its own files, never more than ``max_size`` bytes and one of each, and hands
    them on in pieces.  A file that is missing, a directory, too large or unreadable keeps its row,
    with the reason as its status and no content; text that is no UTF-8 has replacement characters.
    """
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.string(), pa.string()]
    names = ["file", "status", "size", "mtime_ms", "content", "content_hash", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, start = [], 0, 0
            paths = batch.column(0).to_pylist()
            for at, path in enumerate(paths, 1):
                status, size, mtime, body = _read_one(path, max_size)
                text = None if body is None else body.decode("utf-8", "replace")
                rows.append((status, size, mtime, text, None if body is None else hashlib.md5(body).hexdigest()))
                held += len(body or b"")
                if held >= PIECE_BYTES or at == len(paths):
                    read = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                    given = batch.slice(start, at - start).columns
                    yield pa.RecordBatch.from_arrays([given[0], *read, *given[1:]], names=names)
                    rows, held, start = [], 0, at

    shape = T.StructType.fromDDL("file string, status string, size long, mtime_ms double, content string, content_hash string")
    for name in keep:
        shape = shape.add(listed.schema[name])
    return listed.select("file", *keep).where("file is not null").mapInArrow(run, shape)


def real_paths(rows: DataFrame, path: str = "file", name: str = "real") -> DataFrame:
    """``rows`` with the path that links lead to, as the machine that runs the task sees it."""
    @F.pandas_udf("string")
    def resolve(values: pd.Series) -> pd.Series:
        return values.map(lambda p: None if p is None else os.path.realpath(re.sub("^file:/+", "/", p)))

    return rows.withColumn(name, resolve(F.col(path)))


def contained(rows: DataFrame, root: str, path: str = "file") -> DataFrame:
    """Rows whose real path lies in the real ``root``; a link that leads out of it doesn't."""
    top = os.path.realpath(root.removeprefix("file://"))
    return real_paths(rows, path, "_real").where(P.is_inside("_real", top)).drop("_real")


def list_resources(files: DataFrame, extensions: list[str], excluded_dirs: list[str] = (), limit: int = MAX_RESOURCES) -> DataFrame:
    """(uri, name, mime_type) of the first ``limit`` files by name."""
    folders = F.filter(F.split(P.dirname("relative"), "/"), lambda d: d != ".")
    keep = P.extension("relative").isin([f".{e.lower().lstrip('.')}" for e in extensions]) & (F.size(folders) <= MAX_DEPTH)
    if excluded_dirs:
        keep = keep & ~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in excluded_dirs]))
    return files.where(keep).orderBy("relative").limit(limit).select(P.path_to_uri("file").alias("uri"), F.col("relative").alias("name"), P.mime_type("relative").alias("mime_type"))


def read_resource(spark: SparkSession, root: str, uri: str) -> DataFrame:
    """The one resource at ``uri``; an address outside of ``root`` is refused."""
    from urllib.parse import unquote

    path = unquote(uri.removeprefix("file://"))
    top = root.rstrip("/").removeprefix("file://")
    if not (path == top or path.startswith(top + "/")) or ".." in path.split("/"):
        raise ValueError("resource is outside of the workspace")
    return spark.read.format("binaryFile").load(path).select(F.lit(uri).alias("uri"), P.mime_type(_plain(F.col("path"))).alias("mime_type"), F.decode("content", "UTF-8").alias("text"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of a text file, numbered in order within and across its splits."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))

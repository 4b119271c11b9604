"""The folder that driver and executors share, and tables stored once in it.

Scratch tables
--------------
Operators that reuse an expensive intermediate write it once as Parquet below the folder
named in ``spark.checkpoint.dir`` and read it back.  That folder is shared by driver and
executors, so a lost executor costs only a re-read.

Each call of an operator has a ``Scratch`` of its own and deletes its tables when it
returns, but for those that its lazy result still reads.  They belong to whoever uses the
result: a caller that works inside ``owning(spark)`` gets them deleted at the end of that
block.  Nobody deletes tables of another call.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_STORED: dict[tuple[str, str], str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder for scratch tables, from ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) may leave the setting out; a cluster
    session without it is refused, as a machine-local folder would be invisible
    to the other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="corpusforge-")
        root = _LOCAL_ROOTS[app]
    return root.rstrip("/")


#: Rows of one file of a scratch table of numbers, about.
FILE_ROWS = 1_000_000


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path
    return where(path).getFileSystem(spark._jsc.hadoopConfiguration()), where


def pointer_names(spark: SparkSession, folder: str) -> list[str]:
    """Names ``number-id`` of the pointers in ``folder``, oldest first."""
    fs, where = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where(folder))) if fs.exists(where(folder)) else []


def publish_pointer(spark: SparkSession, folder: str, name: str) -> None:
    """Make ``name`` the newest pointer: one atomic step, after all that it names is complete."""
    names = pointer_names(spark, folder)
    number = 1 + (int(names[-1].split("-")[0]) if names else 0)
    fs, where = _hadoop(spark, folder)
    fs.mkdirs(where(f"{folder}/{number:012d}-{name}"))


class Scratch:
    """Scratch tables of one call; leaving the ``with`` block deletes those not kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def path(self, label: str, keep: bool = False) -> str:
        """A new path; with ``keep`` it goes to the owner of the result, if there is one."""
        path = f"{shared_root(self.spark)}/corpusforge/{label}-{uuid.uuid4().hex}"
        holder = _OWNER.get() if keep else self
        if holder is not None:
            holder.paths.append(path)
        return path

    def write(self, df: DataFrame, label: str, keep: bool = False, rows: int | None = None) -> DataFrame:
        """Write ``df`` once as Parquet and return the table read back.

        ``rows`` is a bound of the rows of a table of numbers, where one is known; it is
        then written in files of some size, at least two a core, not in one a partition.
        """
        path = self.path(label, keep)
        if rows is not None:
            df = df.coalesce(max(2 * self.spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        while self.paths:
            drop_path(self.spark, self.paths.pop())

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.release()


_OWNER: ContextVar[Scratch | None] = ContextVar("owner", default=None)


@contextmanager
def owning(spark: SparkSession) -> Iterator[Scratch]:
    """Owns the tables that results of operators called in the block still read, and
    deletes them at its end; store the results before that."""
    with Scratch(spark) as owner:
        token = _OWNER.set(owner)
        try:
            yield owner
        finally:
            _OWNER.reset(token)


def stored_path(spark: SparkSession, name: str, make: Callable[[str], None]) -> str:
    """Path of what ``make(path)`` has stored under ``name`` in this application; made once."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _STORED:
        path = f"{shared_root(spark)}/corpusforge/stored-{uuid.uuid4().hex}"
        make(path)
        _STORED[key] = path
    return _STORED[key]


def stored(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name``, written by the first caller of this application."""
    return spark.read.parquet(stored_path(spark, name, lambda path: make().write.parquet(path)))


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` over all cores if it comes in fewer pieces than there are, as a small file or one
    of a single row group does; else as it is, without a shuffle.

    For expensive expressions over small tables: what is dealt out is less than a piece a core.
    With ``rows`` a piece has no more than about so many, so no task grows with the table.
    """
    least = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        least = max(least, -(-df.count() // rows))
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df

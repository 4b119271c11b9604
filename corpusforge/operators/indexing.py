"""Index maintenance: what changed, what to process, what to keep.

Every step is a join or a window on ``file``; metadata decide first, so contents are read
for the files that are left only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch

#: Files changed this recently are always hashed again.
FRESH_MS = 2000


def collapse_aliases(files: DataFrame, key: str = "file") -> DataFrame:
    """One row per key: later mtime, then larger size, then the first (``ord``)."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last("mtime_ms"), F.desc_nulls_last("size"), "ord")
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def detect_changes(found: DataFrame, known: DataFrame, now_ms: int, force: bool = False) -> DataFrame:
    """``found(file, size, mtime_ms)`` against ``known(file, hash, size, mtime_ms)``.

    Adds ``expected_hash`` and ``unchanged``: hash known, same mtime and size, and not
    within two seconds of ``now_ms``.  Rows that are not unchanged are to be read; their
    content hash is compared with the expected one afterwards (``verify_hashes``).
    """
    k = known.select("file", F.col("hash").alias("expected_hash"), F.col("size").alias("_size"), F.col("mtime_ms").alias("_mtime"))
    same = F.col("expected_hash").isNotNull() & (F.col("size") == F.col("_size")) & (F.col("mtime_ms") == F.col("_mtime")) & (F.abs(F.lit(now_ms) - F.col("mtime_ms")) > FRESH_MS)
    return found.join(k, "file", "left").withColumn("unchanged", F.coalesce(same, F.lit(False)) & F.lit(not force)).drop("_size", "_mtime")


def verify_hashes(read: DataFrame) -> DataFrame:
    """``read(file, content_hash, expected_hash)``: rows whose content did change."""
    return read.where(~F.col("content_hash").eqNullSafe(F.col("expected_hash")))


def prune_deleted(known: DataFrame, found: DataFrame, key: str = "file") -> DataFrame:
    """Known rows whose file is no longer found."""
    return known.join(found.select(key), key, "left_anti")


def missing_call_data(known: DataFrame, call_data: DataFrame, found: DataFrame, key: str = "file") -> DataFrame:
    """Known files without call data that are still found."""
    return known.select(key).join(call_data.select(key), key, "left_anti").join(found.select(key), key, "left_semi")


def change_summary(changes: DataFrame) -> DataFrame:
    """One row of conditional counts."""
    return changes.agg(
        F.count("*").alias("files"),
        F.count_if("unchanged").alias("unchanged"),
        F.count_if(~F.col("unchanged")).alias("to_process"),
        F.count_if(F.col("expected_hash").isNull()).alias("missing_hash"),
    )


@dataclass(frozen=True)
class IndexMode:
    mode: str
    reason: str


def index_mode(force: bool, stored_chunks: int, to_process: int, files: int, missing_hashes: int) -> IndexMode:
    """full, initial or incremental, and why; resume-partial if a hash to compare with is missing."""
    if force:
        return IndexMode("full", "full")
    if stored_chunks == 0:
        return IndexMode("initial", "initial")
    return IndexMode("full" if to_process == files else "incremental", "resume-partial" if missing_hashes else "incremental")


def read_status(size: Column, is_directory: Column, read_size: Column, error: Column, max_size: int = 1 << 20) -> Column:
    """Status of a file read, '' if it is fine."""
    return (
        F.when(is_directory, "is_directory")
        .when(size.isNull(), "stat_failed")
        .when(size > max_size, "too_large")
        .when(error.isNotNull(), "read_failed")
        .when(read_size > max_size, "too_large_after_read")
        .otherwise("")
    )


def commit_guard(results: DataFrame, expected: DataFrame, key: str = "file") -> DataFrame:
    """Files of ``expected(file, total)`` all of whose chunks succeeded.

    ``results(file, success)`` of unknown files are ignored.
    """
    done = results.groupBy(key).agg(F.count_if("success").alias("succeeded"))
    return expected.join(done, key, "left").where(F.coalesce("succeeded", F.lit(0)) == F.col("total")).select(key, "total")


def replace_by_file(chunks: DataFrame, changed: DataFrame, new: DataFrame, key: str = "file") -> DataFrame:
    """Chunks without those of ``changed`` files, and the new ones.

    A changed file without new chunks loses its old ones.
    """
    return chunks.join(changed.select(key).distinct(), key, "left_anti").unionByName(new)


#: Rows of a range that is summed in one task, about; most ranges.
RANGE_ROWS, MOST_RANGES = 100_000, 8192
#: Bits of a row's place in its partition, in Spark's increasing ids.
_PLACE_BITS = 33


def running_total(rows: DataFrame, order: str, weight: str | None = None, name: str = "total", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with the sum of ``weight`` (rows, if None) up to and including each row.

    The rows are sorted in ranges of ``order`` and stored once with their range and place, so
    every use of them sees the same ranges.  A row's total is what lies before its range plus
    what lies before it inside, so no task sees more than a range, and a row costs the same
    however many ranges there are.  Rows of equal order are summed in any order; a key that
    repeats very often makes its range as large.  Unless there is one range, the stored table
    belongs to the caller.
    """
    amount = F.lit(1) if weight is None else F.col(weight)
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, -(-n // range_rows)))
    if ranges == 1:
        return rows.withColumn(name, F.sum(amount).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).cast("long"))  # ``range_rows`` rows at most
    sorted_ = rows.repartitionByRange(ranges, order).sortWithinPartitions(order).withColumn("_nth_", F.monotonically_increasing_id())
    held = Scratch(rows.sparkSession).write(sorted_, "ranges", keep=True).withColumn("_range_", F.shiftright("_nth_", _PLACE_BITS))
    sums = held.groupBy("_range_").agg(F.sum(amount).alias("_sum_"))  # a row a range
    before = F.coalesce(F.sum("_sum_").over(Window.orderBy("_range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_range_", before.alias("_before_"))
    if weight is None:
        inside = F.col("_nth_").bitwiseAND((1 << _PLACE_BITS) - 1) + 1
    else:
        inside = F.sum(amount).over(Window.partitionBy("_range_").orderBy("_nth_").rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("_inside_", inside).join(F.broadcast(starts), "_range_").withColumn(name, (F.col("_inside_") + F.col("_before_")).cast("long")).drop("_range_", "_nth_", "_inside_", "_before_")


def dense_index(chunks: DataFrame, order: str = "chunk_id", name: str = "index", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Gapless numbers from 0 in order of ``order``, by ``running_total``."""
    return running_total(chunks, order, None, name, range_rows).withColumn(name, F.col(name) - 1)


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row: distinct files and chunks."""
    return chunks.agg(F.count_distinct("file").alias("files"), F.count("*").alias("chunks"))


def group_by_file(chunks: DataFrame) -> DataFrame:
    """(file, place, chunk_id): the chunks of each file in order, numbered from 0.

    One row a chunk, so a file of any size is no single value or task.
    """
    rows = chunks.select("file", "chunk_id").withColumn("_key", F.struct("file", "chunk_id"))
    numbered = dense_index(rows, "_key", "_n").drop("_key")
    first = numbered.groupBy("file").agg(F.min("_n").alias("_first"))
    return numbered.join(first.withColumnRenamed("file", "_file"), F.col("file").eqNullSafe(F.col("_file"))).select("file", (F.col("_n") - F.col("_first")).alias("place"), "chunk_id")


def lru_keep(entries: DataFrame, limit: int = 5000, keep: int = 4000, time: str = "last_used", key: str = "key") -> DataFrame:
    """All rows if there are at most ``limit``, else the ``keep`` used last."""
    total = entries.agg(F.count("*").alias("_total"))
    best = entries.orderBy(F.desc(time), key).limit(max(keep, limit))
    n = F.row_number().over(Window.orderBy(F.desc(time), key))  # at most ``limit`` rows
    return best.withColumn("_n", n).crossJoin(F.broadcast(total)).where(f"_total <= {limit} or _n <= {keep}").drop("_n", "_total")


def coalesce_events(events: DataFrame) -> DataFrame:
    """``events(path, event_type, seq)`` to one row per path: its last type and the ``seq`` of
    its first event."""
    return events.groupBy("path").agg(F.max_by("event_type", "seq").alias("event_type"), F.min("seq").alias("first_seq"))


def trim_pending(pending: DataFrame, limit: int = 10_000, keep: int = 5000) -> DataFrame:
    """What a live queue holds on to: all of ``pending(path, event_type, first_seq)`` below
    ``limit`` paths, else the ``keep`` latest.

    For a queue in memory that would overflow.  A stream's backlog lies in its source and is
    not trimmed.
    """
    total = pending.agg(F.count("*").alias("_total"))
    late = pending.orderBy(F.desc("first_seq"), "path").limit(max(limit, keep))
    n = F.row_number().over(Window.orderBy(F.desc("first_seq"), "path"))  # at most ``limit`` rows
    return late.withColumn("_n", n).crossJoin(F.broadcast(total)).where(f"_total < {limit} or _n <= {keep}").drop("_n", "_total")


def nearest_rank(values: DataFrame, group: str, column: str, percent: float, name: str = "value") -> DataFrame:
    """(group, name): the element at min(n - 1, floor(percent / 100 * n)) of each group's sorted
    values; exact.

    Values are counted first, and the rank is looked up in a running total over all groups,
    so a group is never one task's work.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(group, column).agg(F.count("*").alias("_n")).withColumn("_key", F.struct(group, column))
    total = running_total(counted, "_key", "_n", "_upto").withColumn("_from", F.col("_upto") - F.col("_n"))
    asked = total.groupBy(F.col(group).alias("_group")).agg(F.min("_from").alias("_first"), F.sum("_n").alias("_all"))
    rank = F.col("_first") + F.least(F.col("_all") - 1, F.floor(F.col("_all") * percent / 100))
    found = total.join(asked, F.col(group).eqNullSafe(F.col("_group"))).where((F.col("_from") <= rank) & (rank < F.col("_upto")))
    return found.select(group, F.col(column).alias(name))


def breaker(results: DataFrame, limit: int = 8, scope: str = "scope", order: str = "seq", success: str = "success") -> DataFrame:
    """(scope, tripped_at, failures): where ``limit`` failures follow one another without a
    success between them, first of each scope.

    A run of failures is what lies between two successes: their running total names it, and
    a running number of all rows finds its row ``limit``, so no scope is one task's work.
    """
    rows = results.select(scope, order, F.col(success).cast("int").alias("_ok")).withColumn("_key", F.struct(scope, order))
    placed = running_total(running_total(rows, "_key", "_ok", "_run"), "_key", None, "_at").drop("_key")
    runs = placed.where("_ok = 0").groupBy(scope, "_run").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    tripped = runs.groupBy(F.col(scope).alias("_scope")).agg(F.min(F.when(F.col("_n") >= limit, F.col("_first") + limit - 1)).alias("_trip"), F.sum("_n").alias("failures"))
    hit = placed.join(tripped.where("_trip is not null"), F.col("_at") == F.col("_trip"))
    return hit.select(scope, F.col(order).alias("tripped_at"), "failures")


def error_list(results: DataFrame, stage: str, scope: str = "scope", order: str = "seq", message: str = "error") -> DataFrame:
    """(stage, scope, at, message) of every row with an error, for the list that a status
    report shows; read it with ``orderBy("at").limit(n)``."""
    return results.where(F.col(message).isNotNull()).select(F.lit(stage).alias("stage"), F.col(scope).alias("scope"), F.col(order).alias("at"), F.col(message).alias("message"))

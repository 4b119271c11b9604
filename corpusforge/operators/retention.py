"""Which stored indexes to keep: ordered rules, duplicates, and the one to attach to.

A row of facts has cache_id, workspace (null: unknown), workspace_exists, model,
dimension, files_indexed, chunks_stored, has_meta, is_active, last_activity_ms,
dir_mtime_ms, progress_ms (null: no progress).  All ages are against ``as_of_ms``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_non_project, is_temporary

HOUR, DAY, MINUTE = 3_600_000, 86_400_000, 60_000


@dataclass(frozen=True)
class Thresholds:
    """Milliseconds."""

    stale_no_meta: int = 6 * HOUR
    empty: int = 24 * HOUR
    workspace_grace: int = 7 * DAY
    unused: int = 30 * DAY
    temporary: int = 24 * HOUR
    stale_progress: int = 6 * HOUR
    safety: int = 10 * MINUTE
    progress_without_meta: int = 5 * MINUTE


def activity(*times: Column, fallback: Column) -> Column:
    """Latest of the known times, else the folder's own."""
    return F.coalesce(F.greatest(*times) if len(times) > 1 else times[0], fallback)


def rules(as_of_ms: int, t: Thresholds = Thresholds(), tmpdir: str = "/tmp") -> list[tuple[str, Column, str]]:
    """(reason, condition, action) in the order in which they are tried."""
    now = F.lit(as_of_ms)
    age, dir_age = now - F.col("last_activity_ms"), now - F.coalesce("dir_mtime_ms", F.lit(0))
    progress = F.col("progress_ms").isNotNull()
    progress_age = now - F.col("progress_ms")
    temporary = is_temporary("workspace", tmpdir)
    empty = (F.coalesce("files_indexed", F.lit(0)) == 0) | (F.coalesce("chunks_stored", F.lit(0)) == 0)
    missing = F.col("workspace").isNotNull() & ~F.col("workspace_exists")
    return [
        ("active_lock", F.col("is_active"), "KEEP"),
        ("system_workspace_cache", F.coalesce(is_non_project("workspace"), F.lit(False)), "REMOVE"),
        ("recent_activity", age < t.safety, "KEEP"),
        ("no_meta_stale", ~F.col("has_meta") & (dir_age > t.stale_no_meta) & ~(progress & (progress_age < t.progress_without_meta)), "REMOVE"),
        ("initializing", ~F.col("has_meta"), "KEEP"),
        ("temp_workspace", temporary & (age > t.temporary), "REMOVE"),
        ("recent_temp_workspace", temporary, "KEEP"),
        ("empty_cache", empty & (age > t.empty), "REMOVE"),
        ("recent_empty", empty, "KEEP"),
        ("workspace_missing", missing & (age > t.workspace_grace), "REMOVE"),
        ("workspace_grace_period", missing, "KEEP"),
        ("stuck_indexing", progress & (progress_age >= t.safety) & (progress_age > t.stale_progress), "REMOVE"),
        ("long_unused", age > t.unused, "REMOVE"),
        ("valid_cache", F.lit(True), "KEEP"),
    ]


def decide(facts: DataFrame, as_of_ms: int, thresholds: Thresholds = Thresholds(), tmpdir: str = "/tmp") -> DataFrame:
    """``facts`` with action, reason and age_ms; the first rule that holds decides."""
    listed = rules(as_of_ms, thresholds, tmpdir)
    reason = F.coalesce(*[F.when(c, name) for name, c, _ in listed])
    keeps = [name for name, _, action in listed if action == "KEEP"]
    out = facts.withColumn("reason", reason).withColumn("age_ms", F.lit(as_of_ms) - F.col("last_activity_ms"))
    return out.withColumn("action", F.when(F.col("reason").isin(keeps), "KEEP").otherwise("REMOVE"))


def mark_duplicates(facts: DataFrame) -> DataFrame:
    """``facts`` with ``duplicate``: of one workspace, model and dimension all but the latest,
    unless in use.  Rows without a workspace are no duplicates."""
    w = Window.partitionBy("workspace", F.coalesce("model", F.lit("default")), F.coalesce(F.col("dimension").cast("string"), F.lit("default"))).orderBy(F.desc("last_activity_ms"), "cache_id")
    named, others = facts.where("workspace is not null"), facts.where("workspace is null")
    return named.withColumn("duplicate", (F.row_number().over(w) > 1) & ~F.col("is_active")).unionByName(others.withColumn("duplicate", F.lit(False)))


def retention(facts: DataFrame, as_of_ms: int, remove_duplicates: bool = True, **options) -> DataFrame:
    """Decision of each row; duplicates override KEEP only."""
    decided = decide(facts, as_of_ms, **options)
    if not remove_duplicates:
        return decided
    marked = mark_duplicates(decided)
    over = F.col("duplicate") & (F.col("action") == "KEEP")
    return marked.withColumn("reason", F.when(over, "duplicate_workspace").otherwise(F.col("reason"))).withColumn("action", F.when(over, "REMOVE").otherwise(F.col("action"))).drop("duplicate")


def retention_totals(decisions: DataFrame) -> DataFrame:
    """One row: removed and kept."""
    return decisions.agg(F.count_if(F.col("action") == "REMOVE").alias("removed"), F.count_if(F.col("action") == "KEEP").alias("kept"))


def attach_candidate(candidates: DataFrame, preferred: str | None = None) -> DataFrame:
    """The one workspace to attach to, or no row if the choice is open.

    ``candidates(workspace, source, rank)``: the highest rank of each workspace counts; the
    preferred workspace wins, else the only one there is.
    """
    best = candidates.where(~is_non_project("workspace")).groupBy("workspace").agg(F.max_by(F.struct("source", "rank"), "rank").alias("b")).select("workspace", "b.source", "b.rank")
    if preferred is not None:
        hit = best.where(F.col("workspace") == preferred)
        only = best.agg(F.count("*").alias("n"), F.count_if(F.col("workspace") == preferred).alias("p"), F.first(F.struct("workspace", "source", "rank")).alias("w")).where("n = 1 and p = 0")
        return hit.union(only.select("w.workspace", "w.source", "w.rank"))
    return best.agg(F.count("*").alias("n"), F.first(F.struct("workspace", "source", "rank")).alias("w")).where("n = 1").select("w.workspace", "w.source", "w.rank")

"""Expressions over progress messages, memory logs, times and environment keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of each keyword in an environment key.
KEY_WEIGHTS = {"WORKSPACE": 8, "PROJECT": 4, "ROOT": 3, "CWD": 2, "DIR": 1}
#: The three progress messages.
INDEXED = r"(?i)Indexed\s+(\d+)\s*/\s*(\d+)\s+files"
COMPLETE = r"(?i)Complete:\s+\d+\s+chunks\s+from\s+(\d+)\s+files"
PROCESSING = r"(?i)Processing\s+(\d+)\s+changed files"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def progress(message: Column | str) -> Column:
    """Struct of indexed and total files in a progress message; null if it is none."""
    m = F.coalesce(_col(message), F.lit(""))
    number = lambda pattern, group: F.regexp_extract(m, pattern, group).try_cast("long")
    none = F.lit(None).cast("long")
    made = lambda a, b: F.struct(a.alias("indexed"), b.alias("total"))
    return F.when(m.rlike(INDEXED), made(number(INDEXED, 1), number(INDEXED, 2))).when(m.rlike(COMPLETE), made(number(COMPLETE, 1), number(COMPLETE, 1))).when(m.rlike(PROCESSING), made(none, number(PROCESSING, 1)))


def key_score(key: Column | str) -> Column:
    """How much an environment key looks like a workspace folder."""
    upper = F.upper(F.coalesce(_col(key), F.lit("")))
    return reduce(lambda a, b: a + b, [F.when(F.contains(upper, F.lit(k)), w).otherwise(0) for k, w in KEY_WEIGHTS.items()])


def human_age(ms: Column | str) -> Column:
    """Age as ``Xd Yh``, ``Xh Ym``, ``Xm`` or ``Xs``, by the largest unit."""
    s = F.floor(_col(ms) / 1000)
    m, h, d = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)
    show = lambda fmt, *xs: F.format_string(fmt, *xs)
    return F.when(d > 0, show("%dd %dh", d, h % 24)).when(h > 0, show("%dh %dm", h, m % 60)).when(m > 0, show("%dm", m)).otherwise(show("%ds", s))


def iso_millis(text: Column | str) -> Column:
    """Milliseconds of an ISO time; null if it can't be read."""
    return F.unix_millis(F.try_to_timestamp(_col(text)))


def memory_snapshots(lines: DataFrame, order: str = "n", text: str = "line") -> DataFrame:
    """Idle and latest memory line of a log: (kind, line); no row for what is missing.

    The idle line is the last one after a cache load, else the last memory line.
    """
    memory = lines.where(F.col(text).rlike(r"Memory\s*\(|Memory.*rss="))
    best = memory.agg(F.max_by(text, F.when(F.contains(F.col(text), F.lit("after cache load")), F.col(order))).alias("loaded"), F.max_by(text, order).alias("latest"))
    return best.select(F.explode(F.array(F.struct(F.lit("idle").alias("kind"), F.coalesce("loaded", "latest").alias("line")), F.struct(F.lit("latest").alias("kind"), F.col("latest").alias("line")))).alias("r")).select("r.kind", "r.line").where("line is not null")


def tail(lines: DataFrame, n: int, order: str = "n", text: str = "line") -> DataFrame:
    """Last ``n`` lines that are not empty, in order; a heap of ``n`` rows a task."""
    return lines.where(F.trim(F.col(text)) != "").orderBy(F.desc(order)).limit(n).orderBy(order)

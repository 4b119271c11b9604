"""Vector expressions over ``array<float>`` columns; sums are in double."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal(vector) -> Column:
    """A driver-side vector as one array literal of floats."""
    return F.array(*[F.lit(float(x)) for x in vector]).cast("array<float>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product; both sides must have equal lengths (filter on ``same_size`` first)."""
    pairs = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def same_size(a: Column | str, b: Column | str) -> Column:
    return _col(a).isNotNull() & _col(b).isNotNull() & (F.size(_col(a)) == F.size(_col(b)))


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def slice_normalize(v: Column | str, dim: int | None) -> Column:
    """First ``dim`` elements at unit length; a zero vector stays, a short one too."""
    v = _col(v)
    if not dim:
        return v
    cut = F.slice(v, 1, dim)
    # Bound by a one-element array, so the norm is computed once a row.
    scaled = F.element_at(F.transform(F.array(F.struct(cut.alias("c"), norm(cut).alias("n"))), lambda s: F.transform(s["c"], lambda x: F.when(s["n"] == 0, x).otherwise((x.cast("double") / s["n"]).cast("float")))), 1)
    return F.when(F.size(v) <= dim, v).otherwise(scaled)


def recency(mtime_ms: Column, as_of_ms: Column | int, decay_days: float = 30) -> Column:
    """1 at ``as_of``, falling to 0 after ``decay_days`` (0 counts as 30); above 1 for later times."""
    day = 86_400_000.0
    age = (F.lit(as_of_ms) if isinstance(as_of_ms, int) else as_of_ms) - mtime_ms
    return F.greatest(F.lit(0.0), F.lit(1.0) - age / F.lit((decay_days or 30) * day))


def store_round(v: Column | str, digits: int | None = None) -> Column:
    """Elements as the JSON store keeps them: rounded half up, not finite ones as 0."""
    scale = 10.0 ** (6 if digits is None else digits)

    def one(x):
        d = x.cast("double")
        return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(0.0)).otherwise(F.floor(d * scale + 0.5).cast("double") / scale)

    return F.transform(_col(v), one)


def hop_decay(hop: Column | int) -> Column:
    return F.lit(1.0) / ((F.lit(hop) if isinstance(hop, int) else hop) + 1)


def candidate_count(k: Column | int, total: Column | int, least: int = 50, most: int = 200, multiplier: float = 20) -> Column:
    """Candidates to ask an approximate index for."""
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    wanted = F.ceil(lit(k) * F.lit(float(multiplier))).cast("long")
    return F.least(lit(total).cast("long"), F.greatest(lit(k).cast("long"), F.least(F.lit(most).cast("long"), F.greatest(F.lit(least).cast("long"), wanted))))


def candidates(k: int, total: int, least: int = 50, most: int = 200, multiplier: float = 20) -> int:
    """``candidate_count`` on the driver."""
    return min(total, max(k, min(most, max(least, math.ceil(k * multiplier)))))


def capacity(n: Column) -> Column:
    """Elements an index is made for: a fifth more, 1024 more at least."""
    return F.greatest(n, F.ceil(n * F.lit(1.2)).cast("long"), n + 1024)


def batch_size(files: Column) -> Column:
    """Files of a progress batch by corpus size; reporting only."""
    return F.when(files > 5000, 500).when(files > 1000, 100).when(files > 500, 50).otherwise(10)


def progress_percent(done: Column, total: Column) -> Column:
    return F.floor(F.lit(10) + F.lit(85) * done / total).cast("int")

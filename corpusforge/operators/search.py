"""Hybrid and similarity search over a chunk table.

A chunk table has ``chunk_id, file, content, vector`` (further columns are kept).  The
score is one Column; ranking is ``orderBy(desc(score), chunk_id).limit(k)``, which Spark
runs as a heap per task.  Contents are joined back to the few winners afterwards, so the
scan for ranking reads content only where a text term needs it.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..functions.code import symbols
from . import graph
from .substring import SubstringIndex


@dataclass(frozen=True)
class SearchConfig:
    """Parameters that change results, with their defaults."""

    semantic_weight: float = 0.7
    exact_boost: float = 1.5
    partial_boost: float = 0.3
    recency_boost: float = 0.1
    recency_days: float = 30
    text_candidates: int = 2000
    call_graph: bool = True
    call_graph_boost: float = 0.15
    max_hops: int = 1
    ann_min_chunks: int = 5000
    ann_min_candidates: int = 50
    ann_max_candidates: int = 200
    ann_multiplier: float = 20
    max_results: int = 5


def semantic_score(query_vector, weight: float = 1.0, vector: str = "vector") -> Column:
    return F.lit(float(weight)) * V.dot(V.literal(query_vector), vector)


def comparable(chunks: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """Rows that have a vector of the query's length; others are skipped, not scored."""
    return chunks.where(F.col(vector).isNotNull() & (F.size(vector) == dim))


def top_k(scored: DataFrame, k: int, score: str = "score", key: str = "chunk_id") -> DataFrame:
    """The ``k`` best rows, ties by key, with a ``rank`` from 1."""
    from pyspark.sql import Window

    best = scored.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))  # k rows


def with_recency(chunks: DataFrame, mtimes: DataFrame, as_of_ms: int, boost: float, days: float) -> DataFrame:
    """``recency`` term from ``mtimes(file, mtime_ms)``; 0 for files without a time."""
    joined = chunks.join(mtimes.select("file", "mtime_ms"), "file", "left")
    return joined.withColumn("recency", F.coalesce(F.lit(float(boost)) * V.recency(F.col("mtime_ms"), as_of_ms, days), F.lit(0.0))).drop("mtime_ms")


def deferred_text_boost(scored: DataFrame, boost: Column, cap: int, key: str = "chunk_id") -> DataFrame:
    """Add ``boost`` to ``score`` of the ``cap`` best rows only.

    The place of the last of them is one row, found by a heap per task; every row is then
    compared with it, so no row is sorted globally or numbered.
    """
    last = scored.select("score", key).orderBy(F.desc("score"), key).limit(cap).agg(F.min(F.struct(F.col("score").alias("s"), (-F.col(key)).alias("k"))).alias("last"))
    here = F.struct(F.col("score").alias("s"), (-F.col(key)).alias("k"))
    joined = scored.crossJoin(F.broadcast(last))  # one row
    return joined.withColumn("score", F.when(here >= F.col("last"), F.col("score") + boost).otherwise(F.col("score"))).drop("last")


def augment_exact(candidates: DataFrame, chunks: DataFrame, query: str, needed: int, key: str = "chunk_id", index: SubstringIndex | None = None) -> DataFrame:
    """Candidates and, in order of key, further chunks that hold the query, ``needed`` matches in
    all; found by ``index``, or without one by a scan of the contents."""
    ids = candidates.select(key).distinct()
    held = (index.search(query, chunks) if index is not None else chunks.where(T.exact_match("content", F.lit(query)))).select(key)
    have = held.join(ids, key, "left_semi").agg(F.count("*").alias("have"))
    rest = held.join(ids, key, "left_anti").orderBy(key).limit(needed)
    from pyspark.sql import Window

    more = rest.withColumn("n", F.row_number().over(Window.orderBy(key))).crossJoin(F.broadcast(have)).where(F.col("n") <= needed - F.col("have")).select(key)  # at most ``needed`` rows
    return ids.union(more)


def hybrid_search(
    chunks: DataFrame,
    query: str,
    query_vector,
    as_of_ms: int = 0,
    k: int | None = None,
    config: SearchConfig = SearchConfig(),
    mtimes: DataFrame | None = None,
    call_edges: tuple[DataFrame, DataFrame] | None = None,
    candidates: DataFrame | None = None,
    n_chunks: int | None = None,
    exact: SubstringIndex | None = None,
) -> DataFrame:
    """The ``k`` best chunks: rank, score and all columns of ``chunks`` but the vector.

    ``mtimes(file, mtime_ms)`` adds recency, ``call_edges`` (definitions and calls as
    ``(symbol, file)``) proximity to the five best rows, ``candidates(chunk_id)`` of an
    approximate index restrict the rows; they count only if there are ``k`` distinct ones.
    ``exact`` finds the chunks that hold the query without a scan of the contents.
    A blank query is an error; an empty table gives no rows.
    """
    if not query or not query.strip():
        raise ValueError("query must not be blank")
    k = k or config.max_results
    vector = list(query_vector)
    rows = chunks
    if candidates is not None:
        ids = candidates.select("chunk_id").distinct()
        if len(ids.limit(k).collect()) >= k:
            total = n_chunks if n_chunks is not None else chunks.count()
            if total <= config.text_candidates and len(query) > 1:
                ids = augment_exact(ids, chunks, query, k, index=exact)
            # The index returns some hundreds of ids, whatever the table's size.
            rows = chunks.join(ids, "chunk_id", "left_semi")
    # Ranking sees ids, files and numbers; contents are fetched for bounded sets of ids only.
    base = comparable(rows, len(vector)).select("chunk_id", "file", semantic_score(vector, config.semantic_weight).alias("dot"))
    if mtimes is not None and config.recency_boost > 0:
        base = with_recency(base, mtimes, as_of_ms, config.recency_boost, config.recency_days)
    else:
        base = base.withColumn("recency", F.lit(0.0))
    scored = base.select("chunk_id", "file", (F.col("dot") + F.col("recency")).alias("score"))
    text = T.text_score("content", query, config.exact_boost, config.partial_boost)
    total = n_chunks if n_chunks is not None and candidates is None else rows.count() if len(query) > 1 else 0
    if total > config.text_candidates:
        # Only the first ``text_candidates`` rows are looked at; the others keep their score.
        head = scored.select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(config.text_candidates)
        boosts = fetch(head.select("chunk_id"), rows).select("chunk_id", text.alias("boost"))
        scored = scored.join(F.broadcast(boosts), "chunk_id", "left")  # ``text_candidates`` rows
        scored = scored.select("chunk_id", "file", (F.col("score") + F.coalesce("boost", F.lit(0.0))).alias("score"))
    else:
        texts = rows.select("chunk_id", text.alias("boost"))
        scored = scored.join(texts, "chunk_id").select("chunk_id", "file", (F.col("score") + F.col("boost")).alias("score"))
    if call_edges is not None and config.call_graph and config.call_graph_boost > 0:
        scored = call_graph_boost(scored, rows, call_edges, config)
    return fetch(top_k(scored.select("chunk_id", "score"), k), chunks.drop("vector")).orderBy("rank")


def fetch(ids: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``chunks`` of some ``ids``, which are as few as a limit says: they go to the chunks, so
    no content is dealt out."""
    return chunks.join(F.broadcast(ids), key)


def call_graph_boost(scored: DataFrame, chunks: DataFrame, call_edges: tuple[DataFrame, DataFrame], config: SearchConfig) -> DataFrame:
    """Boost rows whose file is near the symbols of the five best rows; of all rows."""
    best = scored.select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(5)
    seeds = fetch(best.select("chunk_id"), chunks).select(F.explode(symbols("content")).alias("symbol")).distinct()
    related = graph.related_files(*call_edges, seeds, config.max_hops)
    near = scored.join(related.select("file", "proximity"), "file", "left")
    return near.withColumn("score", F.col("score") + F.lit(config.call_graph_boost) * F.coalesce("proximity", F.lit(0.0))).drop("proximity")


def find_similar(
    chunks: DataFrame,
    vector,
    text: str | None = None,
    k: float | int | None = None,
    min_similarity: float | None = None,
    candidates: DataFrame | None = None,
    n_chunks: int | None = None,
    rescan_limit: int = 5000,
) -> DataFrame:
    """Chunks at least ``min_similarity`` like ``vector``, best first; rows whose text is
    ``text`` but for white space are left out before the limit.

    ``min_similarity`` is clamped to 0 to 1 (default 0.3); a ``k`` that is no number of 1 or
    more counts as 5.  If an approximate index gives fewer than ``k`` similar rows and the
    table has at most ``rescan_limit``, the whole table is searched.  With ``k`` infinite
    (``math.inf``) all similar rows of the table come out, in no order; an index is not asked.
    """
    unlimited = k == inf
    k = int(k) if not unlimited and isinstance(k, (int, float)) and k == k and k >= 1 else 5
    least = 0.3 if min_similarity is None or min_similarity != min_similarity else min(1.0, max(0.0, min_similarity))

    def similar(rows: DataFrame) -> DataFrame:
        return comparable(rows, len(vector)).withColumn("similarity", semantic_score(vector)).where(F.col("similarity") >= least)

    found = similar(chunks)
    if candidates is not None and not unlimited:
        ids = candidates.select("chunk_id").distinct()
        some = similar(chunks.join(ids, "chunk_id", "left_semi"))
        enough = len(some.select("chunk_id").limit(k).collect()) >= k
        if enough or (n_chunks if n_chunks is not None else chunks.count()) > rescan_limit:
            found = some
    if text is not None:
        found = found.where(~F.coalesce(T.normalize_text("content") == T.normalize_text(F.lit(text)), F.lit(False)))
    found = found.drop("vector")
    return found if unlimited else found.orderBy(F.desc("similarity"), "chunk_id").limit(k)


def format_results(found: DataFrame, score: str = "score", language: str = "") -> DataFrame:
    """Results as Markdown sections: rank and ``markdown``."""
    label = F.format_string("%.1f", F.round(F.col(score) * 100, 6))
    body = F.concat(F.lit("## Result "), F.col("rank").cast("string"), F.lit(" (Relevance: "), label, F.lit("%)\n**File:** `"), F.col("file"), F.lit(f"`\n\n```{language}\n"), F.coalesce("content", F.lit("")), F.lit("\n```\n"))
    return found.select("rank", body.alias("markdown"))

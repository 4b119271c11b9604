"""Call graph as edge tables, and files related to symbols.

``defines(symbol, file)`` and ``called_by(symbol, file)`` are the whole graph.  Related
files are found hop by hop with joins; a file's proximity is 1 / (hop + 1) of the smallest
hop that reaches it.  From the second hop on the traversal is breadth-first, which makes
the result independent of the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch


def call_edges(call_data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``call_data(file, definitions, calls)``, best a stored table, to the two edge tables."""
    edge = lambda c: call_data.select(F.explode(c).alias("symbol"), "file").distinct()
    return edge("definitions"), edge("calls")


def inverted_index(edges: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(symbol, file) rows, of some symbols if they are given; one row a file, so a symbol
    that most files call is no single value."""
    rows = edges.select("symbol", "file").distinct()
    return rows if symbols is None else rows.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def graph_stats(defines: DataFrame, called_by: DataFrame) -> DataFrame:
    """One row: number of defined symbols and of called ones."""
    a = defines.agg(F.count_distinct("symbol").alias("definitions"))
    return a.crossJoin(called_by.agg(F.count_distinct("symbol").alias("call_targets")))  # one row each


def related_files(defines: DataFrame, called_by: DataFrame, symbols: DataFrame, max_hops: int = 1) -> DataFrame:
    """(file, proximity) of files within ``max_hops`` of ``symbols(symbol)``.

    Hop 0: files that define or call a symbol.  The next symbols are what the last hop's
    files call.  A negative ``max_hops`` gives no rows.  Beyond one hop, the files that are new
    in each hop are stored, so a hop is computed once, from the new ones only, and the search
    ends when there are none; the result is a stored table that belongs to the caller.
    """
    spark = symbols.sparkSession
    if max_hops < 0:
        return spark.createDataFrame([], "file string, proximity double")
    edges = defines.select("symbol", "file").union(called_by.select("symbol", "file"))
    reach = lambda front, hop: edges.join(front, "symbol", "left_semi").select("file").distinct().withColumn("proximity", F.lit(1.0 / (hop + 1)))
    calls = lambda files: called_by.join(files.select("file"), "file", "left_semi").select("symbol").distinct()
    found = reach(symbols.select("symbol").distinct(), 0)
    if max_hops == 0:
        return found
    if max_hops == 1:
        return found.union(reach(calls(found), 1)).groupBy("file").agg(F.max("proximity").alias("proximity"))
    scope = Scratch(spark)
    new = visited = scope.write(found, "hop", keep=True)
    for hop in range(1, max_hops + 1):
        new = scope.write(reach(calls(new), hop).join(visited.select("file"), "file", "left_anti"), "hop", keep=True)
        if new.isEmpty():
            break
        visited = visited.union(new)
    return visited


def prune_call_data(call_data: DataFrame, valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Call data of valid files, and one row with the number of the others."""
    return call_data.join(valid.select("file"), "file", "left_semi"), call_data.join(valid.select("file"), "file", "left_anti").agg(F.count("*").alias("pruned"))

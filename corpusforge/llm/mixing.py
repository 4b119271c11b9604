"""Mixing sources to target weights by weighted fair queueing.

Every document waits in its source's queue, in a shuffled order.  Its virtual
finish time is the source's cumulative words divided by the source's target; a
source that needs more words than it has queues its documents again, up to three
times.  Entries are served in the order of virtual time until the total budget is
spent.  DataFrame functions only.

Distribution: the shuffled order is that of an md5 of id and text, so its first digits
cut each source into 4096 even buckets.  Running sums are a window inside a bucket plus a
small table of bucket totals; a source with a third of all rows is 4096 windows.  Rows
equal in id and text have one md5; those of one input partition are queued as one entry
with a count, so a window never sees more of them than there are partitions.
The global order of virtual times is range-partitioned the same way: totals of
ranges tell in which one the budget ends, that range is divided again until it is small,
and only then is it sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.indexing import running_total
from .common import WORD_PATTERN, Scratch, neutral

#: Fixed by contract: weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Most times that a document is taken.
EPOCHS = 3
#: Ranges into which a stretch of virtual time is divided, the entries that are sorted at
#: last, about, and the most divisions (doubles can't tell more apart).
RANGES, SORTED, DIVISIONS = 4096, 5000, 4


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) with target: shares by weight, excess reshared.

    Sources that would exceed ``epochs`` times their size stop there; what they leave is
    reshared by weight among the others until none is above.  In closed form: with sources
    ordered by cap per weight, the first level that is not above its own cap.  Places and sums
    in both orders are running totals over ranges, so sources may be many.  Give a stored table.
    """
    key = F.struct(F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("source"))
    ranked = running_total(sizes.withColumn("_key", key), "_key", None, "_place").drop("_key")
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * epochs).withColumn("_key", F.struct((F.col("cap") / F.col("w")).alias("level"), F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("source")))
    summed = running_total(running_total(ranked, "_key", "cap", "_caps"), "_key", "w", "_weights")
    whole = sizes.agg(F.sum("source_size").alias("_size")).crossJoin(ranked.agg(F.sum("w").alias("_all")))  # one row each
    level = (F.col("_size") - (F.col("_caps") - F.col("cap"))) / (F.col("_all") - (F.col("_weights") - F.col("w")))
    levelled = summed.crossJoin(F.broadcast(whole)).withColumn("level", level)  # one row
    open_level = levelled.agg(F.coalesce(F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))), F.lit(0.0)).alias("_open"))
    return levelled.crossJoin(F.broadcast(open_level)).select("q", "source", "source_size", F.least(F.col("cap").cast("double"), F.col("_open") * F.col("w")).alias("target"))  # one row


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number ``_row`` of each row; its upper bits are the input partition's.

    Only for tables that are written at once: another scan may number rows otherwise.
    """
    return docs.withColumn("_row", F.monotonically_increasing_id())


def _mix(rows: DataFrame, scope: Scratch, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """``rows(row, doc_id, q, source, size, k)``, a stored table, to (row, doc_id, size,
    source_size, target, times); the result reads tables of ``scope``."""
    part, n = F.shiftright("row", 33), rows.count()
    entries = rows.where("size > 0").groupBy("q", "k", part.alias("part")).agg(F.first("source").alias("source"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("row", "doc_id"))).alias("copies"))
    entries = scope.write(entries.withColumn("bucket", F.substring("k", 1, 3)).withColumn("words", F.col("size") * F.size("copies")), "entries", rows=n)

    buckets = entries.groupBy("q", "bucket").agg(F.sum("words").alias("bucket_size"))
    sources = scope.write(rows.groupBy("q").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), "sources", rows=n)
    targets = scope.write(source_targets(sources, weights, epochs), "targets", rows=n)
    upto = Window.partitionBy("q").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("q", "bucket", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0)).alias("skip"))
    offsets = offsets.join(targets.select("q", "source_size", "target"), "q")
    inside = Window.partitionBy("q", "bucket").orderBy("k", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = entries.join(offsets, ["q", "bucket"]).withColumn("before", F.col("skip") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
    placed = placed.select("k", "size", "source_size", "target", "before", F.posexplode("copies").alias("nth", "copy"))
    cum = F.col("before") + F.col("size") * (F.col("nth") + 1)
    finish = F.array(*[(F.col("source_size") * e + cum) / F.col("target") for e in range(epochs)])
    queued = scope.write(placed.select("copy.row", "copy.doc_id", "k", "size", "source_size", "target", finish.alias("finish")), "queued", rows=n)

    # The range of virtual time in which the budget ends, ever smaller.  Borders are
    # multiples of powers of two, so no rounding moves a turn across one.
    turns = queued.select("row", "k", "size", F.posexplode("finish").alias("epoch", "at"))
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    inside, low, step, done = F.lit(True), 0.0, 2.0 / RANGES, 0
    in_order = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, 0)  # RANGES rows at most
    for _ in range(DIVISIONS):
        span = F.least(F.floor((F.col("at") - low) / step), F.lit(RANGES - 1)).cast("int")
        served = turns.where(inside).groupBy(span.alias("span")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        last = served.withColumn("upto", F.sum("words").over(in_order) + done).where(F.col("upto") > budget).orderBy("span").first()
        if last is None:  # at first: all turns fit
            inside = F.lit(False) if low == 0.0 and done == 0 and step == 2.0 / RANGES else inside
            break
        low, done = low + last["span"] * step, last["upto"] - last["words"]
        inside = (F.col("at") >= low) & ((F.col("at") < low + step) if last["span"] < RANGES - 1 or low + step < 2.0 else F.lit(True))
        if last["n"] <= SORTED or low + step >= 2.0:
            break
        step /= RANGES
    # Only that range is sorted; the cut is its first turn that does not fit.  Null: all fit.
    order = Window.orderBy("at", "k", "row", "epoch").rowsBetween(Window.unboundedPreceding, 0)
    cut = turns.where(inside).withColumn("upto", F.sum("size").over(order) + done).where(F.col("upto") > budget).agg(F.min(F.struct("at", "k", "row", "epoch")).alias("cut"))
    times = sum(
        (F.when(F.col("cut").isNull() | (F.struct(F.col("finish")[e].alias("at"), F.col("k"), F.col("row"), F.lit(e).alias("epoch")) < F.col("cut")), F.lit(1)).otherwise(F.lit(0)) for e in range(epochs)),
        F.lit(0),
    )
    mixed = queued.crossJoin(F.broadcast(cut)).select("row", "doc_id", "size", "source_size", "target", times.cast("int").alias("times"))  # cut is one row
    wordless = rows.where("size = 0").join(targets.select("q", "source_size", "target"), "q")
    return mixed.union(wordless.select("row", "doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)), F.lit(0)))


def _sized(docs: DataFrame) -> DataFrame:
    """What the mix needs to know of ``docs(_row, doc_id, text, source)``."""
    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))  # equal as the sources are, never null
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))
    return docs.select(F.col("_row").alias("row"), "doc_id", named.alias("q"), "source", word_count("text").alias("size"), key.alias("k"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source, ...)``.

    Columns: doc_id, size (words), source_size, target (of the source), taken (words
    of the document in the mix, repeats counted).

    Edge cases: null and wordless texts have size 0 and are never taken; a null
    source is a source, last in order; a null doc_id shuffles as the empty text;
    repeated rows are rows like others (which of equal ones is taken more often is open);
    an empty table gives an empty result; further columns are ignored.
    """
    with Scratch(docs.sparkSession) as scope:
        rows = scope.write(_sized(_numbered(docs.select("doc_id", "text", "source"))), "sized")
        mixed = _mix(rows, scope, weights, epochs)
        return scope.write(mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken")), "mixed", keep=True, rows=rows.count())


def take_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Rows of ``docs``, each as many times as the mix takes it; columns as they were.

    Every row goes through the mix under a number of its own, so repeated ids, null ids and
    repeated rows are taken as often as ``mix_sources`` says, row by row.

    Edge cases: as in ``mix_sources``; rows without words are never taken; an empty table
    gives an empty result; no column name of ``docs`` clashes with those used here.
    """
    with Scratch(docs.sparkSession) as scope:
        rows, at = neutral(docs)
        rows = scope.write(_numbered(rows), "numbered", keep=True)
        known = rows.select("_row", F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"), F.col(at["source"]).alias("source"))
        mixed = _mix(scope.write(_sized(known), "sized"), scope, weights, epochs).where("times > 0")
        taken = scope.write(mixed.select(F.col("row").alias("_row"), "times"), "taken", keep=True, rows=rows.count())
        each = F.explode(F.sequence(F.lit(1), F.col("times")))
        return rows.join(taken.hint("merge"), "_row").withColumn("_copy", each).select(*at.values()).toDF(*docs.columns)

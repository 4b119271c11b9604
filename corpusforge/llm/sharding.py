"""Sharding by sampled splitters.

Size-weighted key samples give quantile boundaries, records are range-partitioned
by them, and ranges that turn out overfull are subdivided with samples of their
own.  Exact totals of the ranges then place every record: the shard is where the
middle of its group falls in the running sum of sizes, so shards have near equal
sizes (law ``bytes``).

The key is (hash of the text, hash of the id and, in its last 16 bits, of the row): rows
of equal texts are adjacent and share a shard, unless the group itself is a sizeable part
of one; rows of equal text and id, null ids among them, can still be told apart and so be
divided.  Texts are read once; what is shuffled are rows of a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARDS = 40
#: Bytes that a record has besides its text.
OVERHEAD = 16
#: Bytes of records in one range, about, and the most ranges of the first division.
RANGE_BYTES = 256 << 20
MAX_RANGES = 32_768
#: Sampled keys a range.
SAMPLES = 24
#: A group of equal texts larger than this part of a shard may be split.
SPLIT_OVER = 0.05

_KEY = np.dtype([("a", "<i8"), ("b", "<i8")])


def _pairs(a, b) -> np.ndarray:
    out = np.empty(len(a), dtype=_KEY)
    out["a"], out["b"] = a, b
    return out


def choose_splitters(keys: np.ndarray, parts: int) -> np.ndarray:
    """Boundaries of ``parts`` ranges at quantiles of the sampled keys.

    A boundary starts a whole group (second half of the key lowest), unless the
    group takes a range or more of the sample by itself; such a group is subdivided
    and gets ranges of its own.
    """
    if not len(keys) or parts < 2:
        return np.empty(0, dtype=_KEY)
    keys = np.sort(keys, order=("a", "b"))
    low = np.iinfo(np.int64).min
    picked = keys[(np.arange(1, parts) * len(keys)) // parts]
    values, counts = np.unique(picked["a"], return_counts=True)
    out = []
    for a, n in zip(values.tolist(), counts.tolist(), strict=True):
        out.append((a, low))
        if n > 1:
            out += [(a, int(b)) for b in picked["b"][picked["a"] == a]]
            out += [(a + 1, low)] if a < np.iinfo(np.int64).max else []
    return np.unique(np.array(out, dtype=_KEY))


def _range_of(splitters):
    """Range number of (a, b), by binary search among the boundaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = splitters.value
        for batch in batches:
            a, b = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("a", "b"))
            left = np.searchsorted(bounds["a"], a, "left")
            right = np.searchsorted(bounds["a"], a, "right")
            part = left.copy()
            for i in np.flatnonzero(right > left):
                part[i] += np.searchsorted(bounds["b"][left[i] : right[i]], b[i], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int64())], names=[*batch.schema.names, "part"])

    return run


def _sample(rows: DataFrame, rate) -> np.ndarray:
    """Keys drawn with probability size * rate; the same rows in every run."""
    draw = F.pmod(F.xxhash64("a", "b", F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    got = rows.where(draw < F.col("size") * rate).select("a", "b").toPandas()
    return _pairs(got["a"].to_numpy(), got["b"].to_numpy())


def assign_shards(docs: DataFrame, shards: int = SHARDS, range_bytes: int = RANGE_BYTES, samples: int = SAMPLES) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``.

    Columns: doc_id, size (UTF-8 bytes of the text and 16), text_crc32, law, shard
    (0 to ``shards`` - 1), slot (gapless from 0 in each shard), grown_shard (null).

    Edge cases: a null text has no bytes and the crc32 of nothing; null ids and
    repeated rows are rows like others; no row crosses shards for being equal to
    another unless its group exceeds 5% of a shard; an empty table gives an empty
    result; further columns are ignored.
    """
    with Scratch(docs.sparkSession) as scope:
        return _assigned(docs, scope, shards, range_bytes, samples)


def _assigned(docs: DataFrame, scope: Scratch, shards: int, range_bytes: int, samples: int) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    tie = F.xxhash64(F.monotonically_increasing_id(), F.lit(5)).bitwiseAND(0xFFFF)
    rows = scope.write(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64(F.col("text").isNull(), raw).alias("a"),
            F.xxhash64("doc_id", F.lit(11)).bitwiseAND(~0xFFFF).bitwiseOR(tie).alias("b"),
        ),
        "keys",
    )
    spark = docs.sparkSession
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = int(min(MAX_RANGES, max(4 * shards, -(-total // range_bytes))))
    splitters = choose_splitters(_sample(rows, F.lit(parts * samples / max(total, 1))), parts)
    schema = "doc_id long, size long, text_crc32 long, a long, b long, part long"
    full = 2.0 * total / parts
    for _ in range(4):
        ranged = rows.mapInArrow(_range_of(spark.sparkContext.broadcast(splitters)), schema)
        # One row a range, and their number is bounded by MAX_RANGES and its subdivisions.
        sums = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1")).toPandas().sort_values("part")
        over = sums[(sums.bytes > full) & (sums.n > 1) & ((sums.a0 < sums.a1) | (sums.b0 < sums.b1))]
        if over.empty:
            break
        rates = spark.createDataFrame([(int(r.part), float(samples * max(2, np.ceil(2 * r.bytes / full)) / r.bytes)) for r in over.itertuples()], "part long, rate double")
        drawn = ranged.join(F.broadcast(rates), "part")  # as many rows as overfull ranges
        draw = F.pmod(F.xxhash64("a", "b", F.lit(13)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        got = drawn.where(draw < F.col("size") * F.col("rate")).select("part", "a", "b").toPandas()
        more = [splitters]
        for part, keys in got.groupby("part"):
            pieces = int(max(2, np.ceil(2 * over.loc[over.part == part, "bytes"].iloc[0] / full)))
            more.append(choose_splitters(_pairs(keys["a"].to_numpy(), keys["b"].to_numpy()), pieces))
        grown = np.unique(np.concatenate(more))
        if len(grown) == len(splitters):
            break
        splitters = grown
    offsets = sums.assign(bytes0=sums.bytes.cumsum() - sums.bytes, rows0=sums.n.cumsum() - sums.n)
    starts = spark.createDataFrame([(int(r.part), int(r.bytes0), int(r.rows0)) for r in offsets.itertuples()], "part long, bytes0 long, rows0 long")

    in_range = Window.partitionBy("part").orderBy("a", "b", "doc_id", "size")
    group = Window.partitionBy("part", "a")
    placed = (
        ranged.withColumn("before", F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("nth", F.row_number().over(in_range) - 1)
        .withColumn("before", F.coalesce("before", F.lit(0)))
        .withColumn("group_bytes", F.sum("size").over(group))
        .withColumn("group_before", F.min("before").over(group))
        .join(F.broadcast(starts), "part")  # as many rows as ranges, see MAX_RANGES
    )
    whole = F.col("group_bytes") <= F.lit(max(1.0, SPLIT_OVER * total / shards))
    middle = F.col("bytes0") + F.when(whole, F.col("group_before") + F.col("group_bytes") / 2).otherwise(F.col("before") + F.col("size") / 2)
    placed = placed.select("doc_id", "size", "text_crc32", "part", (F.col("rows0") + F.col("nth")).alias("nth"), F.least(F.lit(shards - 1), F.floor(middle * shards / max(total, 1))).cast("int").alias("shard"))
    placed = scope.write(placed, "placed", keep=True, rows=rows.count())
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

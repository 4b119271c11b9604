"""Shared helpers of the training-data operators.

Scratch tables and their owners are those of ``sources.shared``.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import FILE_ROWS, Scratch, drop_path, owning, shared_root

__all__ = ["FILE_ROWS", "Scratch", "drop_path", "owning", "shared_root"]

#: Words of a text: runs of anything but space, tab, LF, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def neutral(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ... and the new name of each old one.

    Operators that add columns to whole rows work on this and restore the names at the
    end, so no name of the caller can clash with theirs.
    """
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), {c: f"c{i}" for i, c in enumerate(df.columns)}


#: Bits of a membership bitmap for each member, and at most: 8 MB, whatever the number.
MEMBER_BITS, BITMAP_BITS = 128, 1 << 26


def mark_possible_members(df: DataFrame, key: str, members: DataFrame, flag: str, bits: int | None = None) -> DataFrame:
    """``df`` with a boolean ``flag``: false only where ``key`` is not in ``members(key)``.

    One bit a key hash, kept in 4 kB rows that are broadcast: at most ``BITMAP_BITS / 8``
    bytes by construction, less for few members (``members`` is counted, so give a stored
    table).  With more keys than bits the flag is true more often and the exact join
    that must follow gets more rows; it never misses one.
    """
    if bits is None:
        bits = min(BITMAP_BITS, 1 << max(15, (members.count() * MEMBER_BITS).bit_length()))

    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(bits)) + 1

    bitmap = members.select(place(F.col(key)).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("__bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("__bits"))
    asked = df.withColumn("__p", place(F.col(key))).withColumn("__bucket", F.expr("bitmap_bucket_number(__p)"))
    held = asked.join(F.broadcast(bitmap), "__bucket", "left")
    bit = F.expr("shiftright(cast(conv(hex(substring(__bits, cast(bitmap_bit_position(__p) div 8 as int) + 1, 1)), 16, 10) as int), cast(bitmap_bit_position(__p) % 8 as int)) & 1")
    return held.withColumn(flag, F.coalesce(bit == 1, F.lit(False))).drop("__p", "__bucket", "__bits")


#: Keys with more than a HEAVY-th of all rows go to the rows: at most HEAVY of them can exist.
HEAVY = 1024


def join_skewed(rows: DataFrame, values: DataFrame, keys: list[str], count: str = "n_rows") -> DataFrame:
    """Inner join of ``rows`` with ``values``, one row a key, whose column ``count`` says how
    many of ``rows`` have it.

    A key with more than a HEAVY-th of all rows is broadcast, so its rows stay where they are;
    fewer than HEAVY keys can be as frequent.  The others are dealt out by key.  Give stored
    tables: both are read twice.  Keys must not be null.
    """
    total = values.agg(F.sum(count).alias("n")).first()["n"] or 0
    frequent = F.col(count) > total // HEAVY
    heavy, light = values.where(frequent), values.where(~frequent)
    return rows.join(F.broadcast(heavy), keys).unionByName(rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys))


def crc_bucket(column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


# --- hashing of word sequences (NumPy, whole document at a time) -------------

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)


def hash_words(words: Iterable[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], dtype=np.uint64)


def hash_windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each window of ``k`` consecutive words, in order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = np.full(n, (k * 0x9E3779B97F4A7C15 + 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for i in range(k):
        acc ^= hashes[i : i + n]
        acc *= _M1
        acc ^= acc >> np.uint64(29)
    acc *= _M2
    acc ^= acc >> np.uint64(32)
    return acc


def texts_of(batch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()

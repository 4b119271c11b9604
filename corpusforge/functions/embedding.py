"""Embedding providers.

A provider is a function of a text column that returns ``array<float>``; any pandas UDF
will do.  The default hashes tokens into buckets and needs no model.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 64
_BASIS, _PRIME, _MASK = 2166136261, 16777619, 0xFFFFFFFF
#: Bytes of lower-cased text with blanks for all that is in no token.
_TOKEN_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for c in range(256))


def fnv1a(token: Column) -> Column:
    """32-bit FNV-1a of an ASCII token."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c)) * F.lit(_PRIME)).bitwiseAND(F.lit(_MASK))
    return F.aggregate(F.split(token, ""), F.lit(_BASIS).cast("long"), step)


def token_weights(docs: DataFrame, key: str = "doc_id", text: str = "text", dim: int = DIM) -> DataFrame:
    """(key, bucket, weight) before normalising, by built-in functions only."""
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9_]{2,}"), F.lit(0))
    # Each occurrence adds its weight to its bucket before the shuffle, which sees no token.
    each = docs.select(key, F.explode(tokens).alias("token"))
    placed = each.select(key, F.pmod(fnv1a(F.col("token")), F.lit(dim)).cast("int").alias("bucket"), (1 + F.least(F.lit(4), F.floor(F.length("token") / 4))).alias("w"))
    return placed.groupBy(key, "bucket").agg(F.sum("w").cast("long").alias("weight"))


def _hash(token: str) -> int:
    h = _BASIS
    for c in token.encode():
        h = ((h ^ c) * _PRIME) & _MASK
    return h


class _Places(dict):
    """Bucket and weight of each token in one number, of some tokens kept; a single character weighs nothing."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: bytes) -> int:
        place = _hash(token.decode()) % self.dim << 3 | 1 + min(4, len(token) // 4) if len(token) > 1 else 0
        if len(self) < 200_000:
            self[token] = place
        return place


class HashingEmbedder:
    """Token hashing on one machine, for queries and inside tasks."""

    def __init__(self, dim: int = DIM, normalize: bool = True):
        self.dim, self.normalize, self.known = dim, normalize, _Places(dim)

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = (text or "").lower().encode("utf-8", "replace").translate(_TOKEN_BYTES).split()
        place = np.fromiter(map(self.known.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        v = np.bincount(place >> 3, weights=place & 7, minlength=self.dim)
        if self.normalize:
            size = float(np.sqrt((v * v).sum()))
            if size == 0:
                v[0] = 1
            else:
                v /= size
        return v.astype(np.float32)


def hashing_provider(dim: int = DIM, normalize: bool = True) -> Callable[[Column], Column]:
    """The default provider, an Arrow-batched UDF."""

    @F.pandas_udf(T.ArrayType(T.FloatType(), False))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = HashingEmbedder(dim, normalize)
        for texts in batches:
            yield pd.Series([one(t) for t in texts])

    return embed


class BreakerOpen(RuntimeError):
    """Too many texts failed one after the other; the model is at fault, not a text."""


def embed_with_status(df: DataFrame, make: Callable[[], Callable[[list[str]], list]], text: str = "text", batch: int = 64, fail_fast: int | None = None, retries: int = 0, wait_s: float = 0.1) -> DataFrame:
    """``df`` with a struct column ``embedding(vector, error, success)``.

    ``make`` is called once a Python worker (that is where a model is loaded) and gives a
    function of a list of texts.  A batch that fails is repeated text by text, so one bad
    text costs its own row only.  With ``fail_fast`` the task fails after so many failures
    without a success between them, instead of going through all texts with a dead model.
    A text that fails is tried ``retries`` times more, each after twice the wait; a task that
    dies is repeated by Spark (``spark.task.maxFailures``).
    """
    shape = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType(), False)), T.StructField("error", T.StringType()), T.StructField("success", T.BooleanType())])

    @F.pandas_udf(shape)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()

        failures = 0

        def one(t: str) -> tuple:
            nonlocal failures
            for again in range(retries + 1):
                try:
                    made = [float(x) for x in model([t])[0]], None, True
                except Exception as e:  # the row carries the error
                    if again < retries:
                        time.sleep(wait_s * 2**again)
                        continue
                    failures += 1
                    if fail_fast and failures >= fail_fast:
                        raise BreakerOpen(f"{failures} failures one after the other: {e}") from e
                    return None, str(e), False
                failures = 0
                return made

        for texts in batches:
            rows, all_texts = [], texts.tolist()
            for i in range(0, len(all_texts), batch):
                part = all_texts[i : i + batch]
                try:
                    rows += [([float(x) for x in v], None, True) for v in model(part)]
                    failures = 0
                except Exception:
                    rows += [one(t) for t in part]
            yield pd.DataFrame(rows, columns=["vector", "error", "success"])

    return df.withColumn("embedding", run(F.col(text)))

"""Language identification by rank-order profiles.

Cavnar and Trenkle, "N-Gram-Based Text Categorization" (1994): a language's profile
is the ranked list of its most frequent character n-grams; a document goes to the
language whose profile has the smallest sum of out-of-place distances to its own.

N-grams of one to three characters fit one 64-bit number (21 bits a code point), so
documents are counted with NumPy and learning sums plain numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_bucket, texts_of

#: n-grams of a profile, and the place given to one that a profile lacks.
PROFILE = 400
#: Documents that a language is learned from, about (a bounded sample by hash).
LEARN_DOCS = 6000
#: Distinct n-grams held by a learning task before it passes them on.
HELD = 500_000
UNKNOWN = "und"

_LETTERS = regex.compile(r"\p{L}+")


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the lower-cased letters and their counts.

    Words are parted and surrounded by one space; the space alone is no n-gram.
    """
    words = _LETTERS.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    codes, counts = np.unique(np.concatenate([c[c != 32], two, three]), return_counts=True)
    return codes, counts.astype(np.int64)


def rank(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams in order; equal counts by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:size]


class Profiles:
    """Profiles by language; languages in code point order."""

    def __init__(self, ranked: dict[str, list[int]], size: int):
        self.size, self.names, self.tables = size, sorted(ranked), []
        for name in self.names:
            codes = np.array(ranked[name], dtype=np.int64)
            order = np.argsort(codes)
            self.tables.append((codes[order], order.astype(np.int64)))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Sum of out-of-place distances to each language, over the greatest sum."""
        out = []
        for codes, places in self.tables:
            p = np.searchsorted(codes, own)
            p[p == len(codes)] = 0
            there = codes[p] == own
            gap = np.where(there, np.minimum(np.abs(places[p] - np.arange(len(own))), self.size), self.size)
            out.append(gap.sum() / (self.size * len(own)))
        return np.array(out)

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngrams(text)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        d = self.distances(rank(codes, counts, self.size))
        best = int(np.argmin(d))
        return self.names[best], float(min(1.0, max(0.0, 1.0 - d[best])))


_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of a task's documents by language, summed before the shuffle."""
    held: dict[str, list] = {}
    size = 0

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return codes, np.bincount(where, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

    def emit() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, counts = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], schema=_COUNTS)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes, counts = ngrams(text)
            held.setdefault(lang, []).append((codes, counts))
            size += len(codes)
            if size > HELD:
                held = {k: [merged(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > HELD // 2:
                    yield from emit()
                    held, size = {}, 0
    yield from emit()


def learn_profiles(docs: DataFrame, size: int = PROFILE, learn_docs: int = LEARN_DOCS) -> Profiles:
    """Profiles from ``docs(doc_id, text, lang)``; rows without lang are left out.

    Each language is learned from about ``learn_docs`` documents, drawn row by row at a rate
    that follows the language's row count: by a hash of id, text and the row's number in the
    scan, so rows that are equal are drawn one by one.  The same files give the same draw.
    The driver gets ``size`` rows a language.
    """
    labelled = docs.where("lang is not null").withColumn("_nth", F.monotonically_increasing_id())
    rows = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    if not rows:
        return Profiles({}, size)
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, learn_docs / n)) for k, n in rows.items()], "lang string, rate double")
    draw = F.pmod(F.xxhash64("doc_id", "text", "_nth", F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = labelled.join(F.broadcast(rates), "lang").where(draw < F.col("rate")).select("lang", "text")  # rates: one row a language
    counts = chosen.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("place", place).where(F.col("place") <= size).select("lang", "gram", "place").collect()
    ranked: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["place"])):
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, size)


def _predict(profiles):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = profiles.value
        for batch in batches:
            found = [table.predict(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema=schema)

    return run


def identify_languages(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang, ...)``: doc_id, held_out, lang_pred, score.

    Learned from rows whose crc32(doc_id as text) mod 4 is not 2 (the others are held
    out); predicted from the text alone.  score is 1 less the distance as part of the
    greatest possible one.

    Edge cases: a null text or one without a letter is ``und`` with score 0, and so is
    every text if no row has a lang; texts of equal distance go to the first language in
    code point order; repeated rows get equal results; a null doc_id counts as the empty
    text; an empty table gives an empty result; further columns are ignored.
    """
    held = crc_bucket("doc_id", 4) == 2
    profiles = learn_profiles(docs.where(~held).select("doc_id", "text", "lang"), **options)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")

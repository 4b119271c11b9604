"""Quality classifier: regularised quadratic discriminant over document statistics.

Friedman, "Regularized Discriminant Analysis" (1989): each class has a mean and a
covariance, the latter shrunk towards the pooled one and then towards a multiple of
the identity.  A document's score is the logistic of the difference of the two log
densities; Mahalanobis distances use the Cholesky factors, which are made once and
sent along with the means.

Learning needs first and second moments only.  They are summed in the tasks over all
labelled rows and then by a grouped sum; the driver gets some hundred numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_bucket, texts_of

#: Share of the pooled covariance in a class covariance, and of the identity in that.
POOLED, RIDGE = 0.1, 0.02
#: Fixed by contract.
THRESHOLD = 0.3
#: Log-density differences beyond this count as this.
CLIP = 30.0

FEATURES = (
    "log_words", "log_word_length", "word_length_spread", "symbols", "digits", "capitals", "non_ascii", "distinct_words", "repeated_triples",
    "repeated_lines", "log_line_words", "ended_words", "stuttered_words", "entropy", "top_word", "short_words",
)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"!?()-"]] = True
_DIGIT, _UPPER, _LOWER = (np.zeros(256, dtype=bool) for _ in range(3))
_DIGIT[48:58] = _UPPER[65:91] = _LOWER[97:123] = True


def document_statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text, in the order of FEATURES.

    Counts go through a logarithm and shares through the arcsine of the root, which
    brings both nearer to normal.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    chars = max(1, int(counts[33:].sum()))
    share = lambda x: float(np.arcsin(np.sqrt(min(1.0, max(0.0, x)))))
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=n) if n else np.zeros(1)
    lines = [x for x in (y.strip() for y in raw.split(b"\n")) if x]
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    triples = max(1, n - 2)
    p = counts[33:][counts[33:] > 0] / chars
    return [
        float(np.log1p(n)),
        float(np.log1p(sizes.mean())),
        float(np.log1p(sizes.std())),
        share(counts[_SYMBOL].sum() / chars),
        share(counts[_DIGIT].sum() / chars),
        share(counts[_UPPER].sum() / max(1, counts[_UPPER].sum() + counts[_LOWER].sum())),
        share(counts[128:].sum() / chars),
        share(len(distinct) / max(1, n)),
        share(1 - len(set(zip(words, words[1:], words[2:], strict=False))) / triples if n > 2 else 0.0),
        share(1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0),
        float(np.log1p(n / max(1, len(lines)))),
        share(sum(w[-1] in b".!?,;:" for w in words) / max(1, n)),
        share(sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n)),
        float(-(p * np.log(p)).sum()),
        share(max(distinct.values(), default=0) / max(1, n)),
        share(float((sizes <= 2).sum()) / max(1, n)),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [document_statistics(t) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "held_out", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and sums of products of each class, over all rows of a task."""
    p = len(FEATURES)
    total = {0: np.zeros((p + 1, p + 1)), 1: np.zeros((p + 1, p + 1))}
    for batch in batches:
        x = np.array(batch.column(0).to_pylist(), dtype=np.float64).reshape(-1, p)
        y = np.asarray(batch.column(1).to_pylist())
        one = np.hstack([np.ones((len(x), 1)), x])
        for c in total:
            part = one[y == c]
            total[c] += part.T @ part
    for c, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([c] * m.size, pa.int32()), pa.array(np.arange(m.size), pa.int32()), pa.array(m.ravel())], names=["c", "k", "v"])


class Discriminant:
    """Means and Cholesky factors of two classes in standardised coordinates."""

    def __init__(self, moments: dict[int, np.ndarray], pooled: float = POOLED, ridge: float = RIDGE):
        p = len(FEATURES)
        both = moments[0] + moments[1]
        n = both[0, 0]
        self.center = both[0, 1:] / max(1.0, n)
        spread = np.sqrt(np.maximum(np.diag(both)[1:] / max(1.0, n) - self.center**2, 0.0))
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        self.classes, covariances, counts = [], [], [moments[c][0, 0] for c in (0, 1)]
        #: With fewer than two classes there is nothing to compare: the share of class 1.
        self.constant = None if min(counts) >= 2 else (counts[1] + 0.5) / (n + 1.0)
        for c in (0, 1):
            m, k = moments[c], max(1.0, counts[c])
            mean = m[0, 1:] / k
            covariances.append((m[1:, 1:] / k - np.outer(mean, mean)) / np.outer(self.scale, self.scale))
            self.classes.append([(mean - self.center) / self.scale])
        shared = (covariances[0] * counts[0] + covariances[1] * counts[1]) / max(1.0, n)
        for c in (0, 1):
            s = (1 - pooled) * covariances[c] + pooled * shared
            s = (1 - ridge) * s + ridge * (np.trace(s) / p + 1e-6) * np.eye(p)
            factor = np.linalg.cholesky((s + s.T) / 2)
            self.classes[c] += [np.linalg.inv(factor), float(np.log(np.diag(factor)).sum() * -1 + np.log((counts[c] + 1) / (n + 2)))]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.center) / self.scale
        density = []
        for mean, inverse, offset in self.classes:
            d = (z - mean) @ inverse.T
            density.append(offset - 0.5 * (d * d).sum(axis=1))
        return 1.0 / (1.0 + np.exp(-np.clip(density[1] - density[0], -CLIP, CLIP)))


def fit(statistics: DataFrame, labels: DataFrame, **options) -> Discriminant:
    """A discriminant from ``statistics(doc_id, x)`` and ``labels(doc_id, quality)``.

    Labels other than 0 and 1 are left out; a document labelled twice counts twice.
    """
    p = len(FEATURES) + 1
    known = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("y"))
    sums = statistics.join(known, "doc_id").select("x", "y").mapInArrow(_moments, "c int, k int, v double").groupBy("c", "k").agg(F.sum("v").alias("v")).collect()
    moments = {c: np.zeros(p * p) for c in (0, 1)}
    for r in sums:
        moments[r["c"]][r["k"]] = r["v"]
    return Discriminant({c: m.reshape(p, p) for c, m in moments.items()}, **options)


def _scored(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
            score = model.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, held_out, score, predicted.

    Learned from labelled rows whose crc32(doc_id as text) mod 5 is not 0 (the others
    are held out); the score depends on the text alone.

    Edge cases: null and empty texts have statistics of zero and a score like others;
    repeated rows get equal scores; a null doc_id counts as the empty text and matches no
    label; without labels of both classes every score is the smoothed share of class 1;
    an empty table gives an empty result; further columns are ignored.
    """
    held = crc_bucket("doc_id", 5) == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    rows = Scratch(docs.sparkSession).write(rows.mapInArrow(_statistics, "doc_id long, held_out boolean, x array<double>"), "statistics", keep=True)
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.where("not held_out"), labels, **options))
    return rows.mapInArrow(_scored(model, threshold), "doc_id long, held_out boolean, score double, predicted int")

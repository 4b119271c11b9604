"""Compressed vectors: inverted lists of product-quantised residuals.

A vector is coded as its list and, for each of a few stretches of its dimensions, the nearest of
CODES codewords to what the list's centroid leaves of it.  A dot product with a query is then the
query's product with the centroid plus one looked-up number a stretch, whatever the list, so the
scan of the probed lists reads a byte a stretch and adds up numbers of literal tables.  The best
rows by that estimate are scored exactly from the chunk table, by id.

Centroids and codewords are learned on a bounded sample; every row is coded.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import pointer_names, publish_pointer
from .ann import LEAST_ROWS, ROUNDS, SAMPLE, SAMPLE_A_LIST, fewest_probes, train_centroids
from .search import comparable, semantic_score
from .substring import by_id

#: Codewords of a stretch, so a code is a byte; dimensions of a stretch.
CODES, STRETCH = 256, 4
#: Rows that are scored exactly for each row of the answer, and at most.
RERANK, MOST_RERANKED = 20, 1000
VERSION = 1


@dataclass
class PqMeta:
    version: int
    model: str
    dim: int
    count: int
    lists: int
    nprobe: int


def train_codewords(residuals: np.ndarray, codes: int = CODES, seed: int = 11) -> np.ndarray:
    """k-means of one stretch: (codes, dimensions).  Codewords beyond the distinct rows repeat."""
    rng = np.random.default_rng(seed)
    words = residuals[rng.choice(len(residuals), codes, replace=len(residuals) < codes)].copy()
    for _ in range(ROUNDS):
        near = nearest(residuals, words)
        sums = np.zeros_like(words)
        np.add.at(sums, near, residuals)
        n = np.bincount(near, minlength=codes)[:, None]
        words = np.where(n > 0, sums / np.maximum(n, 1), words)
    return words


def nearest(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of the nearest codeword of each row."""
    return np.argmin((words**2).sum(axis=1)[None, :] - 2 * rows @ words.T, axis=1)


def stretches(dim: int) -> list[tuple[int, int]]:
    return [(a, min(a + STRETCH, dim)) for a in range(0, dim, STRETCH)]


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, words = shared.value
        for batch in batches:
            rows = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(-1, centers.shape[1])
            near = np.argmax(rows @ centers.T, axis=1) if len(rows) else np.empty(0, dtype=np.int64)
            left = rows - centers[near]
            # Bytes from -128 on, as Spark's are signed.
            codes = [pa.array((nearest(left[:, a:b], w) - 128).astype(np.int8)) for (a, b), w in zip(stretches(centers.shape[1]), words, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), *codes], names=["chunk_id", "list_no", *(f"q{j}" for j in range(len(codes)))])

    return run


def _numbers(values: np.ndarray) -> Column:
    """An array literal, folded from one text: one call instead of one for each number."""
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")


#: Neighbours whose lists decide how many are probed, and rows of the sample that ask for theirs.
NEAREST, ASKING = 10, 128
#: Share of those neighbours that lies in the lists counted, and how many times so many are probed:
#: the asking rows lie in a list themselves, other queries need more, and the codes lose some.
IN_LISTS, MARGIN = 0.995, 2


def _neighbours(shared):
    """Rows (query, score, list_no): each query's NEAREST best rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, centers = shared.value
        scores, lists = np.empty((len(probe), 0)), np.empty((len(probe), 0), dtype=np.int64)
        for batch in batches:
            rows = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(-1, centers.shape[1])
            scores = np.hstack([scores, probe @ rows.T])
            lists = np.hstack([lists, np.broadcast_to(np.argmax(rows @ centers.T, axis=1), (len(probe), len(rows)))]) if len(rows) else lists
            best = np.argsort(-scores, axis=1, kind="stable")[:, :NEAREST]
            scores, lists = np.take_along_axis(scores, best, axis=1), np.take_along_axis(lists, best, axis=1)
        if scores.size:
            query = np.repeat(np.arange(len(probe)), scores.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(scores.ravel()), pa.array(lists.ravel().astype(np.int32))], names=["query", "score", "list_no"])

    return run


def probes_needed(rows: DataFrame, vectors: np.ndarray, centers: np.ndarray, recall: float) -> int:
    """Fewest lists by which some vectors of the sample find ``recall`` of their nearest of all rows.

    Those of the sample alone are farther off where it is thin, and would ask for too many lists.
    """
    probe = vectors[np.linspace(0, len(vectors) - 1, min(ASKING, len(vectors))).astype(int)]
    found = rows.mapInArrow(_neighbours(rows.sparkSession.sparkContext.broadcast((probe, centers))), "query int, score double, list_no int")  # 4096 centroids at most
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "list_no"))  # NEAREST rows a task
    best = found.withColumn("_n", nth).where(F.col("_n") <= NEAREST).select("query", "list_no").toArrow()
    if not best.num_rows:
        return 1
    places = np.argsort(np.argsort(-(probe @ centers.T), axis=1, kind="stable"), axis=1, kind="stable")
    return fewest_probes(places[best["query"].to_numpy(), best["list_no"].to_numpy()], recall)


class PqIndex:
    """Codes of one chunk table below ``path``; vectors stay in the chunk table."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, words: list[np.ndarray], meta: PqMeta):
        self.rows, self.centroids, self.words, self.meta = rows, centroids, words, meta

    @classmethod
    def build(cls, chunks: DataFrame, path: str, lists: int | None = None, nprobe: int | None = None, model: str = "hashing") -> PqIndex:
        """From ``chunks(chunk_id, vector)``, unit vectors of one length; published by pointer."""
        spark = chunks.sparkSession
        first = chunks.where("vector is not null").select(F.size("vector").alias("d")).first()
        dim = first["d"] if first else 1
        rows = comparable(chunks, dim).select("chunk_id", "vector")
        count = rows.count()
        lists = lists or max(1, min(4096, int(round(count**0.5)), -(-count // LEAST_ROWS)))
        sample = max(SAMPLE, SAMPLE_A_LIST * lists)
        part = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1_000_003)) < F.lit(int(1_000_003 * min(1.0, sample / max(1, count))) + 1))
        vectors = np.array([r["vector"] for r in part.select("vector").toLocalIterator()], dtype=np.float64).reshape(-1, dim)
        if not len(vectors):
            vectors = np.zeros((1, dim))
        centers = train_centroids(vectors, lists)
        left = vectors - centers[np.argmax(vectors @ centers.T, axis=1)]
        words = [train_codewords(left[:, a:b]) for a, b in stretches(dim)]
        meta = PqMeta(VERSION, model, dim, count, len(centers), nprobe or min(len(centers), MARGIN * probes_needed(rows, vectors, centers, IN_LISTS)))
        codes = "".join(f", q{j} tinyint" for j in range(len(words)))
        name = uuid.uuid4().hex
        coded = rows.mapInArrow(_encode(spark.sparkContext.broadcast((centers, words))), f"chunk_id long, list_no int{codes}")  # 4096 centroids at most
        coded.repartition("list_no").sortWithinPartitions("list_no", "chunk_id").write.partitionBy("list_no").parquet(f"{path}/codes-{name}")
        plain = lambda m: [[float(x) for x in r] for r in m]
        spark.createDataFrame([(json.dumps(asdict(meta)), plain(centers), [plain(w) for w in words])], "meta string, centroids array<array<double>>, words array<array<array<double>>>").coalesce(1).write.parquet(f"{path}/meta-{name}")
        publish_pointer(spark, f"{path}/pointers", name)
        return cls.load(spark, path, model, dim)

    @classmethod
    def load(cls, spark: SparkSession, path: str, model: str, dim: int) -> PqIndex | None:
        """The stored index, or None if there is none, or version, model or dimension differ."""
        names = pointer_names(spark, f"{path}/pointers")
        if not names:
            return None
        name = names[-1].split("-", 1)[1]
        row = spark.read.parquet(f"{path}/meta-{name}").first()
        meta = PqMeta(**json.loads(row["meta"]))
        if (meta.version, meta.model, meta.dim) != (VERSION, model, dim):
            return None
        words = [np.array(w) for w in row["words"]]
        codes = "".join(f", q{j} tinyint" for j in range(len(words)))
        return cls(spark.read.schema(f"chunk_id long{codes}, list_no int").parquet(f"{path}/codes-{name}"), np.array(row["centroids"]), words, meta)

    def estimate(self, query: np.ndarray) -> Column:
        """Estimated dot product of a coded row."""
        total = F.get(_numbers(self.centroids @ query), F.col("list_no"))
        for j, ((a, b), w) in enumerate(zip(stretches(self.meta.dim), self.words, strict=True)):
            total = total + F.get(_numbers(w @ query[a:b]), F.col(f"q{j}").cast("int") + 128)
        return total

    def nominees(self, query, n: int) -> DataFrame:
        """(chunk_id, estimate) of the ``n`` best rows of the probed lists; reads codes only."""
        q = np.asarray(query, dtype=np.float64)
        probed = [int(i) for i in np.argsort(-(self.centroids @ q), kind="stable")[: self.meta.nprobe]]
        return self.rows.where(F.col("list_no").isin(probed)).select("chunk_id", self.estimate(q).alias("estimate")).orderBy(F.desc("estimate"), "chunk_id").limit(n)

    def search(self, query, k: int, chunks: DataFrame) -> DataFrame:
        """(chunk_id, similarity) of the ``k`` best rows, by exact scores of the best by estimate.

        Ids that ``chunks`` no longer has fall out; a query of another length finds nothing.
        """
        if len(query) != self.meta.dim:
            return chunks.select("chunk_id", F.lit(0.0).alias("similarity")).limit(0)
        ids = [r["chunk_id"] for r in self.nominees(query, max(k, min(RERANK * k, MOST_RERANKED))).collect()]
        return comparable(by_id(chunks, ids), self.meta.dim).select("chunk_id", semantic_score(query).alias("similarity")).orderBy(F.desc("similarity"), "chunk_id").limit(k)

"""Approximate nearest neighbours: an inverted file of k-means lists.

Centroids are trained on a bounded sample; every vector is assigned to its nearest one and
stored in that list.  A search reads the ``nprobe`` lists nearest to the query (partition
pruning where the table is stored by list) and ranks their vectors exactly.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..sources.shared import pointer_names, publish_pointer
from .search import comparable, semantic_score

#: Vectors that centroids are trained on, at most about; rounds of training.
SAMPLE, ROUNDS = 20_000, 12
#: Sampled vectors a list, where that is more; it bounds the sample at 65,536.
SAMPLE_A_LIST = 16
#: Parts that additions may leave before the lists are built anew.
MOST_PARTS = 32
#: Vectors that are compared with all centroids at once.
ASSIGNED = 1000
#: Share of the exact neighbours that the default effort finds in the sample.
RECALL = 0.95
#: Rows of a list at least, on average, and of one file of a list, about.
LEAST_ROWS, LIST_ROWS = 500, 1_000_000
VERSION = 2


@dataclass
class AnnMeta:
    version: int
    model: str
    metric: str
    dim: int
    count: int
    lists: int
    nprobe: int
    capacity: int = 0
    #: Folders of the stored lists: the build's and one an addition.
    parts: list = field(default_factory=list)
    #: Greatest chunk id that the index has.
    last_id: int = -1


def capacity(count: int) -> int:
    """Rows for which the lists of ``count`` rows still do; beyond it they are trained anew."""
    return max(count, -(-count * 6 // 5), count + 1024)


def train_centroids(vectors: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(vectors)))
    centers = vectors[rng.choice(len(vectors), lists, replace=False)].astype(np.float64)
    for _ in range(ROUNDS):
        near = np.argmax(vectors @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 0, sums / np.where(size > 0, size, 1), centers)
    return centers


def enough_probes(vectors: np.ndarray, centers: np.ndarray, k: int = 10, recall: float = RECALL, queries: int = 128) -> int:
    """Fewest lists by which searches of the sample find ``recall`` of their exact top ``k``."""
    probe = vectors[np.linspace(0, len(vectors) - 1, min(queries, len(vectors))).astype(int)]
    home = np.argmax(vectors @ centers.T, axis=1)
    places = np.argsort(np.argsort(-(probe @ centers.T), axis=1, kind="stable"), axis=1, kind="stable")
    best = np.argsort(-(probe @ vectors.T), axis=1, kind="stable")[:, :k]
    return fewest_probes(np.take_along_axis(places, home[best], axis=1).ravel(), recall)


def fewest_probes(reached: np.ndarray, recall: float) -> int:
    """Fewest lists that hold ``recall`` of the neighbours whose lists are in these places."""
    reached = np.sort(reached)
    return int(reached[min(len(reached) - 1, int(np.ceil(recall * len(reached))))]) + 1


def _read_parts(spark, path: str, parts: list[str]) -> DataFrame:
    read = [spark.read.schema("chunk_id long, vector array<float>, list_no int").parquet(f"{path}/{p}") for p in parts]
    out = read[0]
    for df in read[1:]:
        out = out.union(df)
    return out


def _assign(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value
        for batch in batches:
            rows = np.asarray(batch.column(at).flatten(), dtype=np.float64).reshape(-1, centers.shape[1])
            near = np.concatenate([np.empty(0), *(np.argmax(rows[a : a + ASSIGNED] @ centers.T, axis=1) for a in range(0, len(rows), ASSIGNED))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32), pa.int32())], names=[*batch.schema.names, "list_no"])

    return run


class IvfIndex:
    """Lists of one chunk table; build once, search often, add without retraining."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, meta: AnnMeta, path: str | None = None):
        self.rows, self.centroids, self.meta, self.path = rows, centroids, meta, path

    @classmethod
    def build(cls, chunks: DataFrame, lists: int | None = None, nprobe: int | None = None, model: str = "hashing", path: str | None = None, sample: int = SAMPLE) -> IvfIndex:
        """From ``chunks(chunk_id, vector)``; with ``path`` the lists are stored as partitions.

        ``sample`` bounds the vectors that reach the driver; every row is indexed.  Without
        ``nprobe`` the effort is what the sample needs for a recall of RECALL.
        """
        first = chunks.where("vector is not null").select(F.size("vector").alias("d")).first()
        dim = first["d"] if first else 0
        rows = comparable(chunks, dim).select("chunk_id", "vector")
        count, last = rows.agg(F.count("*"), F.max("chunk_id")).first()
        lists = lists or max(1, min(4096, int(round(count**0.5)), -(-count // LEAST_ROWS)))
        sample = max(sample, SAMPLE_A_LIST * lists)
        part = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1_000_003)) < F.lit(int(1_000_003 * min(1.0, sample / max(1, count))) + 1))
        drawn = part.select("vector").toArrow().column(0).combine_chunks()
        vectors = np.asarray(drawn.flatten(), dtype=np.float64).reshape(-1, max(1, dim))
        if not len(vectors):
            vectors = np.zeros((1, max(1, dim)))
        centers = train_centroids(vectors, lists)
        meta = AnnMeta(VERSION, model, "cosine", dim, count, len(centers), nprobe or enough_probes(vectors, centers), capacity(count), [], -1 if last is None else last)
        return cls(cls._placed(rows, centers), centers, meta)._stored(path)

    @staticmethod
    def _placed(rows: DataFrame, centers: np.ndarray) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(centers)  # at most 4096 centroids
        return rows.select("chunk_id", "vector").mapInArrow(_assign(shared, 1), "chunk_id long, vector array<float>, list_no int")

    def _stored(self, path: str | None) -> IvfIndex:
        """Lists as partitions below ``path``: a list's rows are brought together before, in
        as many tasks as a large list needs, so there are few files a list.

        The rows are a part of their own; metadata and centroids follow, and at last a pointer
        names them.  Readers see the index before or after, never between.
        """
        if path is None:
            return self
        spark, name = self.rows.sparkSession, uuid.uuid4().hex
        parts = 1 + self.meta.count // (self.meta.lists * LIST_ROWS)
        placed = self.rows.withColumn("_part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts))).repartition("list_no", "_part").drop("_part")
        placed.write.partitionBy("list_no").parquet(f"{path}/lists-{name}")
        meta = AnnMeta(**asdict(self.meta) | {"parts": [*self.meta.parts, f"lists-{name}"]})
        spark.createDataFrame([(json.dumps(asdict(meta)), [[float(x) for x in c] for c in self.centroids])], "meta string, centroids array<array<double>>").coalesce(1).write.parquet(f"{path}/meta-{name}")
        publish_pointer(spark, f"{path}/pointers", name)
        return IvfIndex(_read_parts(spark, path, meta.parts), self.centroids, meta, path)

    @classmethod
    def load(cls, spark, path: str, model: str, dim: int) -> IvfIndex | None:
        """The stored index, or None if there is none, or version, model or dimension differ."""
        names = pointer_names(spark, f"{path}/pointers")
        if not names:
            return None
        row = spark.read.parquet(f"{path}/meta-{names[-1].split('-', 1)[1]}").first()
        found = json.loads(row["meta"])
        if (found["version"], found["model"], found["dim"], found["metric"]) != (VERSION, model, dim, "cosine"):
            return None
        meta = AnnMeta(**found)
        return cls(_read_parts(spark, path, meta.parts), np.array(row["centroids"]), meta, path)

    def add(self, chunks: DataFrame) -> IvfIndex | None:
        """Further rows go to their nearest lists; centroids stay.  Ids that the index has
        already are left out.  None if the rows go beyond the index's capacity, or additions
        have left many parts: build anew."""
        rows = comparable(chunks, self.meta.dim).select("chunk_id", "vector").dropDuplicates(["chunk_id"]).join(self.rows.select("chunk_id"), "chunk_id", "left_anti")
        n, last = rows.agg(F.count("*"), F.max("chunk_id")).first()
        if self.meta.count + n > self.meta.capacity or len(self.meta.parts) >= MOST_PARTS:
            return None
        if n == 0:
            return self
        placed = self._placed(rows, self.centroids)
        meta = AnnMeta(**asdict(self.meta) | {"count": self.meta.count + n, "last_id": max(self.meta.last_id, last)})
        if self.path:
            return IvfIndex(placed, self.centroids, meta)._stored(self.path)
        return IvfIndex(self.rows.unionByName(placed), self.centroids, meta)

    def set_effort(self, nprobe: int) -> None:
        """Lists read by a search, 1 to 1000 and no more than there are."""
        if not 1 <= nprobe <= 1000:
            raise ValueError("effort must be from 1 to 1000")
        self.meta.nprobe = min(nprobe, self.meta.lists)

    def search(self, query, k: int) -> DataFrame:
        """(chunk_id, similarity) of the ``k`` best rows in the probed lists."""
        q = np.asarray(query, dtype=np.float64)
        if len(q) != self.meta.dim:
            return self.rows.select("chunk_id", F.lit(0.0).alias("similarity")).limit(0)
        probed = [int(i) for i in np.argsort(-(self.centroids @ q), kind="stable")[: self.meta.nprobe]]
        hit = self.rows.where(F.col("list_no").isin(probed)).select("chunk_id", semantic_score(q).alias("similarity"))
        return hit.orderBy(F.desc("similarity"), "chunk_id").limit(k)

    def candidates(self, query, k: int, least: int = 50, most: int = 200, multiplier: float = 20) -> DataFrame:
        """Ids for the search operators, as many as the candidate formula says."""
        return self.search(query, V.candidates(k, self.meta.count, least, most, multiplier)).select("chunk_id")

    def stats(self) -> DataFrame:
        """One row: the metadata with rows of the smallest and largest list."""
        sizes = self.rows.groupBy("list_no").agg(F.count("*").alias("n")).agg(F.min("n").alias("smallest_list"), F.max("n").alias("largest_list"))
        return sizes.select(*[F.lit(v).alias(k) for k, v in asdict(self.meta).items() if k != "parts"], "smallest_list", "largest_list")


def should_build(count: int, dim: int, enabled: bool = True, least: int = 5000) -> bool:
    """Whether an index is worth it; below ``least`` rows a full scan is used."""
    return enabled and dim > 0 and count >= least

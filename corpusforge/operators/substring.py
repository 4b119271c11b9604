"""Exact substrings by an index of trigrams.

Every place of a text begins a trigram (texts are padded at their end), and each trigram has
postings: the ids of the chunks that hold it.  A query's chunks hold all of its trigrams, so
the rarest lists are intersected, and only what is left is compared with the query.  A query
of one or two characters is the beginning of a trigram, so it finds its lists by range.

Postings are stored in order of the trigram, in rows of at most PART ids, so a trigram that
stands in every chunk is many rows and no value, group or task grows with the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import Scratch, pointer_names, publish_pointer

#: Ids that share one posting row at most: those of equal ``chunk_id // PART``.
PART = 1 << 15
#: Lists that are intersected, trigrams of a query that are looked at, and ids that go into a
#: filter of the scan; more are joined.
LISTS, ASKED, LITERAL = 4, 64, 1000
#: Rows of postings of one file, about; it is sorted, so a list is a few row groups.
FILE_POSTINGS = 2_000_000
#: Neighbouring ids whose chunks one task lists, so its lists are long; places of text that it
#: brings together before it passes their postings on, and rows that it passes on at once.
PIECE_IDS, HELD_POSTINGS, ROWS_A_BATCH = 1 << 12, 4_000_000, 10_000
#: Parts that additions may leave before a new build is due.
MOST_PARTS = 32
PAD = "\x00"

_SCHEMA = "gram string, part long, ids array<int>"


def grams(text: str) -> set[str]:
    """Trigrams that begin at each place of ``text``."""
    padded = text + PAD * 2
    return {padded[i : i + 3] for i in range(len(text))}


def _list_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks to rows (gram, part, ids), those of HELD_POSTINGS places brought together at a time.

    A place is one number: the ranks of its three characters among those held, then its chunk.
    Sorted, equal numbers are one posting, and postings are in order of gram and id.
    """
    ids, texts = [], []

    def flush() -> Iterator[pa.RecordBatch]:
        by = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
        used = np.zeros(0x110000, dtype=bool)
        for text in texts:
            used[text] = True
        chars, rank = np.flatnonzero(used).astype("<u4"), np.cumsum(used) - 1
        bits = max(1, int(len(chars) - 1).bit_length())
        room = 1 << (63 - 3 * bits)  # chunks that the number has place for; of very many characters few
        for a in range(0, len(by), room):
            yield from listed(by[a : a + room], chars, rank, bits)
        ids.clear(), texts.clear()

    def listed(by: np.ndarray, chars: np.ndarray, rank: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
        at, sizes = np.array(ids, dtype=np.int64)[by], np.array([len(texts[i]) for i in by])
        code, low = rank[np.concatenate([texts[i] for i in by])], 63 - 3 * bits
        place = (((code[:-2] << bits | code[1:-1]) << bits | code[2:]) << low) | np.repeat(np.arange(len(by)), sizes)[:-2]
        begins = np.ones(len(code), dtype=bool)  # no gram begins in the padding
        end = np.cumsum(sizes)
        begins[end - 1] = begins[end - 2] = False
        place = np.sort(place[begins[:-2]])
        place = place[np.append(True, place[1:] != place[:-1])]
        gram, at = place >> low, at[place & ((1 << low) - 1)]
        part = at // PART
        start = np.flatnonzero(np.append(True, (np.diff(gram) != 0) | (np.diff(part) != 0)))
        place = pa.array((at - part * PART).astype(np.int32))
        for a in range(0, len(start), ROWS_A_BATCH):
            first = start[a : a + ROWS_A_BATCH]
            end = start[a + ROWS_A_BATCH] if a + ROWS_A_BATCH < len(start) else len(at)
            g, mask = gram[first], (1 << bits) - 1
            names = np.stack([chars[g >> 2 * bits], chars[g >> bits & mask], chars[g & mask]], axis=1).tobytes().decode("utf-32-le")
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, end).astype(np.int32) - np.int32(first[0])), place.slice(first[0], end - first[0]))
            yield pa.RecordBatch.from_arrays([pa.array([names[i : i + 3] for i in range(0, len(names), 3)], pa.string()), pa.array(part[first]), lists], names=["gram", "part", "ids"])

    held = 0
    for batch in batches:
        for chunk_id, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py()
            if not text:
                continue
            texts.append(np.frombuffer((text + PAD * 2).encode("utf-32-le"), dtype="<u4"))
            ids.append(chunk_id.as_py())
            held += len(text)
            if held >= HELD_POSTINGS:
                yield from flush()
                held = 0
    if held:
        yield from flush()


class SubstringIndex:
    """Postings of a chunk table, in parts below ``path``: the build's and one an addition."""

    def __init__(self, spark: SparkSession, path: str, parts: list[str], last_id: int):
        self.spark, self.path, self.parts, self.last_id = spark, path, parts, last_id

    @classmethod
    def build(cls, chunks: DataFrame, path: str) -> SubstringIndex:
        """From ``chunks(chunk_id, content)``; published by pointer once it is complete."""
        return cls(chunks.sparkSession, path, [], -1)._store(chunks)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SubstringIndex | None:
        names = pointer_names(spark, f"{path}/pointers")
        if not names:
            return None
        meta = json.loads(spark.read.text(f"{path}/meta-{names[-1].split('-', 1)[1]}").first()[0])
        return cls(spark, path, meta["parts"], meta["last_id"])

    def add(self, chunks: DataFrame) -> SubstringIndex | None:
        """With the chunks whose id is greater than any before; None if there are many parts."""
        return None if len(self.parts) >= MOST_PARTS else self._store(chunks.where(F.col("chunk_id") > self.last_id))

    def _store(self, chunks: DataFrame) -> SubstringIndex:
        rows = chunks.select("chunk_id", F.lower("content").alias("content"))
        n, last = chunks.agg(F.count("*"), F.max("chunk_id")).first()
        if last is None and self.parts:
            return self
        name = uuid.uuid4().hex
        pieces = max(1, -(-n // PIECE_IDS))
        near = rows.repartitionById(pieces, F.pmod(F.floor(F.col("chunk_id") / PIECE_IDS), F.lit(pieces)).cast("int"))
        with Scratch(self.spark) as scope:
            lists = scope.write(near.mapInArrow(_list_grams, _SCHEMA), "grams")  # once, as ranges are drawn from it first
            # By range, so that a list lies together; AQE makes the files of even size.
            lists.repartitionByRange(F.col("gram"), F.col("part")).sortWithinPartitions("gram", "part").write.option("maxRecordsPerFile", FILE_POSTINGS).parquet(f"{self.path}/postings-{name}")
        made = SubstringIndex(self.spark, self.path, [*self.parts, f"postings-{name}"], self.last_id if last is None else last)
        self.spark.createDataFrame([(json.dumps({"parts": made.parts, "last_id": made.last_id}),)], "meta string").coalesce(1).write.text(f"{self.path}/meta-{name}")
        publish_pointer(self.spark, f"{self.path}/pointers", name)
        return made

    def postings(self) -> DataFrame:
        out = None
        for part in self.parts:
            read = self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/{part}")
            out = read if out is None else out.union(read)
        return out

    def candidates(self, query: str) -> DataFrame:
        """(chunk_id): a superset of the chunks that hold ``query``, by its rarest trigrams."""
        needle = self.spark.range(1).select(F.lower(F.lit(query)).alias("q")).first()[0]  # as the engine lowers it
        postings = self.postings()
        place = (F.col("part") * PART + F.col("id")).alias("chunk_id")
        if len(needle) < 3:
            found = postings.where(F.col("gram").startswith(needle)) if needle else postings
            return found.select("part", F.explode("ids").alias("id")).select(place).distinct()
        asked = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})[:ASKED]
        held = postings.where(F.col("gram").isin(asked)).groupBy("gram").agg(F.sum(F.size("ids")).alias("n"))
        sizes = {r["gram"]: r["n"] for r in held.collect()}  # ASKED rows at most
        if len(sizes) < len(asked):
            return self.spark.createDataFrame([], "chunk_id long")
        rare = sorted(asked, key=lambda g: (sizes[g], g))[:LISTS]
        listed = postings.where(F.col("gram").isin(rare)).select("part", F.explode("ids").alias("id"))
        # A gram has an id once in a part and each id is in one part, so the number of rows counts lists.
        return listed.groupBy("part", "id").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select(place)

    def search(self, query: str, chunks: DataFrame) -> DataFrame:
        """Rows of ``chunks`` that hold ``query``, letter case ignored.

        Few candidates become a filter of the scan, so it skips what has none of them; many
        are joined by id.
        """
        found = self.candidates(query)
        some = [r[0] for r in found.limit(LITERAL + 1).collect()]
        if len(some) <= LITERAL:
            rows = by_id(chunks, some)
        else:
            rows = chunks.join(found, "chunk_id", "left_semi")
        return rows.where(T.exact_match("content", F.lit(query)))


#: Ids that are compared one by one, so that the scan can ask its Bloom filters.
FEW = 32


def by_id(chunks: DataFrame, ids: list[int], key: str = "chunk_id") -> DataFrame:
    """Rows of ``chunks`` with one of ``ids``; unknown ids give none.

    Few ids are equalities, which Parquet's Bloom filters of ``key`` answer row group by row
    group; more are a range and a set.
    """
    if not ids:
        return chunks.limit(0)
    if len(ids) > FEW:
        return chunks.where(F.col(key).isin(ids) & F.col(key).between(min(ids), max(ids)))
    test: Column = F.col(key) == ids[0]
    for i in ids[1:]:
        test = test | (F.col(key) == i)
    return chunks.where(test)

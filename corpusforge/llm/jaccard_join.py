"""N-gram Jaccard join: T-occurrence search over inverted lists (DivideSkip).

Two documents link when the Jaccard similarity of their sets of distinct word
shingles is at least ``num/den``.  The search follows Li, Lu and Lu, "Efficient
Merging and Filtering Algorithms for Approximate String Searches" (2008): a
query's inverted lists are divided into short ones, which are heap-merged, and
long ones, which are only probed by binary search; documents whose occurrence
count reaches the required overlap T are retained.

Plan
----
1. One pass over the texts makes, for each document, its set of 64-bit shingle
   hashes, a 128-bit digest of the set and the ``SKETCH`` smallest hashes.
   Documents of equal sets become one class, so copies cost one row each.
2. The same division is made across the cluster.  Of two linked documents the
   sketches share at least c hashes (see ``required_overlap``), so each document
   may leave its c - 1 longest inverted lists out; the shared passages that very
   many documents have are those lists.  The lists left over name a leader, and
   the documents of one leader form a block.  Any two linked documents meet in
   one block at least.
3. A block is searched by DivideSkip on full shingle sets, with exact overlap.  Its
   leader is the first query; those linked to it are one component and need no
   comparison among themselves.  The others (stragglers) are the further queries.  A
   large block is dealt out in chunks of bounded size; documents that are not in its
   leader's component by then are dealt out in chunks too, and each chunk of them is
   searched in each chunk of the block, so no task holds more than two chunks.  Where
   they are many (documents that share a long passage but are not alike), the
   documents of large blocks first go through steps 2 and 3 once more with sketches of
   512 hashes, of which 289 may be left out (or three quarters, in documents of up to
   385 shingles).
4. Links form components by alternating stars.

No all-pairs output is ever made: a block yields spanning links only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hash_windows, hash_words, mark_possible_members, neutral, texts_of
from .components import connected_components

SHINGLE = 5
#: Hashes in a document's sketch.
SKETCH = 64
#: Classes and shingles of one chunk of a block, about.
CHUNK_ROWS = 2000
CHUNK_SHINGLES = 1_500_000
#: Hashes in the sketches by which documents of large blocks are dealt out anew, and the
#: copies of stragglers, for each document of a large block, from which on that is done.
DEEP_SKETCH, DIRECT_WORK = 512, 8.0
#: Postings that a heap merges; longer inputs are merged by counting, with equal results.
SMALL_MERGE = 512
#: Binary probes made at once.
PROBES = 1 << 20
#: Parts among which the rows of one leader are dealt out where they are joined by it.
SALTS = 64


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, no words none."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(hash_windows(hash_words(words), min(k, len(words))))


def required_overlap(num: int, den: int, sketch: int) -> int:
    """Hashes that the sketches of two linked documents share at least.

    The smallest ``sketch`` hashes of the union are a random sample of it, each of
    them common with probability J or more, and every common one is in both
    sketches.  The bound holds but for a probability below 2**-64 a pair, which is
    that of two shingles having the same hash.
    """
    j, tail, c = num / den, 0.0, 0
    while c < sketch:
        tail += comb(sketch, c) * j**c * (1 - j) ** (sketch - c)
        if tail > 2.0**-64:
            break
        c += 1
    return max(1, c)


def heap_merge(lists: list[list[int]]) -> Iterator[tuple[int, int]]:
    """(id, number of lists that have it) of ascending lists, in order of ids."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while heap:
        top, count = heap[0][0], 0
        while heap and heap[0][0] == top:
            _, i, at = heap[0]
            count += 1
            if at + 1 < len(lists[i]):
                heapq.heapreplace(heap, (lists[i][at + 1], i, at + 1))
            else:
                heapq.heappop(heap)
        yield top, count


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    p = np.searchsorted(b, a)
    p[p == len(b)] = 0
    return int((b[p] == a).sum())


class _Block:
    """Documents of one chunk with their full sets, and the links found among them."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.query: list[bool] = []
        self.links: list[tuple[int, int]] = []

    def add(self, cid: int, values: np.ndarray, query: bool = False) -> None:
        self.ids.append(cid)
        self.sets.append(values)
        self.query.append(query)

    def _join(self, a: int, b: int) -> None:
        old, new = self.label[a], self.label[b]
        if old != new:
            self.label[self.label == old] = new
            self.links.append((self.ids[a], self.ids[b]))

    def _invert(self) -> None:
        """Inverted lists: postings sorted by shingle, then document."""
        self.sizes = np.array([len(s) for s in self.sets])
        tokens = np.concatenate(self.sets)
        owners = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.argsort(tokens, kind="stable")  # owners stay ascending in a list
        self.owners = owners[order]
        tokens = tokens[order]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        self.tokens, self.start = tokens[first], first
        self.count = np.diff(np.append(first, len(tokens)))
        # List number and owner as one ascending number, for binary probes of many lists at once.
        self.probe = np.repeat(np.arange(len(first)), self.count) * len(self.sizes) + self.owners

    def search(self, queries: list[int]) -> None:
        """T-occurrence search of each query over the whole chunk (DivideSkip)."""
        sizes, m = self.sizes, len(self.sizes)
        for q in queries:
            own, n = self.sets[q], int(sizes[q])
            need = max(1, -(-self.num * n // self.den))  # J times the larger set, so T for the smallest partner
            lists = np.searchsorted(self.tokens, own)
            count = self.count[lists]
            lists, count = lists[count > 1], count[count > 1]  # a list of one holds the query alone
            if len(lists) < need:
                continue
            # Partners of fitting size that are not known to be in the query's component, and
            # whose own overlap the shared lists can reach.
            open_ = (self.den * np.minimum(sizes, n) >= self.num * np.maximum(sizes, n)) & (self.label != self.label[q])
            open_ &= self.num * (n + sizes) <= (self.num + self.den) * len(lists)
            if not open_.any():
                continue
            order = np.argsort(count, kind="stable")
            lists, count = lists[order], count[order]
            cut = len(lists) - need + 1  # a partner is in one of the short lists at least
            short, long = lists[:cut], lists[cut:]
            start, count = self.start[short], count[:cut]
            if int(count.sum()) <= SMALL_MERGE:
                merged = heap_merge([self.owners[s : s + c].tolist() for s, c in zip(start.tolist(), count.tolist(), strict=True)])
                seen = {i: k for i, k in merged if open_[i]}
                found = np.array(list(seen), dtype=np.int64)
                hits = np.array(list(seen.values()), dtype=np.int64)
            else:  # the same merge for long inputs, by counting
                all_hits = np.bincount(self.owners[_spread(start, count)], minlength=m)
                found = np.flatnonzero((all_hits > 0) & open_)
                hits = all_hits[found]
            # Every candidate is looked up in the long lists by binary probes, while it can
            # still reach the overlap that its own size asks for.
            at_least = -(-self.num * (n + sizes[found]) // (self.num + self.den))
            step = max(1, PROBES // max(1, len(found)))
            for i in range(0, len(long), step):
                alive = hits + (len(long) - i) >= at_least
                found, hits, at_least = found[alive], hits[alive], at_least[alive]
                if not len(found):
                    break
                asked = (long[i : i + step, None] * m + found[None, :]).ravel()
                p = np.searchsorted(self.probe, asked)
                p[p == len(self.probe)] = 0
                hits = hits + (self.probe[p] == asked).reshape(-1, len(found)).sum(axis=0)
            for other in found[hits >= at_least].tolist():
                self._join(q, other)

    def run(self, leader: int | None) -> list[int]:
        """Links of the chunk; returns those that are not in the leader's component then."""
        self.label = np.arange(len(self.ids))
        self._invert()
        if leader is None:
            self.search([i for i, q in enumerate(self.query) if q])
            return []
        self.search([leader])
        self.search(np.flatnonzero(self.label != self.label[leader]).tolist())
        return np.flatnonzero(self.label != self.label[leader]).tolist()


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions start[i], ..., start[i] + count[i] - 1 of all i."""
    total = int(count.sum())
    return np.repeat(start - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(total)


def _digest(values: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None


def _sketches(k: int, sketch: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for text in texts_of(batch):
                values = shingle_set(text, k)
                sizes.append(len(values))
                digests.append(_digest(values))
                sketches.append(values[:sketch].view(np.int64) if len(values) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], schema=schema)

    return run


def _full_sets(k: int):
    schema = pa.schema([("cid", pa.int64()), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, sets = [], []
            for text, cid, digest in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                values = shingle_set(text, k).tobytes()
                if values and xxhash.xxh3_128_digest(values) == digest:  # another row may have the same id
                    cids.append(cid)
                    sets.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.binary())], schema=schema)

    return run


def _search_blocks(num: int, den: int, by_leader: bool):
    """Rows sorted by (lead, chunk) to links and, of step one, stragglers (v null)."""
    schema = pa.schema([("lead", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

    def close(lead: int, block: _Block, out: list) -> None:
        if len(block.ids) < 2:
            return
        leader = next((i for i, c in enumerate(block.ids) if c == lead), None) if by_leader else None
        rest = block.run(leader)
        out += [(lead, a, b) for a, b in block.links]
        if by_leader:
            out += [(lead, block.ids[i], None) for i in rest]

    def flush(out: list) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, out = None, _Block(num, den), []
        for batch in batches:
            for lead, chunk, cid, query, values in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (lead, chunk) != key:
                    if key is not None:
                        close(key[0], block, out)
                    key, block = (lead, chunk), _Block(num, den)
                if block.ids and block.ids[-1] == cid:  # as a member and as a query or leader
                    block.query[-1] |= query
                    continue
                block.add(cid, np.frombuffer(values, dtype=np.uint64), query)
            if len(out) > 10_000:
                yield flush(out)
                out = []
        if key is not None:
            close(key[0], block, out)
        yield flush(out)

    return run


def _blocks_with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(lead, chunk, cid, query) with sets, each chunk whole in one task and in order."""
    return rows.join(sets, "cid").select("lead", "chunk", "cid", "query", "values").repartition("lead", "chunk").sortWithinPartitions("lead", "chunk", "cid")


_LINKS = "lead long, u long, v long"


def _salted(rows: DataFrame, leads: DataFrame) -> DataFrame:
    """``rows(lead, cid, ...)`` of the leaders in ``leads(lead, ...)`` with the columns of both.

    ``leads`` has a row for each of some large blocks.  It is repeated SALTS times and the
    rows of one leader are dealt out among so many parts, so no leader is one task's work.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    asked = mark_possible_members(rows, "lead", leads, "_in").where("_in").drop("_in")
    asked = asked.withColumn("_salt", F.pmod(F.xxhash64("cid", F.lit(3)), F.lit(SALTS)).cast("int"))
    return asked.join(leads.withColumn("_salt", salts).hint("merge"), ["lead", "_salt"]).drop("_salt")


def _first_hashes(sketch: int):
    """(cid, values) to (cid, n, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(v, dtype=np.int64) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) for v in sets], pa.int64()), pa.array([v[:sketch] for v in sets], pa.list_(pa.int64()))], names=["cid", "n", "sketch"])

    return run


def _route(sketches: DataFrame, num: int, den: int, sketch: int, scope: Scratch) -> DataFrame:
    """(cid, n, sketch) to members of blocks: cid, n, lead.  Linked classes share a block."""
    need = required_overlap(num, den, sketch)
    # Sets up to this size have partners that fit a sketch whole, so the exact bound holds.
    whole = num * sketch // den
    # Just above it, all that a pair shares can still be less than ``need``.
    own = F.ceil(F.col("n") * num / F.lit(den))
    exempt = F.when(F.col("n") <= whole, own).otherwise(F.least(own, F.lit(need))) - 1
    posts = sketches.select("cid", exempt.cast("int").alias("exempt"), F.explode("sketch").alias("t"))
    lists = posts.groupBy("t").agg(F.count("*").alias("df"), F.min("cid").alias("lead")).where("df > 1")
    kept = (
        posts.join(lists, "t")
        .groupBy("cid")
        .agg(F.first("exempt").alias("exempt"), F.sort_array(F.collect_list(F.struct("df", "t", "lead"))).alias("ls"))
        .where("size(ls) > exempt")
        .select("cid", F.explode(F.array_distinct(F.expr("transform(slice(ls, 1, size(ls) - exempt), x -> x.lead)"))).alias("lead"))
    )
    return scope.write(kept.join(sketches.select("cid", "n"), "cid"), "members", rows=sketch * sketches.count())


def _place(members: DataFrame, chunk_rows: int, chunk_shingles: int, scope: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (lead, chunk, cid), large blocks (lead, rows, chunks), and the rows of step
    one: members and, in every chunk, the leader.

    Only counts are shuffled by leader, combined before; members of blocks that are not
    large need no join.
    """
    n = members.count()
    sizes = members.groupBy("lead").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), F.max("cid").alias("any")).where("rows > 1 or any <> lead")
    sizes = scope.write(sizes.select("lead", "rows", F.ceil(F.greatest(F.col("rows") / chunk_rows, F.col("shingles") / chunk_shingles)).cast("int").alias("chunks")), "sizes", rows=n)
    large = scope.write(sizes.where("chunks > 1"), "large", rows=sizes.count())
    # A block of the leader alone has no pairs; few of those get through.
    some = mark_possible_members(members.select("lead", "cid"), "lead", sizes, "_some").where("_some").drop("_some")
    if large.isEmpty():
        placed = some.select("lead", F.lit(0).alias("chunk"), "cid")
    else:
        # Only members of large blocks have a salt, and so a partner in the join.
        salt = F.pmod(F.xxhash64("cid", F.lit(3)), F.lit(SALTS)).cast("int")
        marked = mark_possible_members(some, "lead", large, "_large").withColumn("_salt", F.when(F.col("_large"), salt))
        chunks = large.select("lead", "chunks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        placed = marked.join(chunks.hint("merge"), ["lead", "_salt"], "left").select("lead", F.coalesce(F.pmod(F.xxhash64("cid"), "chunks"), F.lit(0)).cast("int").alias("chunk"), "cid")
    placed = scope.write(placed, "placed", rows=n)
    return placed, large, placed.union(_everywhere(sizes.select("lead", "chunks", F.col("lead").alias("cid"))))


def _everywhere(rows: DataFrame) -> DataFrame:
    """(lead, chunks, cid) once for each chunk of the block."""
    return rows.select("lead", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "cid")


def _stragglers(found: DataFrame, large: DataFrame, scope: Scratch) -> DataFrame:
    """Members of large blocks that their chunk left outside of the leader's component."""
    rest = found.where("v is null").select("lead", F.col("u").alias("cid")).distinct()
    return scope.write(_salted(rest, large.select("lead", "chunks")).select("lead", "cid", "chunks"), "stragglers", rows=found.count())


def _cells(placed: DataFrame, rest: DataFrame, chunk_rows: int, scope: Scratch) -> DataFrame:
    """Rows of step two: each chunk of a block with each chunk of its stragglers.

    ``chunk`` numbers the cells of a block; a cell holds one chunk of either, so its size
    is bounded however many stragglers there are.
    """
    parts = rest.groupBy("lead").agg(F.first("chunks").alias("chunks"), F.ceil(F.count("*") / chunk_rows).cast("long").alias("parts"))
    parts = scope.write(parts, "parts", rows=rest.count())
    cell = (F.col("chunk") * F.col("parts") + F.col("part")).alias("chunk")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    hosts = _salted(placed, parts.select("lead", "parts")).withColumn("part", every("parts")).select("lead", cell, "cid", F.lit(False).alias("query"))
    asked = _salted(rest.select("lead", "cid"), parts).withColumn("part", F.pmod(F.xxhash64("cid", F.lit(9)), "parts"))
    asked = asked.withColumn("chunk", every("chunks")).select("lead", cell, "cid", F.lit(True).alias("query"))
    return hosts.union(asked)


def classes_and_links(
    docs: DataFrame,
    k: int = SHINGLE,
    num: int = 75,
    den: int = 100,
    sketch: int = SKETCH,
    chunk_rows: int = CHUNK_ROWS,
    chunk_shingles: int = CHUNK_SHINGLES,
    deep_sketch: int = DEEP_SKETCH,
    direct_work: float = DIRECT_WORK,
    *,
    scope: Scratch,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs(doc_id, text)`` to three tables of ``scope``.

    * one row per document: doc_id, n_shingles, digest (null: no words);
    * one row per class of equal sets: cid, digest, n, first_id;
    * spanning links between classes: u, v (cids).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shingled = scope.write(docs.mapInArrow(_sketches(k, sketch), "doc_id long, n_shingles long, digest binary, sketch array<long>"), "sketches")
    classes = scope.write(
        shingled.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")).withColumn("cid", F.monotonically_increasing_id()),
        "classes",
        rows=shingled.count(),
    )
    placed, large, rows = _place(_route(classes, num, den, sketch, scope), chunk_rows, chunk_shingles, scope)

    involved = scope.write(rows.select("cid").distinct().join(classes.select("cid", "first_id", "digest"), "cid"), "involved", rows=classes.count())
    # Most documents have no partner at all; their texts are not dealt out.
    asked = mark_possible_members(docs, "doc_id", involved.select(F.col("first_id").alias("doc_id")), "_asked").where("_asked")
    sets = (
        asked.alias("d")
        .join(involved.hint("merge").alias("i"), F.col("d.doc_id").eqNullSafe(F.col("i.first_id")))
        .select("text", "cid", "digest")
        .mapInArrow(_full_sets(k), "cid long, values binary")
        .groupBy("cid")
        .agg(F.first("values").alias("values"))
    )
    sets = scope.write(sets, "sets")

    def search(rows: DataFrame, by_leader: bool) -> DataFrame:
        return scope.write(_blocks_with_sets(rows, sets).mapInArrow(_search_blocks(num, den, by_leader), _LINKS), "links")

    found = search(rows.withColumn("query", F.lit(False)), True)
    links = found.where("v is not null").select("u", "v")
    if not large.isEmpty():
        rest = _stragglers(found, large, scope)
        total = large.agg(F.sum("rows")).first()[0]
        if (rest.agg(F.sum("chunks")).first()[0] or 0) > direct_work * total:
            # Many stragglers: deal the documents of large blocks out anew, by sketches in
            # which a passage may be most of a document before its lists count.
            again = _salted(placed, large.select("lead")).select("cid").union(large.select(F.col("lead").alias("cid"))).distinct()
            deep = scope.write(sets.join(again, "cid", "left_semi").mapInArrow(_first_hashes(deep_sketch), "cid long, n long, sketch array<long>"), "sketches")
            placed, large, rows = _place(_route(deep, num, den, deep_sketch, scope), chunk_rows, chunk_shingles, scope)
            found = search(rows.withColumn("query", F.lit(False)), True)
            links = links.union(found.where("v is not null").select("u", "v"))
            rest = _stragglers(found, large, scope)
        if not rest.isEmpty():
            links = links.union(search(_cells(placed, rest, chunk_rows, scope), False).select("u", "v"))
    return shingled.select("doc_id", "n_shingles", "digest"), classes.select("cid", "digest", "n", "first_id"), links


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id reachable by links, itself included.

    Edge cases: null and wordless texts have n_shingles 0 and are their own
    component; repeated rows stay and share a component; a null doc_id keeps its
    row, takes the component's smallest id if its text links with others, else
    null; an empty table gives an empty result; further columns are ignored.
    """
    with Scratch(docs.sparkSession) as scope:
        return scope.write(_judged(docs, scope, **options).select("doc_id", "n_shingles", "component_id"), "components", keep=True, rows=docs.count())


def _judged(docs: DataFrame, scope: Scratch, **options) -> DataFrame:
    """Rows of ``jaccard_components`` with the digest of each and its component's node, which
    no other component has, whatever the ids (both null without words)."""
    shingled, classes, links = classes_and_links(docs, scope=scope, **options)
    comp = connected_components(links, scope)
    in_comp = classes.select(F.col("cid").alias("node"), "digest", "first_id").join(comp, "node")
    low = in_comp.groupBy("root").agg(F.min("first_id").alias("low"))
    linked = in_comp.join(low, "root").select("node", "root", "low")
    labelled = classes.join(linked, classes["cid"] == linked["node"], "left").select("digest", F.coalesce("root", "cid").alias("root"), F.coalesce("low", "first_id").alias("component_id"))
    return shingled.join(labelled, "digest", "left").select("doc_id", "n_shingles", "digest", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_per_component(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that stay when each component keeps its smallest doc_id.

    Each row is judged by its own component, also where an id is repeated with other texts.
    Of a component's rows of its smallest id one stays.  Rows without an id stay only where
    no row of their component has one, one of each text; so do rows without words, one of
    each id and text.
    """
    with Scratch(docs.sparkSession) as scope:
        return _kept(docs, scope, **options)


def _kept(docs: DataFrame, scope: Scratch, **options) -> DataFrame:
    rows = scope.write(_judged(docs, scope, **options), "components", rows=docs.count())
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # Ids that are dropped, and ids that have further rows, need a look; the other texts,
    # most of them, pass through without being dealt out.
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(own).alias("stays"))
    look = scope.write(ids.where("n > 1 or not stays"), "doubtful", keep=True, rows=rows.count())
    table, at = neutral(docs)
    key, names = at["doc_id"], list(at.values())
    marked = mark_possible_members(table, key, look.select(F.col("doc_id").alias(key)), "look")
    passed = marked.where("not look").select(*names)
    doubtful = marked.where("look").drop("look")
    ids_of = look.select(F.col("doc_id").alias("_id"))
    stay = passed.union(doubtful.join(ids_of.hint("merge"), F.col(key).eqNullSafe(F.col("_id")), "left_anti").select(*names))
    repeated = look.where("n > 1").select(F.col("doc_id").alias("_id"))
    if repeated.isEmpty():
        return stay.toDF(*docs.columns)
    mine = rows.where(own).join(repeated.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    each = F.when(F.col("doc_id").isNull(), F.col("digest"))
    kept = mine.where("digest is not null").groupBy("doc_id", "root", each.alias("each")).agg(F.min("digest").alias("_digest")).select(F.col("doc_id").alias("_id"), "_digest")
    kept = scope.write(kept, "chosen", keep=True)
    k = options.get("k", SHINGLE)
    digest = F.udf(lambda text: _digest(shingle_set(text, k)), "binary")
    again = mark_possible_members(table, key, repeated.withColumnRenamed("_id", key), "look").where("look").drop("look")
    again = again.join(repeated.hint("merge"), F.col(key).eqNullSafe(F.col("_id")), "left_semi").withColumn("digest", digest(at["text"]))
    wordless = again.where("digest is null")
    chosen = again.join(kept.hint("merge"), F.col(key).eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_semi")
    same = F.when(F.col(key).isNull() | F.col("digest").isNull(), F.xxhash64(F.col(at["text"]).isNull(), at["text"]))
    more = wordless.union(chosen).withColumn("same", same).dropDuplicates([key, "digest", "same"]).select(*names)
    return stay.union(more).toDF(*docs.columns)

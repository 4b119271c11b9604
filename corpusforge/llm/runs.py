"""Periodic runs of words, by longest previous factors.

A run is a stretch of words of smallest period q, at least MIN_REPEATS q words long, that can't
be extended.  Of each stretch of words that may hold one:

1. a suffix array by prefix doubling (NumPy sorts), its LCP array, and from both the longest
   previous factor of each position (Crochemore and Ilie 2008), with a place where it stands;
2. the LZ blocks: each block is the longest previous factor of its start, or one word;
3. Main's extensions (Main 1989): a run that reaches over the end of the block before is found
   by how far a period extends to the right and to the left of that border;
4. bucketed copying (Kolpakov and Kucherov 1999): a run inside a block is a copy of one inside
   the block's earlier place, so it is copied from the bucket of runs that start there.

Before that, words that can't stand in any run are cut out, exactly: a word of a run stands in
it MIN_REPEATS times at least, so stretches between words that are rarer than that are all that
is looked at, again until nothing changes.  Ordinary prose leaves little.

Distribution: a document is one row and one call, texts are read where they lie and nothing is
shuffled; memory is some hundred bytes a word of the longest document.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import spread
from .common import texts_of

#: A run has at least so many words, and is so many times as long as its period.
MIN_LENGTH, MIN_REPEATS = 6, 4

Run = tuple[int, int, int]  # start, length, period


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``s`` (small non-negative numbers), and the ranks by the first 1, 2, 4,
    ... elements that the doubling went through."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    ranks, width = [rank], 1
    while True:
        order = np.argsort(rank, kind="stable")
        if width >= n or int(rank[order[-1]]) == n - 1:
            return order, ranks
        second = np.full(n, -1, dtype=np.int64)
        second[: n - width] = rank[width:]
        key = rank * (n + 1) + second + 1
        rank = np.unique(key, return_inverse=True)[1]
        ranks.append(rank)
        width *= 2


def lcp_array(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order`` (0 for the first): equal
    ranks of 2^k elements are skipped from the largest k down."""
    n = len(order)
    a, b = order[1:].copy(), order[:-1].copy()
    common = np.zeros(n, dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = np.nonzero((a < n) & (b < n))[0]
        rank = ranks[k]
        # Ranks tell suffixes shorter than 2^k from longer ones, so equal ranks are full matches.
        same = inside[(rank[a[inside]] == rank[b[inside]]) & (np.maximum(a[inside], b[inside]) + (1 << k) <= n)]
        common[same + 1] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return common


def longest_previous_factors(order: np.ndarray, common: np.ndarray) -> tuple[list[int], list[int]]:
    """(length, place): the longest factor at each position that also starts earlier, and where."""
    n = len(order)
    length, place = [0] * n, [-1] * n
    stack: list[tuple[int, int]] = []  # (position, common prefix with the one below it)
    for position, shared in [*zip(order.tolist(), common.tolist(), strict=True), (-1, 0)]:
        while stack and position < stack[-1][0]:
            top, below = stack.pop()
            # Its neighbours of smaller position are the one below and the one that comes.
            if below >= shared:
                length[top] = below
                place[top] = stack[-1][0] if stack and below else -1
            else:
                length[top], place[top] = shared, position
            shared = min(below, shared)
        stack.append((position, shared))
    return length, place


def blocks(length: list[int]) -> list[int]:
    """Starts of the LZ blocks, and the end."""
    starts, at = [], 0
    while at < len(length):
        starts.append(at)
        at += max(1, length[at])
    return [*starts, at]


def _prefix_matches(s: list[int]) -> list[int]:
    """How far ``s`` agrees with itself from each position on."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _crossing(s: list[int], last: int, border: int, end: int) -> Iterator[Run]:
    """Repetitions that reach over ``border``, the start of the block up to ``end``; the block
    before starts at ``last``.

    One that began before the last block would have two periods in it, and the block would have
    been longer; so 2 (end - border) + (border - last) words to the left are enough.
    """
    low = max(0, border - 2 * (end - border) - (border - last))
    left, right = s[low:border], s[border : end + 1]
    n, m = len(left), len(right)
    back = left[::-1]
    ahead = _prefix_matches(right)  # right with itself
    behind = _prefix_matches(back)
    right_left = _prefix_matches([*right, -1, *left])  # right against each place of left
    back_right = _prefix_matches([*back, -1, *right[::-1]])  # left's end against each place of right
    for p in range(1, m + 1):  # a whole period right of the border
        forward = ahead[p] if p < m else 0
        backward = back_right[n + 1 + m - p] if n else 0
        if forward + backward >= p:
            yield border - backward, backward + p + forward, p
    for p in range(1, n + 1):  # a whole period left of it
        backward = behind[p] if p < n else 0
        forward = right_left[m + 1 + n - p] if m else 0
        if forward + backward >= p:
            yield border - p - backward, backward + p + forward, p


def runs_of(s: np.ndarray) -> list[Run]:
    """All runs of a sequence of numbers, by start, then period."""
    if len(s) < MIN_LENGTH:
        return []
    s = np.append(s, s.max() + 1)  # a last block of its own, so runs that reach the end meet a border
    n = len(s)
    order, ranks = suffix_array(s)
    length, place = longest_previous_factors(order, lcp_array(order, ranks))
    starts, words = blocks(length), s.tolist()
    buckets: dict[int, dict[int, Run]] = defaultdict(dict)  # start -> length -> run
    at: list[int] = []  # sorted starts that have a bucket

    def keep(run: Run) -> None:
        start, size, period = run
        if size < max(MIN_LENGTH, MIN_REPEATS * period):
            return
        # A period's multiple has the same ends where it reaches so far: the smallest stays.
        if start not in buckets:
            at.insert(bisect_left(at, start), start)
        held = buckets[start].get(size)
        if held is None or period < held[2]:
            buckets[start][size] = run

    for k in range(1, len(starts) - 1):
        last, begin, end = starts[k - 1], starts[k], starts[k + 1]
        shift = begin - place[begin] if length[begin] else 0
        for start, size, period in _crossing(words, last, begin, end):
            # Extend to the ends of the stretch: the window may have cut the repetition.
            first, stop = start, start + size
            if size < 2 * period:
                continue
            while first > 0 and words[first - 1] == words[first - 1 + period]:
                first -= 1
            while stop < n and words[stop] == words[stop - period]:
                stop += 1
            keep((first, stop - first, period))
        # Copies: runs of the earlier place that end before the block's copy of it does.  A block
        # may overlap that place, so copies are copied on; they start later, hence the index.
        if shift and end - begin > MIN_LENGTH:
            i = bisect_left(at, begin - shift + 1)
            while i < len(at) and at[i] < end - shift:
                start = at[i]
                for size, run in list(buckets[start].items()):
                    if start + size < end - shift:
                        keep((start + shift, size, run[2]))
                i += 1
    return sorted((r for b in buckets.values() for r in b.values()), key=lambda r: (r[0], r[2]))


def candidate_stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of stretches in which each word stands MIN_REPEATS times at least."""
    n = len(ids)
    if n < MIN_LENGTH:
        return []
    keep = np.bincount(ids)[ids] >= MIN_REPEATS
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate(([0], keep.view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= MIN_LENGTH
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return []
        held = np.repeat(np.arange(len(starts)), ends - starts)
        offset = np.arange(len(held)) - np.repeat(np.concatenate(([0], np.cumsum(ends - starts)[:-1])), ends - starts)
        at = starts[held] + offset
        _, inverse, counts = np.unique(held * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        frequent = counts[inverse] >= MIN_REPEATS
        if frequent.all():
            return list(zip(starts.tolist(), ends.tolist(), strict=True))
        keep = np.zeros(n, dtype=bool)
        keep[at[frequent]] = True


def periodic_runs(words: list[bytes]) -> list[Run]:
    """All runs of a document's words, by start, then period."""
    if len(words) < MIN_LENGTH:
        return []
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    # The words around a stretch differ from all of it, so its runs end with it at the latest.
    return [(a + start, size, period) for a, b in candidate_stretches(ids) for start, size, period in runs_of(ids[a:b])]


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words without what repeats a run's first period."""
    if not runs:
        return words
    kept = np.ones(len(words), dtype=bool)
    for start, size, period in runs:
        kept[start + period : start + size] = False
    return [words[i] for i in np.flatnonzero(kept)]


def plant_period(words: list[bytes], doc_id: object) -> list[bytes]:
    """What the contract of the query does to a tenth of all documents: from a word on, the text
    repeats itself."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _strongest(runs: list[Run]) -> Run | None:
    best = None
    for run in runs:  # by start, then period: the first of equals stays
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


SCHEMA = "doc_id {}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch], prepare, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        out: list[list] = [[] for _ in range(7)]
        for doc_id, text in zip(ids, texts_of(batch), strict=True):
            words = prepare((text or "").encode().split(), doc_id)
            runs = periodic_runs(words)
            best = _strongest(runs)
            row = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest())
            for column, value in zip(out, row, strict=True):
                column.append(value)
        arrays = [pa.array(c, pa.int64()) for c in out[:5]] + [pa.array(c, pa.string()) for c in out[5:]]
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), *arrays], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def find_runs(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with ``runs``, an array of (start, length, period) in words.

    Edge cases: null and empty texts have no word and no run; repeated rows and ids are rows of
    their own; an empty table gives an empty one; further columns are ignored.
    """

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            found = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in periodic_runs((t or "").encode().split())] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, item)], names=["doc_id", "runs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread(docs.select("doc_id", "text")).mapInArrow(spans, f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>")


def run_report(docs: DataFrame) -> DataFrame:
    """One row a document: its runs counted, the strongest one, and digests of all runs and of
    the text without repetitions, after a tenth of the documents got a periodic end.

    Edge cases: as in ``find_runs``; without a run its four columns are null, and the digests
    are those of the empty list and of all words.
    """
    kind = docs.schema["doc_id"].dataType

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        return _digests(batches, plant_period, to_arrow_type(kind))

    return spread(docs.select("doc_id", "text")).mapInArrow(digests, SCHEMA.format(kind.simpleString()))

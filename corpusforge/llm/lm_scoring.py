"""Language-model scores by deleted interpolation.

The probability of a word mixes maximum-likelihood estimates of all orders (Jelinek and Mercer
1980): p(w | u v) = l3 c(uvw)/c(uv) + l2 c(vw)/c(v) + l1 c(w)/N + l0/(V + 1).  The weights l
depend on a bucket: how often the longest context that training has seen was seen, in powers of
two.  They are learned by expectation-maximisation on counts held out: a tenth of the documents,
part of the training documents, is left out of the counts while the weights are learned.  The
final counts are those of all training documents.

Distribution.  Nothing that grows with the corpus is broadcast, and no row is made for a token:

1. texts become batches of about BATCH_TOKENS tokens, stored once: words of the batch in hash
   order, and tokens as places in it.  Development documents have batches of their own;
2. for each order a batch asks about its distinct n-grams, as sorted hashes, cut in ranges of
   the hash; a range of all batches meets in one task, is summed, and each batch gets its
   counts back in the order of its question, without keys.  A frequent n-gram is one entry a
   batch, so ranges are even whatever the corpus repeats.  Words are counted by their letters;
   longer n-grams by a hash so long that a lookup meets a foreign n-gram with a probability
   below 2^-SPARE_BITS;
3. the counts meet their batch, and each token has those of its orders and contexts: a context's
   count is the count of the n-gram that ends one token earlier.

Beyond some 10^12 tokens a range of one batch holds few n-grams, and questions are then about
as large as rows of single n-grams.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import spread
from .common import Scratch, crc_bucket

#: Longest n-grams.
ORDER = 3
#: Fixed by contract: documents whose crc32 modulo FOLDS is 0 are never learned from; those of
#: remainder 1 are held out of the counts while weights are learned.  Constants of the base score.
FOLDS, ADDED = 10, 0.1
#: Tokens of a batch and n-grams of a range, about.
BATCH_TOKENS, RANGE_KEYS = 1_000_000, 1_000_000
#: Bits of an n-gram's hash beyond those that the number of tokens needs.
SPARE_BITS = 20
#: Buckets of an order's context counts, by powers of two.
WIDTH = 24
#: EM ends after so many steps, or when no weight moves by more.
STEPS, SETTLED = 20, 1e-3
#: Added to each component's share in each step, so none is ever ruled out.
PRIOR = 0.5

HELD_OUT, DEVELOPMENT, KEPT = 0, 1, 2
_START, _M1, _M2 = np.uint64(0x243F6A8885A308D3), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# --- numbers as bytes ---------------------------------------------------------


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative numbers as byte planes, lowest first, without empty high ones; compressed."""
    numbers = np.ascontiguousarray(numbers, dtype=np.uint64)
    planes = (int(numbers.max()).bit_length() + 7) // 8 if len(numbers) else 0
    return zstandard.ZstdCompressor(level=1).compress(len(numbers).to_bytes(8, "little") + numbers.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        planes = np.frombuffer(raw, dtype=np.uint8, offset=8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view(np.uint64).reshape(-1)


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    """At least one word, which may be the end mark b''."""
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")


# --- batches ------------------------------------------------------------------


def _one_by_one(found: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of Arrow batches; of a batch, only one row at a time is made of Python objects."""
    for rows in found:
        for at in range(rows.num_rows):
            yield {name: column[at].as_py() for name, column in zip(rows.schema.names, rows.columns, strict=True)}


class _Batch:
    """Documents of one batch; its row has their words in hash order and tokens as places there."""

    def __init__(self, development: bool):
        self.development = development
        self.clear()

    def clear(self) -> None:
        self.known: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.docs, self.parts, self.sizes, self.tokens, self.n = [], [], [], [], 0

    def add(self, doc_id: object, part: int, words: list[bytes]) -> None:
        words.append(b"")
        self.docs.append(doc_id), self.parts.append(part), self.sizes.append(len(words))
        self.tokens.append(np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words)))
        self.n += len(words)

    def row(self, number: int) -> tuple:
        words = list(self.known)
        order = np.argsort(_hashes(words), kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        parts = np.array(self.parts)
        made = (number, self.development, self.docs, self.parts, self.sizes, pack_words([words[i] for i in order]), pack(place[np.concatenate(self.tokens)]), self.n, int((parts == DEVELOPMENT).sum()), int((parts == KEPT).sum()))
        self.clear()
        return made


_BATCH = "batch long, development boolean, docs array<{}>, parts array<int>, sizes array<int>, words binary, tokens binary, n long, n_development long, n_kept long"


def _batches(kind: pa.DataType):
    fields = [("batch", pa.int64()), ("development", pa.bool_()), ("docs", pa.list_(kind)), ("parts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("tokens", pa.binary()), *((n, pa.int64()) for n in ("n", "n_development", "n_kept"))]
    schema = pa.schema(fields)

    def make(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)  # the table is stored, so each is given once
        open_ = {d: _Batch(d) for d in (True, False)}

        def close(batch: _Batch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(batch.row(next(numbers)), schema, strict=True)], schema=schema)

        for row in _one_by_one(found):
            batch = open_[row["part"] == DEVELOPMENT]
            batch.add(row["doc_id"], row["part"], (row["text"] or "").encode().lower().split())
            if batch.n >= BATCH_TOKENS:
                yield close(batch)
        yield from (close(b) for b in open_.values() if b.n)

    return make


# --- n-grams of a batch -------------------------------------------------------


def _hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))


def _places(sizes: np.ndarray) -> np.ndarray:
    """Place of each token in its document."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _keys(hashes: np.ndarray, place: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Hash of the n-gram that ends at each token; before a document stand start marks."""
    acc = hashes * _M1
    for back in range(1, order):
        earlier = np.full(len(hashes), _START)
        inside = np.flatnonzero(place >= back)
        earlier[inside] = hashes[inside - back]
        acc ^= acc >> np.uint64(31)
        acc = (acc + earlier) * _M2
    acc ^= acc >> np.uint64(29)
    acc *= _M1
    return acc >> np.uint64(64 - bits)


def _ranges(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where each range of the hash begins in sorted ``keys``, and the end."""
    first = np.arange(ranges, dtype=np.uint64) << np.uint64(bits - ranges.bit_length() + 1)
    return np.append(np.searchsorted(keys, first), len(keys))


_ASK = "level int, range int, batch long, development boolean, keys binary, counts binary"
_ASK_FIELDS = pa.schema([("level", pa.int32()), ("range", pa.int32()), ("batch", pa.int64()), ("development", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())])


def _questions(order: int, bits: int, ranges: int):
    """Batches to rows (level, range, batch, keys, counts): distinct n-grams and how often the
    batch's training documents have each."""

    def ask(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(found):
            words, tokens, sizes = unpack_words(row["words"]), unpack(row["tokens"]).astype(np.int64), np.array(row["sizes"])
            hashes, place = _hashes(words), _places(sizes)
            learned = np.repeat(np.array(row["parts"]) != HELD_OUT, sizes)
            for level in range(1, order + 1):
                if level == 1:
                    keys, inverse = hashes >> np.uint64(64 - bits), tokens
                else:
                    keys, inverse = np.unique(_keys(hashes[tokens], place, level, bits), return_inverse=True)
                counts = np.bincount(inverse[learned], minlength=len(keys))
                cuts = _ranges(keys, bits, ranges)
                out: list[list] = [[] for _ in range(3)]
                for r in np.flatnonzero(np.diff(cuts)).tolist():
                    a, b = int(cuts[r]), int(cuts[r + 1])
                    named = pack_words(words[a:b]) if level == 1 else pack(np.diff(keys[a:b], prepend=np.uint64(r << (bits - ranges.bit_length() + 1))))
                    out[0].append(r), out[1].append(named), out[2].append(pack(counts[a:b]))
                n = len(out[0])
                yield pa.RecordBatch.from_arrays([pa.array([level] * n, pa.int32()), pa.array(out[0], pa.int32()), pa.array([row["batch"]] * n, pa.int64()), pa.array([row["development"]] * n, pa.bool_()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], schema=_ASK_FIELDS)

    return ask


_ANSWER = "level int, range int, batch long, development boolean, counts binary, kept binary, n_tokens long, n_kept_tokens long, n_types long, n_kept_types long"


def _answers(bits: int, ranges: int):
    """A range's questions to answers in the same order.  The sums of the range stand in its
    first row, so adding them up gives those of the corpus."""

    def answer(table: pa.Table) -> pa.Table:
        level, part = table.column("level")[0].as_py(), table.column("range")[0].as_py()
        asked, counts = table.column("keys").to_pylist(), [unpack(c) for c in table.column("counts").to_pylist()]
        if level == 1:
            words = [w for a in asked for w in unpack_words(a)]
            place = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy()
            del words
        else:
            first = np.uint64(part << (bits - ranges.bit_length() + 1))
            place = np.unique(np.concatenate([np.cumsum(unpack(a)) + first for a in asked]), return_inverse=True)[1]
        sizes = [len(c) for c in counts]
        development = table.column("development").to_numpy()
        each = np.concatenate(counts).astype(np.int64)
        total = np.bincount(place, weights=each).astype(np.int64)
        kept = np.bincount(place, weights=np.where(np.repeat(development, sizes), 0, each)).astype(np.int64)
        cuts = np.cumsum(sizes)[:-1]
        full = [pack(c) for c in np.split(total[place], cuts)]
        part_of = [pack(c) if d else None for c, d in zip(np.split(kept[place], cuts), development, strict=True)]
        once = lambda v: pa.array([int(v)] + [0] * (len(sizes) - 1), pa.int64())
        sums = [once(total.sum()), once(kept.sum()), once((total > 0).sum()), once((kept > 0).sum())]
        names = ["n_tokens", "n_kept_tokens", "n_types", "n_kept_types"]
        return pa.Table.from_arrays([table.column(c) for c in ("level", "range", "batch", "development")] + [pa.array(full, pa.binary()), pa.array(part_of, pa.binary()), *sums], names=["level", "range", "batch", "development", "counts", "kept", *names])

    return answer


# --- from counts to scores ----------------------------------------------------


def _token_counts(row: dict, answers: pa.Table, column: str, order: int, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Counts of the n-gram of each order at each token, and the tokens' places."""
    sizes, tokens = np.array(row["sizes"]), unpack(row["tokens"]).astype(np.int64)
    place, hashes = _places(sizes), _hashes(unpack_words(row["words"]))[tokens]
    held: dict[int, dict[int, bytes]] = defaultdict(dict)
    for level, part, data in zip(answers.column("level").to_pylist(), answers.column("range").to_pylist(), answers.column(column).to_pylist(), strict=True):
        held[level][part] = data
    out = []
    for level in range(1, order + 1):
        counts = np.concatenate([unpack(held[level][r]) for r in sorted(held[level])]).astype(np.int64)
        inverse = tokens if level == 1 else np.unique(_keys(hashes, place, level, bits), return_inverse=True)[1]
        out.append(counts[inverse])
    return out, place


def estimates(counts: list[np.ndarray], place: np.ndarray, n_docs: int, n_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, f): the bucket of each token's context, and its estimate of each order from 1."""
    first = place == 0
    f = [counts[0] / max(1, n_tokens)]
    bucket = np.zeros(len(place), dtype=np.int64)
    for level in range(2, len(counts) + 1):
        context = np.empty_like(counts[0])
        context[1:] = counts[level - 2][:-1]
        context[first] = n_docs
        f.append(np.divide(counts[level - 1], context, out=np.zeros(len(place)), where=context > 0))
        seen = np.frexp(np.maximum(context, 1).astype(float))[1]  # 1 for a count of 1, 2 for 2 and 3
        bucket = np.where(context > 0, (level - 2) * WIDTH + np.minimum(seen, WIDTH), bucket)
    return bucket, np.array(f)


def _development_rows(order: int, bits: int, n_docs: int, n_tokens: int):
    def rows_of(batch: pa.Table, answers: pa.Table) -> pa.Table:
        counts, place = _token_counts(batch.to_pylist()[0], answers, "kept", order, bits)
        bucket, f = estimates(counts, place, n_docs, n_tokens)
        by = np.lexsort([*f, bucket])
        bucket, f = bucket[by], f[:, by]
        new = np.append(True, (np.diff(bucket) != 0) | (np.diff(f, axis=1) != 0).any(axis=0))
        start = np.flatnonzero(new)
        n = np.diff(np.append(start, len(bucket)))
        return pa.Table.from_arrays([pa.array(bucket[start].astype(np.int32)), *(pa.array(x[start]) for x in f), pa.array(n.astype(np.int64))], names=["bucket", *(f"f{k}" for k in range(1, order + 1)), "n"])

    return rows_of


def learn_weights(held: DataFrame, order: int, n_types: int) -> np.ndarray:
    """Weights (bucket, order from 0) from ``held(bucket, f1, f2, ..., n)`` by EM.

    Each step is one grouped sum with a row a bucket.  A bucket without held-out tokens keeps
    even weights of the orders that it can use; no weight is ever 0, as PRIOR tokens are
    added to each.
    """
    buckets = (order - 1) * WIDTH + 1
    usable = np.zeros((buckets, order + 1), dtype=bool)
    usable[:, :2] = True
    for level in range(2, order + 1):
        usable[(level - 2) * WIDTH + 1 :, level] = True
    weights = usable / usable.sum(axis=1, keepdims=True)
    spark = held.sparkSession
    schema = "bucket int, " + ", ".join(f"l{k} double" for k in range(order + 1))
    for _ in range(STEPS):
        table = spark.createDataFrame([(b, *map(float, weights[b])) for b in range(buckets)], schema)
        share = [F.col("l0") / (n_types + 1), *(F.col(f"l{k}") * F.col(f"f{k}") for k in range(1, order + 1))]
        parts = held.join(F.broadcast(table), "bucket").select("bucket", "n", *(s.alias(f"s{k}") for k, s in enumerate(share)))
        whole = sum((F.col(f"s{k}") for k in range(1, order + 1)), F.col("s0"))
        sums = parts.groupBy("bucket").agg(*(F.sum(F.col("n") * F.col(f"s{k}") / whole).alias(f"e{k}") for k in range(order + 1))).collect()  # a row a bucket
        old = weights.copy()
        for row in sums:
            expected = np.where(usable[row["bucket"]], np.array(row[1:]) + PRIOR, 0)
            weights[row["bucket"]] = expected / expected.sum()
        if np.abs(weights - old).max() < SETTLED:
            break
    return weights


def _scores(order: int, bits: int, n_docs: int, n_tokens: int, n_types: int, weights: np.ndarray, kind: pa.DataType):
    def score(batch: pa.Table, answers: pa.Table) -> pa.Table:
        row = batch.to_pylist()[0]
        counts, place = _token_counts(row, answers, "counts", order, bits)
        bucket, f = estimates(counts, place, n_docs, n_tokens)
        p = weights[bucket, 0] / (n_types + 1)
        for k in range(1, order + 1):
            p += weights[bucket, k] * f[k - 1]
        sizes = np.array(row["sizes"])
        start = np.cumsum(sizes) - sizes
        base = np.log10((counts[0] + ADDED) / (n_tokens + ADDED * (n_types + 1)))
        n = len(sizes)
        arrays = [pa.array(row["docs"], kind), pa.array(np.array(row["parts"]) == HELD_OUT), pa.array(sizes.astype(np.int64)), pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), start)), pa.array(np.full(n, n_tokens)), pa.array(np.add.reduceat(base, start)), pa.array(np.add.reduceat(np.log10(p), start))]
        return pa.Table.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def corpus_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``docs(doc_id, text)`` to one row a document: held_out, n_tokens, n_known, train_tokens,
    base_score (one order, additive) and score (log10 of the model's probability of the text).

    Words are runs of anything but blanks, A-Z in lower case; an end mark follows them and is a
    token.  Documents whose crc32 is 0 modulo FOLDS are scored only.

    Edge cases: null and empty texts are an end mark; a null id counts as ''; repeated rows are
    documents of their own; without training documents every token has probability 1; an empty
    table gives an empty one; further columns are ignored.  The result is a stored table that
    belongs to the caller.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    fold = crc_bucket("doc_id", FOLDS)
    part = F.when(fold == 0, HELD_OUT).when(fold == 1, DEVELOPMENT).otherwise(KEPT).cast("int")
    result = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    with Scratch(spark) as scope:
        texts = spread(docs.select("doc_id", part.alias("part"), "text"))
        batches = scope.write(texts.mapInArrow(_batches(to_arrow_type(kind)), _BATCH.format(kind.simpleString())), "batches")
        n, n_development, n_kept = batches.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_development", "n_kept"))).first()
        bits = min(64, max(32, n.bit_length() + SPARE_BITS))
        ranges = 1 << max(0, (n // RANGE_KEYS).bit_length())
        asked = batches.mapInArrow(_questions(order, bits, ranges), _ASK)
        answers = scope.write(asked.groupBy("level", "range").applyInArrow(_answers(bits, ranges), _ANSWER), "answers")
        tokens, kept_tokens, types, kept_types = answers.where("level = 1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_kept_tokens", "n_types", "n_kept_types"))).first()
        held = batches.where("development").groupBy("batch").cogroup(answers.where("development").groupBy("batch"))
        columns = ", ".join(f"f{k} double" for k in range(1, order + 1))
        held = scope.write(held.applyInArrow(_development_rows(order, bits, n_kept, kept_tokens), f"bucket int, {columns}, n long"), "development")
        weights = learn_weights(held, order, kept_types) if tokens else np.eye(1, order + 1).repeat((order - 1) * WIDTH + 1, axis=0)
        scored = batches.groupBy("batch").cogroup(answers.select("batch", "level", "range", "counts").groupBy("batch"))
        scored = scored.applyInArrow(_scores(order, bits, n_kept + n_development, tokens, types, weights, to_arrow_type(kind)), result)
        return scope.write(scored, "scores", keep=True)

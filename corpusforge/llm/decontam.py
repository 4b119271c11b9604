"""Benchmark decontamination by winnowing.

Schleimer, Wilkerson and Aiken, "Winnowing: Local Algorithms for Document
Fingerprinting" (2003): of every ``w`` consecutive k-gram hashes the smallest is
kept (the rightmost of equal ones).  Two texts that share ``k + w - 1`` words then
share a kept fingerprint, so with ``k + w - 1 = window`` every shared window is
found.  Each common fingerprint is a hit that is extended to the whole windows
around it.

A test set of at most ``block_words`` words is one broadcast of bounded size, and the
documents stream past it without a shuffle.  Of a larger one nothing is broadcast: the
fingerprints of documents and items are joined by hash in Spark, with salt, after a bitmap
of fixed size has taken out those that no item has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, hash_windows, hash_words, mark_possible_members, neutral

#: Words of a window that counts as shared.
WINDOW = 10
#: Words of a fingerprinted k-gram.
GRAM = 5
#: Item words that are broadcast; 40 bytes of tables a word, so 80 MB at most.
BLOCK_WORDS = 2_000_000
#: Bytes of their texts at most; a word, as one without blanks, may be of any length.
BLOCK_BYTES = 32 << 20
#: Parts among which the rows of one fingerprint are dealt out.
SALTS = 16
#: Runs of word characters in a text that is not lower-cased yet.
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

# Word characters are ASCII letters and digits and everything beyond ASCII.
_KEEP = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def benchmark_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_KEEP).split() if text else []


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions that winnowing keeps; all of them if ``w`` is 1."""
    n = len(grams) - w + 1
    if w == 1 or n <= 0:
        return np.arange(len(grams) if w == 1 else 0)
    low = grams[:n].copy()
    at = np.arange(n)
    for i in range(1, w):
        here = grams[i : i + n]
        better = here <= low
        low[better] = here[better]
        at[better] = np.flatnonzero(better) + i
    return np.unique(at)


def _is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    p = np.searchsorted(table, values)
    p[p == len(table)] = 0
    return table[p] == values


@dataclass
class ItemBlock:
    """Tables of some items, by window length."""

    window: int
    gram: int
    # window length -> (sorted window hashes, start of each one's items, items)
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    names: list[int | None] = field(default_factory=list)  # ids of the items, by number
    prints: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.uint64))

    @classmethod
    def build(cls, items: list[tuple[int | None, str | None]], window: int, gram: int) -> ItemBlock:
        out, found, prints = cls(window, gram), {}, []
        out.names = list(dict.fromkeys(item_id for item_id, _ in items))
        number = {item_id: i for i, item_id in enumerate(out.names)}
        for item_id, text in items:
            hashes = hash_words(benchmark_words(text))
            if not len(hashes):
                continue
            length = min(window, len(hashes))
            values = np.unique(hash_windows(hashes, length))
            found.setdefault(length, []).append((values, np.full(len(values), number[item_id], dtype=np.int64)))
            if length == window:
                grams = hash_windows(hashes, gram)
                prints.append(grams[winnow(grams, window - gram + 1)])
        for length, parts in found.items():
            values, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((ids, values))
            values, ids = values[order], ids[order]
            unique, start = np.unique(values, return_index=True)
            out.windows[length] = (unique, np.append(start, len(values)), ids)
        if prints:
            out.prints = np.unique(np.concatenate(prints))
        return out

    def hits(self, hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[int | None]]:
        """Word spans (start, end) of ``hashes`` that are windows, and the ids of their items."""
        spans, items = [], set()
        for length, (values, start, ids) in self.windows.items():
            if len(hashes) < length:
                continue
            if length == self.window:
                w = self.window - self.gram + 1
                grams = hash_windows(hashes, self.gram)
                kept = winnow(grams, w)
                seeds = kept[_is_in(grams[kept], self.prints)]
                if not len(seeds):
                    continue
                # Extend each seed to the windows that hold it.
                begins = np.unique((seeds[:, None] - np.arange(w)[None, :]).ravel())
                begins = begins[(begins >= 0) & (begins <= len(hashes) - length)]
                picked = hash_windows(hashes, length)[begins]
            else:
                picked = hash_windows(hashes, length)
                begins = np.arange(len(picked))
            ok = _is_in(picked, values)
            spans += [(int(b), int(b) + length) for b in begins[ok]]
            for p in np.unique(np.searchsorted(values, picked[ok])):
                items.update(ids[start[p] : start[p + 1]].tolist())
        return spans, {self.names[i] for i in items}


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_ADDED = T.StructType([
    T.StructField("_n_words", T.LongType()),
    T.StructField("_hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("_items", T.ArrayType(T.LongType())),
])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(block, text_at: int):
    """Adds the hits of the broadcast ``block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = block.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in batch.column(text_at).to_pylist():
                hashes = hash_words(benchmark_words(text))
                hit, found = table.hits(hashes)
                n_words.append(len(hashes))
                spans.append([{"start": a, "end": b} for a, b in merge_spans(hit)])
                items.append(sorted(found, key=lambda x: (x is None, x)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.int64()))], names=[*batch.schema.names, "_n_words", "_hit_spans", "_items"])

    return run


def _item_windows(window: int, gram: int):
    """(item_id, text) to (item_id, n, seed, window): window hashes of length ``n`` and, as
    rows without ``window``, the fingerprints that find them; a short window is its own."""
    schema = pa.schema([("item_id", pa.int64()), ("n", pa.int32()), ("seed", pa.int64()), ("window", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = hash_words(benchmark_words(text))
                if not len(hashes):
                    continue
                n = min(window, len(hashes))
                values = np.unique(hash_windows(hashes, n))
                grams = hash_windows(hashes, gram) if n == window else values
                seeds = np.unique(grams[winnow(grams, window - gram + 1)]) if n == window else values
                rows = len(seeds) + len(values)
                yield pa.RecordBatch.from_arrays([pa.array([item_id] * rows, pa.int64()), pa.array([n] * rows, pa.int32()), pa.array([*seeds.view(np.int64).tolist(), *[None] * len(values)], pa.int64()), pa.array([*[None] * len(seeds), *values.view(np.int64).tolist()], pa.int64())], schema=schema)

    return run


def _document_windows(window: int, gram: int, lengths: list[int]):
    """(_row, text) to (_row, n, seed, begin, windows): each kept fingerprint and the hashes
    of the windows that hold it, from word ``begin`` on; every n-gram of the short lengths."""
    schema = pa.schema([("_row", pa.int64()), ("n", pa.int32()), ("seed", pa.int64()), ("begin", pa.int64()), ("windows", pa.list_(pa.int64()))])
    w = window - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = hash_words(benchmark_words(text))
                for n in lengths:
                    if len(hashes) < n:
                        continue
                    values = hash_windows(hashes, n).view(np.int64)
                    if n < window:
                        seeds, begins, lists = values, np.arange(len(values)), values[:, None].tolist()
                    else:
                        grams = hash_windows(hashes, gram)
                        kept = winnow(grams, w)
                        begins = np.maximum(kept - w + 1, 0)
                        seeds, lists = grams[kept].view(np.int64), [values[a : p + 1].tolist() for a, p in zip(begins.tolist(), kept.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(seeds), pa.int64()), pa.array([n] * len(seeds), pa.int32()), pa.array(seeds, pa.int64()), pa.array(begins, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], schema=schema)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of (start, end) to merged spans."""
    for batch in batches:
        spans = [[{"start": a, "end": b} for a, b in merge_spans([(s["start"], s["end"]) for s in row])] for row in batch.column(1).to_pylist()]
        items = [sorted((i["item_id"] for i in row), key=lambda x: (x is None, x)) for row in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.int64()))], names=["_hit", "_hit_spans", "_items"])


def _join_prints(docs: DataFrame, items: DataFrame, window: int, gram: int, text: str, scope: Scratch) -> DataFrame:
    """``docs`` with the three columns, by a join of fingerprints in Spark."""
    table, at = neutral(docs)
    rows = scope.write(table.withColumn("_row", F.monotonically_increasing_id()), "numbered", keep=True)
    known = scope.write(items.mapInArrow(_item_windows(window, gram), "item_id long, n int, seed long, window long"), "items")
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())  # from 1 to ``window``
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    salted = lambda df: df.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))

    seeds = known.where("seed is not null").select("n", "seed").distinct()
    made = rows.select("_row", at[text]).mapInArrow(_document_windows(window, gram, lengths), "_row long, n int, seed long, begin long, windows array<long>")
    asked = mark_possible_members(made.withColumn("key", F.xxhash64("n", "seed")), "key", seeds.select(F.xxhash64("n", "seed").alias("key")), "maybe").where("maybe").drop("maybe", "key")
    held = salted(asked).join(seeds.select("n", "seed", salts).hint("merge"), ["n", "seed", "_salt"], "left_semi")
    around = scope.write(held.select("_row", "n", F.posexplode("windows").alias("i", "window"), "begin").select("_row", "n", "window", (F.col("begin") + F.col("i")).alias("begin")), "windows")

    windows = known.where("window is not null").select("n", "window", "item_id")
    hit = salted(around).join(windows.select("n", "window").distinct().select("n", "window", salts).hint("merge"), ["n", "window", "_salt"], "left_semi")
    hit = scope.write(hit.select("_row", "n", "window", "begin").distinct(), "hits")
    spans = hit.groupBy("_row").agg(F.collect_set(F.struct(F.col("begin").alias("start"), (F.col("begin") + F.col("n")).alias("end"))).alias("spans"))
    named = salted(hit.select("_row", "n", "window").distinct()).join(windows.select("n", "window", "item_id", salts).hint("merge"), ["n", "window", "_salt"]).select("_row", "item_id").distinct()
    found = spans.join(named.groupBy("_row").agg(F.collect_set(F.struct("item_id")).alias("items")), "_row").select("_row", "spans", "items")
    found = scope.write(found.mapInArrow(_merged, "_hit long, _hit_spans array<struct<start:long,end:long>>, _items array<long>"), "found", keep=True)

    marked = mark_possible_members(rows, "_row", found.select(F.col("_hit").alias("_row")), "maybe")
    n_words = F.coalesce(F.regexp_count(F.col(at[text]), F.lit(_WORD)), F.lit(0)).cast("long")
    no = lambda c: F.coalesce(c, F.array().cast(_ADDED[c].dataType))
    clean = marked.where("not maybe").select(*at.values(), n_words, F.array().cast(_ADDED["_hit_spans"].dataType), F.array().cast(_ADDED["_items"].dataType))
    others = marked.where("maybe").join(found.hint("merge"), F.col("_row") == F.col("_hit"), "left").select(*at.values(), n_words, no("_hit_spans"), no("_items"))
    return clean.union(others).toDF(*docs.columns, *_ADDED.names)


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, block_words: int = BLOCK_WORDS, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """``docs`` with three more columns: _n_words, _hit_spans and _items.

    ``_hit_spans`` are merged word spans that occur in items of ``items(item_id,
    text)``, ``_items`` the distinct ids found.  An item of fewer words than a window
    is one window; fewer words than ``window`` have no winnowing guarantee, so
    all their n-grams are compared.

    Edge cases: null and wordless texts have no words and no hits; wordless items
    match nothing; items without an id are found as the id null, all together; repeated
    rows and items are kept as they are (equal ids count once); empty tables give no hits;
    columns of ``docs`` are kept, those named like the three new ones are replaced.
    """
    docs = docs.drop(*_ADDED.names)
    spark, schema = docs.sparkSession, T.StructType([*docs.schema.fields, *_ADDED.fields])
    counted = items.select(F.col("item_id").cast("long").alias("item_id"), "text", F.regexp_count("text", F.lit(_WORD)).alias("words")).where("words > 0")
    total, size = (x or 0 for x in counted.agg(F.sum("words"), F.sum(F.octet_length("text"))).first())
    if total > block_words or size > block_bytes:
        with Scratch(spark) as scope:
            return _join_prints(docs, counted.select("item_id", "text"), window, gram, text, scope)
    held = [(r["item_id"], r["text"]) for r in counted.select("item_id", "text").collect()]  # ``block_words`` words and ``block_bytes`` bytes at most
    return docs.mapInArrow(_scan(spark.sparkContext.broadcast(ItemBlock.build(held, window, gram)), docs.columns.index(text)), schema)


def contamination_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs.select("doc_id", "text"), items, **options)
    n_hit = F.expr("aggregate(_hit_spans, 0L, (n, s) -> n + s.end - s.start)")
    ids = F.expr("array_join(array_sort(transform(_items, x -> string(x))), ',')")
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` without a shared window; columns as they were.

    Edge cases: rows without words stay, repeated rows are judged alike, empty tables of
    either kind drop nothing; names of ``docs`` clash with none used here.
    """
    rows, at = neutral(docs)
    return find_contamination(rows, items, text=at["text"], **options).where("size(_hit_spans) = 0").select(*at.values()).toDF(*docs.columns)


def excise(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``; for callers that mend documents."""
    out, last = [], 0
    raw = text.encode("utf-8", "surrogatepass")
    clean = raw.lower().translate(_KEEP)
    bounds, pos = [], 0
    for word in clean.split():
        pos = clean.index(word, pos)
        bounds.append((pos, pos + len(word)))
        pos += len(word)
    for a, b in merge_spans(spans):
        out.append(raw[last : bounds[a][0]])
        last = bounds[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")

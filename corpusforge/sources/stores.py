"""Chunk stores: versioned Parquet, JSON, and readers of the compatible formats.

A versioned store is a folder of immutable layers, snapshots that list them, and a pointer to
the current snapshot.  A snapshot is complete before the pointer names it, so readers see the
old version or the new one, and a writer that dies leaves an unnamed folder.  One writer a
table is assumed.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import store_round
from ..operators.indexing import dense_index
from .files import open_path

CHUNK_SCHEMA = T.StructType([
    T.StructField("chunk_id", T.LongType()),
    T.StructField("file", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType(), False)),
])
FILE_HASH_SCHEMA = "file string, hash string, mtime_ms double, size long"
CALL_DATA_SCHEMA = "file string, definitions array<string>, calls array<string>"
STORE_VERSION = 2


@dataclass
class StoreMeta:
    version: int = STORE_VERSION
    model: str = "hashing"
    dimension: int | None = None
    workspace: str = ""
    last_save_time: str = ""
    files_indexed: int = 0
    chunks_stored: int = 0
    next_chunk_id: int = 0
    write_id: str = ""
    #: Names and bytes of the layers, oldest first; the store fills this in.
    layers: list = field(default_factory=list)
    extra: dict = field(default_factory=dict)


#: Beyond LAYERS layers, newer ones are merged into the one before them once they come to a
#: GROWTH-th of its bytes, so there are few layers, and a row is written again about once each
#: time the store grows GROWTH times.
LAYERS, GROWTH = 8, 4
#: Rows of a row group of chunks at most, and what its Bloom filter is sized for.  Layers of one
#: change have none: they are small.
GROUP_ROWS = 20_000


class VersionedStore:
    """Chunks, file hashes and call data of one workspace, in layers below ``root``.

    The oldest layer is a base; each further one has the new rows of some files, and the names of
    the files whose older rows it voids.  Readers take of each layer what no newer one voids.
    Saving a change thus writes what changed, not the rest.  A snapshot is a list of layers; it is
    complete before a pointer names it.
    """

    TABLES = {"chunks": CHUNK_SCHEMA, "file_hashes": FILE_HASH_SCHEMA + ", chunks long", "call_data": CALL_DATA_SCHEMA}
    #: Touched files: ``scope`` is "all", or "hashes" where only the file's hash row is replaced.
    TOUCHED = "file string, scope string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))) if self._exists(folder) else []

    def current(self) -> str | None:
        """Newest complete snapshot: the greatest pointer name."""
        names = self._names("pointers")
        return names[-1].split("-", 1)[1] if names else None

    def meta(self) -> StoreMeta | None:
        name = self.current()
        if name is None:
            return None
        return StoreMeta(**json.loads(self.spark.read.schema("meta string").json(f"{self.root}/snapshots/{name}/meta").first()["meta"]))

    # --- writing ---------------------------------------------------------------------

    def _write_layer(self, tables: dict[str, DataFrame | None], touched: DataFrame | None = None, merged: bool = False) -> list:
        """A new layer, named by nobody yet: its name and bytes."""
        name = uuid.uuid4().hex
        folder = f"{self.root}/layers/{name}"
        for table, df in tables.items():
            if df is None:
                continue
            if table == "chunks":
                df = df.repartition("file").sortWithinPartitions("file", "chunk_id")
            writer = df.select(*(c.name for c in self._schema(table) if c.name in df.columns)).write
            if table == "chunks" and (touched is None or merged):  # in order of the file; the filters find ids
                writer = writer.option("parquet.bloom.filter.enabled#chunk_id", "true").option("parquet.bloom.filter.expected.ndv#chunk_id", str(GROUP_ROWS)).option("parquet.block.row.count.limit", str(GROUP_ROWS))
            writer.parquet(f"{folder}/{table}")
        if touched is not None:
            touched.write.parquet(f"{folder}/touched")
            if self.spark.read.schema(self.TOUCHED).parquet(f"{folder}/touched").isEmpty():  # the layer voids nothing: readers needn't join
                self._fs.delete(self._path(f"{folder}/touched"), True)
        return [name, self._fs.getContentSummary(self._path(folder)).getLength() if self._exists(f"layers/{name}") else 0]

    def _schema(self, table: str) -> T.StructType:
        kind = self.TABLES[table]
        return kind if isinstance(kind, T.StructType) else T.StructType.fromDDL(kind)

    def _publish(self, meta: StoreMeta, layers: list) -> str:
        meta.write_id, meta.layers = uuid.uuid4().hex, layers
        self.spark.createDataFrame([(json.dumps(asdict(meta)),)], "meta string").coalesce(1).write.json(f"{self.root}/snapshots/{meta.write_id}/meta")
        names = self._names("pointers")
        number = 1 + (int(names[-1].split("-")[0]) if names else 0)
        self._fs.mkdirs(self._path(f"{self.root}/pointers/{number:012d}-{meta.write_id}"))  # one atomic step
        return meta.write_id

    def save(self, meta: StoreMeta, **tables: DataFrame) -> str:
        """Write a base and publish it as the only layer; tables that are not given carry over."""
        old = self.current()
        given = {name: tables.get(name) if tables.get(name) is not None or old is None else self.read(name) for name in self.TABLES}
        layer = self._write_layer(given)
        self._count(meta, [layer])
        return self._publish(meta, [layer])

    def _count(self, meta: StoreMeta, layers: list, removed: int = 0, before: int = 0) -> None:
        """Chunk numbers of the snapshot, from what its newest layer holds."""
        new = self._layer_rows("chunks", [layers[-1]])
        n, most = new.agg(F.count("*"), F.max("chunk_id")).first() if new is not None else (0, None)
        meta.chunks_stored, meta.next_chunk_id = before - removed + n, max(meta.next_chunk_id, 0 if most is None else most + 1)

    def apply(self, meta: StoreMeta, touched: DataFrame, hashes_of: DataFrame | None = None, **tables: DataFrame) -> str:
        """Add a layer: the rows of the files in ``touched(file)`` are replaced by the given ones,
        and of those in ``hashes_of(file)`` the hash rows only.  Written is what is given.

        Without a snapshot it becomes the base.  Layers are merged afterwards if they are small.
        """
        old = self.meta()
        if old is None:
            return self.save(meta, **tables)
        marks = touched.select("file", F.lit("all").alias("scope"))
        if hashes_of is not None:
            marks = marks.union(hashes_of.select("file", F.lit("hashes").alias("scope")))
        layer = self._write_layer(tables, marks.distinct())
        removed, hashes = 0, self.read("file_hashes")
        if hashes is not None and self._exists(f"layers/{layer[0]}/touched"):
            voided = self._touched([layer]).where("scope = 'all'")
            removed = hashes.join(voided.select("file"), "file", "left_semi").agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0]
        meta.next_chunk_id = max(meta.next_chunk_id, old.next_chunk_id)
        self._count(meta, [*old.layers, layer], removed, old.chunks_stored)
        self._publish(meta, [*old.layers, layer])
        return self.compact() or meta.write_id

    def compact(self, all_layers: bool = False) -> str | None:
        """If there are many layers, merge the newest ones while they come to a GROWTH-th of the one before them, or all;
        publishes a snapshot of equal content, or returns None if there is nothing to do."""
        meta = self.meta()
        if meta is None:
            return None
        layers, first, size = meta.layers, len(meta.layers) - 1, meta.layers[-1][1]
        while first > 0 and (all_layers or (len(layers) > LAYERS and layers[first - 1][1] <= GROWTH * size)):
            first -= 1
            size += layers[first][1]
        if first == len(layers) - 1:
            return None
        merged = layers[first:]
        touched = self._touched(merged).groupBy("file").agg(F.min("scope").alias("scope")) if first else None  # "all" < "hashes"
        layer = self._write_layer({t: self._layer_rows(t, merged) for t in self.TABLES}, touched, merged=True)
        return self._publish(meta, [*layers[:first], layer])

    # --- reading -----------------------------------------------------------------------

    def _touched(self, layers: list) -> DataFrame:
        """(file, scope, layer) of the layers' marks, ``layer`` their place in the list."""
        out = self.spark.createDataFrame([], self.TOUCHED + ", layer int")
        for k, (name, _) in enumerate(layers):
            if self._exists(f"layers/{name}/touched"):
                out = out.union(self.spark.read.schema(self.TOUCHED).parquet(f"{self.root}/layers/{name}/touched").withColumn("layer", F.lit(k)))
        return out

    def _layer_rows(self, table: str, layers: list) -> DataFrame | None:
        """What is left of ``table`` in the layers, of each what no newer one voids."""
        parts = [(k, self.spark.read.schema(self.TABLES[table]).parquet(f"{self.root}/layers/{name}/{table}")) for k, (name, _) in enumerate(layers) if self._exists(f"layers/{name}/{table}")]
        if not parts:
            return None
        newest = len(layers) - 1
        if not any(self._exists(f"layers/{name}/touched") for name, _ in layers[1:]):  # nothing is voided
            out = parts[0][1]
            for _, df in parts[1:]:
                out = out.union(df)
            return out
        older = [df.withColumn("_layer", F.lit(k)) for k, df in parts if k < newest]
        out = next((df for k, df in parts if k == newest), None)
        if older:
            marks = self._touched(layers)
            if table != "file_hashes":
                marks = marks.where("scope = 'all'")
            void = marks.groupBy("file").agg(F.max("layer").alias("_void"))
            rows = older[0]
            for df in older[1:]:
                rows = rows.union(df)
            rows = rows.join(void, "file", "left").where("_void is null or _layer >= _void").drop("_void", "_layer").select(*self._schema(table).names)
            out = rows if out is None else rows.union(out)
        return out

    def read(self, table: str) -> DataFrame | None:
        meta = self.meta()
        return None if meta is None else self._layer_rows(table, meta.layers)

    def load(self, model: str, dimension: int | None = None, extensions: list[str] | None = None) -> DataFrame | None:
        """Current chunks; None if version, model or dimension differ from what is stored."""
        from ..functions.paths import extension

        meta = self.meta()
        if meta is None or meta.version != STORE_VERSION or meta.model != model or (dimension and meta.dimension and meta.dimension != dimension):
            return None
        chunks = self._layer_rows("chunks", meta.layers)
        if chunks is not None and extensions:
            chunks = chunks.where(extension("file").isin([f".{e.lstrip('.').lower()}" for e in extensions]))
        return chunks

    def rollback(self) -> None:
        """Unpublish the current snapshot."""
        names = self._names("pointers")
        if names:
            self._fs.delete(self._path(f"{self.root}/pointers/{names[-1]}"), True)

    def vacuum(self) -> None:
        """Delete every snapshot but the current one, and every layer that it doesn't name."""
        meta = self.meta()
        keep = {meta.write_id, *(name for name, _ in meta.layers)} if meta else set()
        for folder in ("snapshots", "layers"):
            for name in self._names(folder):
                if name not in keep:
                    self._fs.delete(self._path(f"{self.root}/{folder}/{name}"), True)
        for name in self._names("pointers"):
            if name.split("-", 1)[1] not in keep:
                self._fs.delete(self._path(f"{self.root}/pointers/{name}"), True)

    def clear(self) -> None:
        self._fs.delete(self._path(self.root), True)


def view(chunks: DataFrame, content: bool = True, vector: bool = True) -> DataFrame:
    """Chunk rows without the columns that are not wanted; Parquet then does not read them."""
    return chunks.drop(*([] if content else ["content"]), *([] if vector else ["vector"]))


def lookup(chunks: DataFrame, chunk_id: int) -> DataFrame:
    """The row of one id; none if it is out of range."""
    return chunks.where(F.col("chunk_id") == chunk_id)


# --- JSON --------------------------------------------------------------------------

_JSON_SCHEMA = "file string, startLine int, endLine int, content string, vector array<double>"


def write_json_store(chunks: DataFrame, path: str, digits: int | None = None) -> None:
    """One JSON object a line; vector elements rounded, not finite ones as 0."""
    out = chunks.select("file", F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), "content", store_round("vector", digits).alias("vector"))
    out.write.mode("overwrite").json(path)


def read_json_store(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Chunks of a JSON store, ids from 0 to n - 1 in the order of its files and lines; ``array``
    reads files that are one JSON array."""
    raw = dense_index(spark.read.schema(_JSON_SCHEMA).option("multiLine", array).json(path).withColumn("_nth", F.monotonically_increasing_id()), "_nth", "chunk_id")
    return raw.select("chunk_id", "file", F.col("startLine").alias("start_line"), F.col("endLine").alias("end_line"), "content", F.col("vector").cast("array<float>").alias("vector"))


# --- compatible binary store ----------------------------------------------------------

#: Little-endian layouts of the headers (magic, version, ...) and of a record.
VECTORS_HEADER = struct.Struct("<4sIIIII8x")  # magic, version, dim, count, write id, crc32
RECORDS_HEADER = struct.Struct("<4sIIIII8x")  # magic, version, count, files, write id, crc32
CONTENT_HEADER = struct.Struct("<4sIQII8x")  # magic, version, bytes, write id, crc32
RECORD = struct.Struct("<IIIQI8x")  # file, first line, last line, offset, length
BINARY_VERSION = 2
MAGICS = (b"HMCV", b"HMCR", b"HMCC")


class StoreCorrupt(ValueError):
    """Magic, version, checksum or write id of a binary store does not fit."""


def pack_binary_store(chunks: list[dict], write_id: int, magics: tuple[bytes, bytes, bytes] = MAGICS) -> dict[str, bytes]:
    """Four files of a binary store; all vectors need one length."""
    dims = {len(c["vector"]) for c in chunks}
    if len(dims) > 1:
        raise ValueError("vectors differ in length")
    dim = dims.pop() if dims else 0
    names: dict[str, int] = {}
    vectors, records, texts, at = [], [], [], 0
    for c in chunks:
        body = (c.get("content") or "").encode()
        vectors.append(struct.pack(f"<{dim}f", *c["vector"]))
        records.append(RECORD.pack(names.setdefault(c["file"], len(names)), c["start_line"], c["end_line"], at, len(body)))
        texts.append(body)
        at += len(body)
    v, r, t = b"".join(vectors), b"".join(records), b"".join(texts)
    return {
        "vectors.bin": VECTORS_HEADER.pack(magics[0], BINARY_VERSION, dim, len(chunks), write_id, zlib.crc32(v)) + v,
        "records.bin": RECORDS_HEADER.pack(magics[1], BINARY_VERSION, len(chunks), len(names), write_id, zlib.crc32(r)) + r,
        "content.bin": CONTENT_HEADER.pack(magics[2], BINARY_VERSION, len(t), write_id, zlib.crc32(t)) + t,
        "files.json": json.dumps(list(names)).encode(),
    }


def unpack_binary_store(files: dict[str, bytes]) -> list[dict]:
    """Chunks of the four files; refuses what is damaged or mixed from two writes."""
    v, r, t = files["vectors.bin"], files["records.bin"], files["content.bin"]
    if (v[:4], r[:4], t[:4]) != MAGICS:
        raise StoreCorrupt("magic")
    _, v_version, dim, count, v_id, v_crc = VECTORS_HEADER.unpack_from(v)
    _, r_version, r_count, n_files, r_id, r_crc = RECORDS_HEADER.unpack_from(r)
    _, t_version, size, t_id, t_crc = CONTENT_HEADER.unpack_from(t)
    v, r, t = v[VECTORS_HEADER.size :], r[RECORDS_HEADER.size :], t[CONTENT_HEADER.size :]
    names = json.loads(files["files.json"])
    if {v_version, r_version, t_version} != {BINARY_VERSION}:
        raise StoreCorrupt("version")
    if len({v_id, r_id, t_id}) > 1:
        raise StoreCorrupt("write id")
    if (count, len(v), len(r), len(t), len(names)) != (r_count, count * dim * 4, count * RECORD.size, size, n_files):
        raise StoreCorrupt("size")
    if (zlib.crc32(v), zlib.crc32(r), zlib.crc32(t)) != (v_crc, r_crc, t_crc):
        raise StoreCorrupt("checksum")
    out = []
    for i in range(count):
        f, a, b, at, n = RECORD.unpack_from(r, i * RECORD.size)
        out.append({"chunk_id": i, "file": names[f], "start_line": a, "end_line": b, "content": t[at : at + n].decode(), "vector": list(struct.unpack_from(f"<{dim}f", v, i * dim * 4))})
    return out


class BinaryStoreFile:
    """A binary store on disk, read by byte ranges: one record, vector or text at a time.

    Headers are checked as ``unpack_binary_store`` does, checksums of whole files only on
    ``verify``; an id that is out of range gives None.
    """

    def __init__(self, folder: str):
        self.fs, self.base = open_path(folder.rstrip("/"))
        v, r, t = (self._header(name, header) for name, header in (("vectors.bin", VECTORS_HEADER), ("records.bin", RECORDS_HEADER), ("content.bin", CONTENT_HEADER)))
        with self.fs.open_input_stream(f"{self.base}/files.json", compression=None) as source:
            self.files = json.loads(source.read())
        if (v[0], r[0], t[0]) != MAGICS:
            raise StoreCorrupt("magic")
        if {v[1], r[1], t[1]} != {BINARY_VERSION}:
            raise StoreCorrupt("version")
        if len({v[4], r[4], t[3]}) > 1:
            raise StoreCorrupt("write id")
        self.dim, self.count = v[2], v[3]
        if (self.count, len(self.files)) != (r[2], r[3]):
            raise StoreCorrupt("size")

    def _read(self, name: str, at: int, size: int) -> bytes:
        with self.fs.open_input_file(f"{self.base}/{name}") as source:
            return source.read_at(size, at)

    def _header(self, name: str, header: struct.Struct) -> tuple:
        raw = self._read(name, 0, header.size)
        if len(raw) < header.size:
            raise StoreCorrupt("size")
        return header.unpack(raw)

    def record(self, chunk_id: int) -> dict | None:
        if not 0 <= chunk_id < self.count:
            return None
        f, a, b, at, n = RECORD.unpack(self._read("records.bin", RECORDS_HEADER.size + chunk_id * RECORD.size, RECORD.size))
        return {"chunk_id": chunk_id, "file": self.files[f], "start_line": a, "end_line": b, "offset": at, "length": n}

    def vector(self, chunk_id: int) -> list[float] | None:
        if not 0 <= chunk_id < self.count:
            return None
        return list(struct.unpack(f"<{self.dim}f", self._read("vectors.bin", VECTORS_HEADER.size + chunk_id * self.dim * 4, self.dim * 4)))

    def content(self, chunk_id: int) -> str | None:
        found = self.record(chunk_id)
        return None if found is None else self._read("content.bin", CONTENT_HEADER.size + found["offset"], found["length"]).decode()

    def verify(self, block: int = 1 << 20) -> None:
        """Checksums, block by block."""
        for name, header, place in (("vectors.bin", VECTORS_HEADER, 5), ("records.bin", RECORDS_HEADER, 5), ("content.bin", CONTENT_HEADER, 4)):
            want, crc = self._header(name, header)[place], 0
            with self.fs.open_input_stream(f"{self.base}/{name}", compression=None) as source:
                source.read(header.size)
                while part := source.read(block):
                    crc = zlib.crc32(part, crc)
            if crc != want:
                raise StoreCorrupt("checksum")


#: Chunks of one piece of a store that is written or read by a task at once.
PIECE_ROWS = 20_000


def _write_pieces(root: str, kind: str, write_id: int):
    """Chunks of a task to pieces below ``root``; rows (piece, chunks, bytes)."""

    def run(batches):
        fs, base = open_path(root)

        def put(chunks: list[dict]) -> pa.RecordBatch:
            files = pack_binary_store(chunks, write_id) if kind == "binary" else {"vectors.sqlite": pack_sqlite_store(chunks)}
            name = f"piece-{uuid.uuid4().hex}"
            fs.create_dir(f"{base}/{name}", recursive=True)
            for part, body in files.items():
                with fs.open_output_stream(f"{base}/{name}/{part}", compression=None) as out:
                    out.write(body)
            return pa.RecordBatch.from_pylist([{"piece": name, "chunks": len(chunks), "bytes": sum(map(len, files.values()))}], schema=pa.schema([("piece", pa.string()), ("chunks", pa.int64()), ("bytes", pa.int64())]))

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) >= PIECE_ROWS:
                    yield put(held)
                    held = []
        if held:
            yield put(held)

    return run


def write_pieces(chunks: DataFrame, root: str, kind: str = "binary", write_id: int = 1) -> DataFrame:
    """Chunks as many compatible stores of bounded size, written by the tasks; the manifest.

    ``kind`` is binary or sqlite.  A piece is complete before its row is in the manifest,
    which is published last; pieces of lost attempts are in no manifest and are not read.
    """
    spark, root = chunks.sparkSession, root.rstrip("/")
    rows = chunks.select("file", "start_line", "end_line", "content", "vector")
    made = rows.mapInArrow(_write_pieces(f"{root}/pieces", kind, write_id), "piece string, chunks long, bytes long")
    made.write.mode("overwrite").json(f"{root}/manifest")
    return spark.read.schema("piece string, chunks long, bytes long").json(f"{root}/manifest")


def read_pieces(spark: SparkSession, root: str, kind: str = "binary") -> DataFrame:
    """Chunks of the pieces in the manifest of ``root``."""
    root = root.rstrip("/")
    listed = spark.read.schema("piece string, chunks long, bytes long").json(f"{root}/manifest").select("piece")
    return read_binary_stores(spark, f"{root}/pieces", listed) if kind == "binary" else read_sqlite_stores(spark, f"{root}/pieces", pieces=listed)


def read_binary_stores(spark: SparkSession, root: str, pieces: DataFrame | None = None) -> DataFrame:
    """Chunks of every binary store below ``root``, or of the ``pieces(piece)``: (store, chunk...).

    The four files of a store are brought together by folder; stores are independent, so
    many are read at once.
    """
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    named = parts.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("store"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content").where(F.col("name").isin("vectors.bin", "records.bin", "content.bin", "files.json"))
    if pieces is not None:
        named = named.join(pieces, F.element_at(F.split("store", "/"), -1) == F.col("piece"), "left_semi")

    def run(frame):
        import pandas as pd

        rows = unpack_binary_store(dict(zip(frame["name"], map(bytes, frame["content"]), strict=True)))
        out = pd.DataFrame(rows, columns=["chunk_id", "file", "start_line", "end_line", "content", "vector"])
        out.insert(0, "store", frame["store"].iloc[0])
        return out

    return named.groupBy("store").applyInPandas(run, "store string, chunk_id long, file string, start_line int, end_line int, content string, vector array<float>")


def pack_sqlite_store(chunks: list[dict], version: int = 1) -> bytes:
    """A SQLite file with tables ``metadata`` and ``chunks``; vectors as little-endian floats."""
    import sqlite3

    con = sqlite3.connect(":memory:")
    con.executescript("CREATE TABLE metadata (key TEXT PRIMARY KEY, value TEXT); CREATE TABLE chunks (id INTEGER PRIMARY KEY, file TEXT NOT NULL, startLine INTEGER NOT NULL, endLine INTEGER NOT NULL, content TEXT, vector BLOB); CREATE INDEX idx_chunks_file ON chunks(file);")
    dim = len(chunks[0]["vector"]) if chunks else 0
    con.executemany("INSERT INTO metadata VALUES (?, ?)", [("version", str(version)), ("dim", str(dim)), ("count", str(len(chunks)))])
    con.executemany("INSERT INTO chunks VALUES (?, ?, ?, ?, ?, ?)", [(i, c["file"], c["start_line"], c["end_line"], c.get("content"), struct.pack(f"<{dim}f", *c["vector"])) for i, c in enumerate(chunks)])
    con.commit()
    return con.serialize()


def unpack_sqlite_store(raw: bytes) -> list[dict]:
    import sqlite3

    con = sqlite3.connect(":memory:")
    con.deserialize(raw)
    rows = con.execute("SELECT id, file, startLine, endLine, content, vector FROM chunks ORDER BY id")
    return [{"chunk_id": i, "file": f, "start_line": a, "end_line": b, "content": c, "vector": list(struct.unpack(f"<{len(v) // 4}f", v)) if v else None} for i, f, a, b, c, v in rows]


def read_sqlite_stores(spark: SparkSession, root: str, pattern: str = "*.sqlite", pieces: DataFrame | None = None) -> DataFrame:
    """Chunks of every SQLite store below ``root``, or of the ``pieces(piece)``: (store, chunk...)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")
    if pieces is not None:
        files = files.join(pieces, F.element_at(F.split("path", "/"), -2) == F.col("piece"), "left_semi")

    def run(batches):
        import pandas as pd

        for frame in batches:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                out = pd.DataFrame(unpack_sqlite_store(bytes(raw)), columns=["chunk_id", "file", "start_line", "end_line", "content", "vector"])
                out.insert(0, "store", path)
                yield out

    return files.mapInPandas(run, "store string, chunk_id long, file string, start_line int, end_line int, content string, vector array<float>")


def add_telemetry(counters: DataFrame) -> DataFrame:
    """``counters(name, value)`` summed by name."""
    return counters.groupBy("name").agg(F.sum("value").alias("value"))

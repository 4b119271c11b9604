"""WARC archives with an index: write records, then read selected byte ranges.

Index first: while archives are written, offset, length, URL and digest of each
record go to an index table.  Readers select index rows, sort them by file and
offset, coalesce neighbouring ranges and fetch each with one ranged read.

Each record is a gzip member of its own (ISO 28500), so any range of whole records
can be read alone.  Archives lie in a folder that driver and executors share; a
task writes a file under a name of its own attempt and returns its index rows, and
Spark keeps the rows of one attempt only, so a lost executor leaves an unlisted
file at most.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, Scratch, mark_possible_members

#: Fixed by contract: payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Bytes between two wanted records that are read along, and most bytes of one read.
GAP = 64 << 10
MOST_READ = 8 << 20
#: Bytes of one archive file, about, and of the records that one task reads.
FILE_BYTES = 256 << 20
TASK_BYTES = 32 << 20
LEVEL = 6

INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"
_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
PAGE = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _header_value(text: str) -> str:
    """Text on one header line; whatever would end the line is percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m.group()):02X}", text)


def _plain(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m.group(1), 16)), value)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, size: int | None = None) -> bytes:
    """One WARC/1.1 record as a gzip member; ``size`` is that of a payload that is not given."""
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload) if size is None else size}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page-ID: {refers_to}"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def decode_record(member: bytes) -> dict:
    """Header fields (lower-case names) and payload of a gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    return fields | {"payload": rest[:n]}


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if re.match(r"[a-z][a-z0-9+.-]*:/", folder) else (pafs.LocalFileSystem(), folder)


def _uri(folder: str) -> str:
    """``file:/x`` of Hadoop as ``file:///x``."""
    return re.sub(r"^file:/+", "file:///", folder)


def _write(folder: str):
    """Rows (page_id, url, payload, digest, payload_bytes, first) to archives and index rows.

    A row whose ``first`` is not null is a revisit of it.  Payloads are taken out of the
    batch one at a time, so a worker holds a batch and one record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                payloads = batch.column(2)
                for i, (page_id, url, digest, size, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5)), strict=True)):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    revisit = first is not None
                    record = encode_record(page_id, url, payloads[i].as_py() or b"", digest, first, revisit, size)
                    out.write(record)
                    rows.append((page_id, url, digest, "revisit" if revisit else "response", first, name, at, len(record)))
                    at += len(record)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX) if rows else pa.RecordBatch.from_pylist([], schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return run


def _with_low(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """``rows`` with ``low`` of their digest in ``firsts(digest, low, n)``, or null.

    Digests of more than a HEAVY-th of all repeated rows, fewer than HEAVY, are broadcast; rows
    that have one are then dealt out by a number of their own, so a page that is a third of all
    is no single task's.
    """
    total = firsts.agg(F.sum("n").alias("n")).first()["n"] or 0
    often = firsts.where(F.col("n") > total // HEAVY).select("digest", F.col("low").alias("often"), F.lit(True).alias("heavy"))
    asked = rows.join(F.broadcast(often), "digest", "left")
    asked = asked.withColumn("key", F.when(F.col("heavy"), F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("digest")))
    rare = firsts.where(F.col("n") <= total // HEAVY).select(F.col("digest").alias("key"), F.col("low").alias("rare"))
    return asked.join(rare.hint("merge"), "key", "left").withColumn("low", F.coalesce("often", "rare")).drop("key", "often", "rare", "heavy")


def write_archives(pages: DataFrame, folder: str, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Archive ``pages(page_id, url, html)`` below ``folder``; returns the stored index.

    Of records with equal payloads of ``least_revisit`` bytes or more that with the
    smallest page_id is a response and the others are revisits of it.

    Payloads stay where they are scanned: only digests, ids and sizes are dealt out.  A
    group's smallest id is a grouped minimum, combined before the shuffle.  Rows whose
    digest can't be repeated (a bitmap tells) are written straight from the scan; revisits
    need no payload; and what is left, one payload of each repeated digest, is fetched by
    an exact join whose payload side the second bitmap has narrowed down to those.
    """
    with Scratch(pages.sparkSession) as scope:
        payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
        rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
        plain = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"))
        firsts = plain.where(F.col("size") >= least_revisit).groupBy("digest").agg(F.min("page_id").alias("low"), F.count("*").alias("n")).where("n > 1")
        firsts = scope.write(firsts, "repeated")
        narrow = mark_possible_members(plain, "digest", firsts, "maybe").where("maybe").drop("maybe")
        narrow = scope.write(_with_low(narrow, firsts).withColumn("first", F.when(~F.col("low").eqNullSafe(F.col("page_id")), F.col("low"))), "narrow")
        # Revisits of a group without any id have no one to refer to; so all its rows are responses.
        revisits = narrow.where("first is not null").select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "digest", "size", "first")
        needed = narrow.where("first is null").select("digest", F.col("page_id").alias("_id")).distinct()

        sized = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("first", F.lit(None).cast("long"))
        marked = mark_possible_members(sized, "digest", firsts, "maybe")
        columns = ["page_id", "url", "payload", "digest", "size", "first"]
        straight = marked.where("not maybe").select(columns)
        again = mark_possible_members(marked.where("maybe").withColumn("key", F.xxhash64("digest", "page_id")), "key", needed.select(F.xxhash64("digest", "_id").alias("key")), "wanted").where("wanted").select(columns)
        held = again.alias("r").join(needed.hint("merge").alias("n"), (F.col("r.digest") == F.col("n.digest")) & F.col("r.page_id").eqNullSafe(F.col("n._id")), "left_semi").select(columns)
        return scope.write(straight.union(held).union(revisits).mapInArrow(_write(_uri(folder)), INDEX), "warc-index", keep=True)


def coalesce_ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = MOST_READ) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) to reads: (start, end, positions of the rows)."""
    reads: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(rows):
        end = offset + length
        if reads and offset - reads[-1][1] <= gap and end - reads[-1][0] <= most:
            start, last, held = reads[-1]
            held.append(i)
            reads[-1] = (start, max(last, end), held)
        else:
            reads.append((offset, end, [i]))
    return reads


def _read(folder: str):
    def pages(fs, base: str, name: str, rows: list[tuple[int, int]]) -> Iterator[tuple]:
        with fs.open_input_file(f"{base}/{name}") as source:
            for start, end, held in coalesce_ranges(rows):
                block = source.read_at(end - start, start)
                for i in held:
                    offset, length = rows[i]
                    got = decode_record(block[offset - start : offset - start + length])
                    revisit = got["warc-type"] == "revisit"
                    digest = got["warc-payload-digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(got["payload"]).hexdigest() != digest:
                        raise ValueError(f"payload of page {got.get('x-page-id')} does not match its digest")
                    number = lambda k, got=got: int(got[k]) if k in got else None
                    url = got.get("warc-target-uri")
                    yield number("x-page-id"), None if url is None else _plain(url), None if revisit else got["payload"], number("x-payload-length"), digest, got["warc-type"], number("x-refers-to-page-id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        for batch in batches:  # sorted by file and offset
            files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            at = 0
            while at < len(files):
                end = at
                while end < len(files) and files[end] == files[at] and end - at < 1000:
                    end += 1
                out, size = [], 0
                for page in pages(fs, base, files[at], list(zip(offsets[at:end], lengths[at:end], strict=True))):
                    out.append(page)
                    size += len(page[2] or b"")
                    if size > MOST_READ:
                        yield _page_batch(out)
                        out, size = [], 0
                if out:
                    yield _page_batch(out)
                at = end

    return run


def _page_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), _PAGE, strict=True)], schema=_PAGE)


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """Records of the ``selected`` index rows: page_id, url, payload (null for revisits),
    payload_bytes, payload_digest, record_type, refers_to.

    Index rows are dealt out in ranges of (file, offset), as many as the bytes to read ask
    for, so a large file is read by several tasks and each reads its ranges in order.
    Response payloads are checked against their digest.
    """
    spark = selected.sparkSession
    total = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    dealt = selected.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read(_uri(folder)), PAGE)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all of ``pages`` to archives and read all records back.

    Edge cases: a null html is an empty payload; empty and short payloads are
    responses; a null url stays null; repeated rows are records like others, and all
    rows that repeat the smallest page_id of their payload are responses; a row
    without page_id revisits the smallest id of its payload, or is a response if none
    has one; an empty table gives an empty result; further columns are ignored.
    """
    folder = Scratch(pages.sparkSession).path("warc", keep=True)
    return read_records(write_archives(pages, folder), folder)

"""A workspace: index a folder of source files, keep the index current, and ask it.

One object ties the operators together: discovery, change detection, guarded reading,
chunking, embedding, all-or-nothing commit per file, versioned storage, search.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import code, embedding, paths, registry
from .functions.text import exact_match, model_token_limit
from .functions.vector import slice_normalize
from .operators import ann, chunking, graph, indexing, retention, search
from .operators.chunking import count_tokens, smart_chunk
from .operators.substring import SubstringIndex, by_id
from .sources import files, stores
from .sources.shared import Scratch, owning

#: Files that a task reads when an index is brought up to date, that are committed at once,
#: and errors that are listed.
FILES_A_TASK, FILES_A_BATCH, MOST_ERRORS = 200, 50_000, 100


@dataclass(frozen=True)
class IndexReport:
    mode: str
    reason: str
    files: int
    processed: int
    deleted: int
    chunks: int


@dataclass
class Workspace:
    """``root`` indexed below ``cache_root``; one writer at a time.

    Without ``ignore_lines`` those of the root's ignore file hold.  ``provider`` embeds a text column, ``embed`` one text on the driver; both must be the
    same model.
    """

    spark: SparkSession
    root: str
    cache_root: str
    extensions: list[str] = field(default_factory=lambda: ["js", "ts", "py", "go", "rs", "java", "md"])
    names: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    ignore_lines: list[str] = field(default_factory=list)
    model: str = "hashing"
    dimension: int = embedding.DIM
    provider: Callable[[Column], Column] | None = None
    embed: Callable[[str], list[float]] | None = None
    #: Loads a model in a task and gives a function of a list of texts; used instead of
    #: ``provider``, and its errors go to the error list.
    make_model: Callable[[], Callable[[list[str]], list]] | None = None
    config: search.SearchConfig = search.SearchConfig()

    def __post_init__(self):
        self.provider = self.provider or embedding.hashing_provider(self.dimension)
        self.embed = self.embed or embedding.HashingEmbedder(self.dimension)
        self.index_: ann.IvfIndex | None = None
        self.exact_: SubstringIndex | None = None
        #: Errors of the last run, the first MOST_ERRORS by file: stage, scope, at, message.
        self.errors: list[dict] = []
        self._open()

    def _open(self) -> None:
        import hashlib

        self.store = stores.VersionedStore(self.spark, f"{self.cache_root.rstrip('/')}/{hashlib.md5(self.root.encode()).hexdigest()[:12]}")

    # --- indexing ------------------------------------------------------------------

    def _table(self, name: str) -> DataFrame:
        found = self.store.read(name)
        return found if found is not None else self.spark.createDataFrame([], stores.VersionedStore.TABLES[name])

    def index(self, force: bool = False, now_ms: int | None = None, only: list[str] | None = None) -> IndexReport:
        """Bring the index up to date; ``only`` restricts it to some files (full paths).

        A file is committed if every chunk of it was embedded; otherwise its old chunks and
        hash stay, so the next run tries again.  Files are committed in batches of about
        FILES_A_BATCH, each a layer of the store that names what it replaces: a run that dies
        leaves its committed batches, whose files the next run finds unchanged.
        """
        with owning(self.spark):
            return self._index(force, now_ms if now_ms is not None else int(time.time() * 1000), only)

    def _index(self, force: bool, now_ms: int, only: list[str] | None) -> IndexReport:
        meta = self.store.meta()
        renew = force or meta is None or self.store.load(self.model, self.dimension) is None
        known, calls = self._table("file_hashes"), self._table("call_data")
        if renew:
            known, calls = known.limit(0), calls.limit(0)
        found = files.discover(self.spark, self.root, self.extensions, self.names, self.exclude, self.ignore_lines or files.ignore_file(self.root)).select("file", "size", "mtime_ms")
        with Scratch(self.spark) as scope:
            listed = scope.write(found if only is None else found.where(F.col("file").isin(only)), "listed")
            if only is not None:
                gone = known.where(F.col("file").isin(only)).join(listed.select("file"), "file", "left_anti").select("file")
            else:
                gone = indexing.prune_deleted(known, listed).select("file")
            without_calls = indexing.missing_call_data(known, calls, listed).withColumn("again", F.lit(True))
            changes = indexing.detect_changes(listed, known, now_ms, force).join(without_calls, "file", "left")
            todo = scope.write(changes.where(~F.col("unchanged") | F.col("again")), "todo")
            gone = scope.write(gone, "gone")
            n_files, n_gone = listed.count(), gone.count()
            n_todo, missing = todo.agg(F.count("*"), F.count_if(F.col("expected_hash").isNull())).first()
            stored_chunks = 0 if renew else meta.chunks_stored
            how = indexing.index_mode(renew and meta is not None, stored_chunks, n_todo, n_files, missing)
            self.errors = []
            if n_todo == 0 and n_gone == 0 and not (renew and meta is not None):
                return IndexReport(how.mode, how.reason, n_files, 0, 0, stored_chunks)
            batches = max(1, -(-n_todo // FILES_A_BATCH))
            for k in range(batches):
                part = todo.where(F.pmod(F.xxhash64("file"), F.lit(batches)) == k)
                self._commit(part, gone if k == 0 else gone.limit(0), renew and k == 0, n_files, now_ms, -(-n_todo // batches))
        self._update_ann(renew)
        self._update_exact(renew)
        return IndexReport(how.mode, how.reason, n_files, n_todo, n_gone, self.store.meta().chunks_stored)

    def _commit(self, todo: DataFrame, gone: DataFrame, base: bool, n_files: int, now_ms: int, n_todo: int) -> None:
        """Read, chunk and embed the files of ``todo`` and commit those that came through."""
        with owning(self.spark), Scratch(self.spark) as scope:
            wanted = todo.select("file", "expected_hash", "again", F.col("mtime_ms").alias("found_ms")).repartition(max(1, -(-n_todo // FILES_A_TASK)))
            read_ = files.read_files(wanted, keep=("expected_hash", "again", "found_ms"))
            looked = scope.write(read_.withColumn("mtime_ms", F.col("found_ms")).drop("found_ms"), "looked")
            read = looked.where("status = ''")
            fresh = read.where(~F.col("content_hash").eqNullSafe(F.col("expected_hash")) | F.col("again"))
            made = chunking.chunk_files(fresh.select("file", "content"))
            if self.make_model is not None:
                made = embedding.embed_with_status(made, self.make_model).select("*", "embedding.vector", "embedding.error").drop("embedding")
            else:
                made = made.withColumn("vector", self.provider(F.col("text"))).withColumn("error", F.lit(None).cast("string"))
            made = scope.write(made.withColumn("success", F.coalesce(F.size("vector") == self.dimension, F.lit(False))), "made")
            unread = looked.where("status <> ''").select(F.lit("read").alias("stage"), F.col("file").alias("scope"), F.lit(0).alias("at"), F.col("status").alias("message"))
            self.errors = (self.errors + [r.asDict() for r in unread.union(indexing.error_list(made, "embed", "file", "chunk_no")).orderBy("scope", "at").limit(MOST_ERRORS).collect()])[:MOST_ERRORS]
            totals = fresh.select("file").join(made.groupBy("file").agg(F.count("*").alias("n")), "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("total"))
            done = scope.write(indexing.commit_guard(made, totals), "done")  # FILES_A_BATCH rows about, so they are broadcast where texts are
            before = self.store.meta()
            first_id = 0 if base or before is None else before.next_chunk_id
            # Gapless: a file's chunks follow those of the files before it, so a sum over files numbers them.
            starts = indexing.running_total(done, "file", "total", "upto").select("file", (F.col("upto") - F.col("total") + first_id).alias("start"))
            numbered = made.join(F.broadcast(starts), "file").withColumn("chunk_id", F.col("start") + F.col("chunk_no"))
            same = read.where(F.col("content_hash").eqNullSafe(F.col("expected_hash")) & F.col("again").isNull())
            kept = same.join(self._table("file_hashes").select("file", "chunks"), "file", "left").select("file", "chunks")
            hashes = read.select("file", F.col("content_hash").alias("hash"), "mtime_ms", "size").join(done.select("file", F.col("total").alias("chunks")).union(kept), "file")
            tables = {
                "chunks": numbered.select("chunk_id", "file", "start_line", "end_line", F.col("text").alias("content"), "vector"),
                "file_hashes": hashes,
                "call_data": fresh.join(F.broadcast(done.select("file")), "file", "left_semi").select("file", code.call_data("content", "file").alias("c")).select("file", "c.definitions", "c.calls"),
            }
            meta = stores.StoreMeta(model=self.model, dimension=self.dimension, workspace=self.root, last_save_time=time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(now_ms / 1000)), files_indexed=n_files)
            if base:
                self.store.save(meta, **tables)
            else:
                older = looked.where("expected_hash is not null").select("file")  # a new file voids nothing
                self.store.apply(meta, done.select("file").join(older, "file", "left_semi").union(gone), same.select("file"), **tables)

    def _ann_path(self) -> str:
        return f"{self.store.root}/ann"

    def _update_ann(self, renew: bool) -> None:
        """Keep the stored approximate index: made where it is worth it, then added to by id;
        rows that are gone stay in it and find no chunk.  Made anew once it has no room."""
        self.index_ = None
        meta = self.store.meta()
        if not ann.should_build(meta.chunks_stored, self.dimension, least=self.config.ann_min_chunks):
            return
        held = None if renew else ann.IvfIndex.load(self.spark, self._ann_path(), self.model, self.dimension)
        if held is not None and held.meta.last_id < meta.next_chunk_id - 1:
            held = held.add(self.chunks().where(F.col("chunk_id") > held.meta.last_id))
        self.index_ = held or ann.IvfIndex.build(self.chunks(), model=self.model, path=self._ann_path())

    def _update_exact(self, renew: bool) -> None:
        """Keep the stored postings of trigrams: added to by id, made anew after many additions;
        a stale id finds no chunk."""
        path = f"{self.store.root}/exact"
        held = None if renew else SubstringIndex.load(self.spark, path)
        self.exact_ = (held.add(self.chunks()) if held is not None else None) or SubstringIndex.build(self.chunks(), path)

    def _exact(self) -> SubstringIndex | None:
        if self.exact_ is None and self.store.current() is not None:
            self.exact_ = SubstringIndex.load(self.spark, f"{self.store.root}/exact")
        return self.exact_

    def clear(self) -> None:
        """Drop the stored index."""
        self.store.clear()
        self.index_ = self.exact_ = None

    def set_workspace(self, root: str, reindex: bool = True) -> IndexReport | None:
        """Switch to another folder."""
        if self.spark.sql("select 1").select(paths.is_non_project(F.lit(root)).alias("x")).first()["x"]:
            raise ValueError("not a project folder")
        self.root = root
        self.index_ = self.exact_ = None
        self._open()
        return self.index() if reindex else None

    # --- queries ---------------------------------------------------------------------

    def chunks(self) -> DataFrame:
        """Current chunks; no rows if nothing is stored for this model and dimension."""
        found = self.store.load(self.model, self.dimension)
        return found if found is not None else self.spark.createDataFrame([], stores.CHUNK_SCHEMA)

    def _candidates(self, vector, k: int, total: int) -> DataFrame | None:
        if not ann.should_build(total, self.dimension, least=self.config.ann_min_chunks):
            return None
        if self.index_ is None:
            self.index_ = ann.IvfIndex.load(self.spark, self._ann_path(), self.model, self.dimension)
        if self.index_ is None or self.index_.meta.dim != self.dimension:
            return None  # not built: every vector is compared
        c = self.config
        return self.index_.candidates(vector, k, c.ann_min_candidates, c.ann_max_candidates, c.ann_multiplier)

    def _total(self) -> int:
        meta = self.store.meta()
        return meta.chunks_stored if meta else 0

    def search(self, query: str, k: int | None = None, as_of_ms: int | None = None) -> DataFrame:
        """Hybrid search with recency and call graph."""
        chunks, k = self.chunks(), k or self.config.max_results
        total, vector = self._total(), self.embed(query) if query.strip() else []
        calls = self._table("call_data")
        return search.hybrid_search(
            chunks, query, vector, as_of_ms if as_of_ms is not None else int(time.time() * 1000), k, self.config, self._table("file_hashes").select("file", "mtime_ms"), graph.call_edges(calls), self._candidates(vector, k, total) if query.strip() else None, total, self._exact()
        )

    def search_markdown(self, query: str, k: int | None = None) -> str:
        rows = search.format_results(self.search(query, k)).orderBy("rank").collect()
        return "\n".join(r["markdown"] for r in rows) or "No results. Index the workspace first."

    def find_similar(self, text: str, k: int | None = None, min_similarity: float | None = None) -> DataFrame:
        """Chunks like ``text``; a text beyond the model's limit counts by its first chunk."""
        if count_tokens(text) + 2 > model_token_limit(self.model):
            text = next((c["text"] for c in smart_chunk(text, "input.js")), text)
        chunks, vector = self.chunks(), self.embed(text)
        total = self._total()
        return search.find_similar(chunks, vector, text, k, min_similarity, self._candidates(vector, int(k or 5), total), total)

    def find_exact(self, text: str) -> DataFrame:
        """Chunks that hold ``text``, letter case ignored, without their vectors."""
        chunks, index = self.chunks().drop("vector"), self._exact()
        return index.search(text, chunks) if index is not None else chunks.where(exact_match("content", F.lit(text)))

    def lookup(self, ids: list[int]) -> DataFrame:
        """Chunks of some ids; the store's Bloom filters tell which row groups to read."""
        return by_id(self.chunks(), ids)

    def truncated(self, dim: int) -> DataFrame:
        """Chunks with vectors cut to ``dim`` and at unit length again."""
        return self.chunks().withColumn("vector", slice_normalize("vector", dim))

    def ann_config(self, action: str = "stats", effort: int | None = None) -> DataFrame:
        """Approximate index: ``stats``, ``set`` its effort, or ``rebuild`` it."""
        if action not in ("stats", "set", "rebuild"):
            raise ValueError("action must be stats, set or rebuild")
        if self.index_ is None and action != "rebuild":
            self.index_ = ann.IvfIndex.load(self.spark, self._ann_path(), self.model, self.dimension)
        if self.index_ is None or action == "rebuild":
            self.index_ = ann.IvfIndex.build(self.chunks(), model=self.model, path=self._ann_path())
        if action == "set":
            self.index_.set_effort(effort or 0)
        return self.index_.stats()

    def package(self, name: str) -> DataFrame:
        """Registry, clean name and URL of a package's latest version."""
        row = self.spark.createDataFrame([(name,)], "name string").select("name", registry.detect_registry("name").alias("r"))
        return row.select("name", "r.registry", "r.package", registry.registry_url("r.registry", "r.package").alias("url"))

    def resources(self) -> DataFrame:
        return files.list_resources(files.scan(self.spark, self.root), self.extensions)

    def status(self, as_of_ms: int | None = None) -> DataFrame:
        """One row: what is stored, its age, and what retention says of it."""
        meta, now = self.store.meta(), as_of_ms if as_of_ms is not None else int(time.time() * 1000)
        stats = indexing.index_stats(self.chunks())
        saved = F.unix_millis(F.try_to_timestamp(F.lit(meta.last_save_time if meta else None)))
        facts = stats.select(
            F.lit("current").alias("cache_id"), F.lit(self.root).alias("workspace"), F.lit(True).alias("workspace_exists"), F.lit(self.model).alias("model"), F.lit(self.dimension).alias("dimension"),
            F.col("files").alias("files_indexed"), F.col("chunks").alias("chunks_stored"), F.lit(meta is not None).alias("has_meta"), F.lit(False).alias("is_active"),
            F.coalesce(saved, F.lit(0)).alias("last_activity_ms"), F.coalesce(saved, F.lit(0)).alias("dir_mtime_ms"), F.lit(None).cast("long").alias("progress_ms"),
        )
        decided = retention.decide(facts, now).select("workspace", "model", "dimension", "files_indexed", "chunks_stored", "age_ms", "action", "reason")
        held = self.index_.meta if self.index_ is not None else None
        return decided.select(
            "*",
            F.lit(meta.write_id if meta else None).cast("string").alias("snapshot"),
            F.lit(meta.last_save_time if meta else None).cast("string").alias("saved_at"),
            F.lit(held.count if held else None).cast("long").alias("ann_rows"),
            F.lit(held.lists if held else None).cast("int").alias("ann_lists"),
            F.lit(len(self.errors)).alias("errors"),
        )

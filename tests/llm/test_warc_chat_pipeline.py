import gzip
import hashlib
import os
from collections import Counter

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from corpusforge.llm import chat, common, warc

PAGES = "page_id long, url string, html string, payload int, first int, digest int"


def test_round_trip(spark):
    long = "<p>" + "é" * 80 + "</p>"
    pages = [(1, "http://a/", long), (2, "http://b/ ü\n%", long), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "", ""), (0, "u", "x" * 99), (9, "u", "x" * 99), (None, "u", long), (1, "http://a/", long), (7, "u", "y\r\n\r\nWARC/1.1\r\n" * 9000), (8, "u", "z" * 100), (10, "u", "z" * 100)]
    df = spark.createDataFrame([(*p, 0, 0, 0) for p in pages], PAGES)
    rows = warc.archive_round_trip(df).collect()
    body = lambda h: (h or "").encode()
    want = Counter()
    for i, u, h in pages:
        ids = [j for j, _, g in pages if g == h and j is not None]
        first = min(ids) if len(body(h)) >= 100 and ids else i
        revisit = len(body(h)) >= 100 and first != i
        want[(i, u, len(body(h)), hashlib.sha256(body(h)).hexdigest(), "revisit" if revisit else "response", first if revisit else None)] += 1
    assert Counter((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) == want
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in rows)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_selected_records_and_standard_gzip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    folder = common.Scratch(spark).path("warc-test")
    index = warc.write_archives(pages, folder)
    some = warc.read_records(index.where("page_id % 7 = 0"), folder).collect()
    assert {r["page_id"] for r in some} == {r["page_id"] for r in pages.where("page_id % 7 = 0").collect()}
    row = index.first()
    raw = gzip.open(f"{folder.removeprefix('file://')}/{row['file']}").read()
    assert raw.count(b"WARC/1.1\r\n") >= index.where(F.col("file") == row["file"]).count()


def test_ranges():
    assert warc.coalesce_ranges([(0, 10), (12, 5), (100, 10), (110, 50)], gap=5, most=55) == [(0, 17, [0, 1]), (100, 110, [2]), (110, 160, [3])]


CONV = "conv_id long, turn long, role string, text string, n int, t int, pair_id int"


def test_preference(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yo"), (0, 2, "user", "more"), (0, 3, "assistant", "good"),
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "more"), (1, 3, "assistant", "bad"),
        (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", None),
        (4, 0, "user", "x"), (4, 1, None, "y"), (5, 0, "user", "z"),
        (6, 0, "user", "same"), (7, 0, "user", "same"), (7, 0, "user", "same"),
        (8, None, "user", "alone"), (None, 0, "user", "no conversation"),
    ]
    df = spark.createDataFrame([(*t, 0, 0, 0) for t in turns], CONV)
    rows = {r["pair_id"]: r for r in chat.preference_digest(df).collect()}
    assert set(rows) == {0, 1, 2, 3}
    a = rows[0]
    assert (a["n_prompt_turns"], a["n_chosen_turns"], a["n_rejected_turns"]) == (3, 1, 1)
    assert a["prompt"].endswith("more<|im_end|>\n") and a["chosen"] == "<|im_start|>assistant\ngood<|im_end|>\n"
    start, end = map(int, a["chosen_mask"].split(":"))
    assert a["chosen"][start:end] == "good<|im_end|>\n"
    assert (rows[1]["n_prompt_turns"], rows[1]["chosen"], rows[1]["rejected"]) == (1, "", "<|im_start|>assistant\n<|im_end|>\n")
    assert rows[2]["n_prompt_turns"] == 0 and rows[3]["n_prompt_turns"] == 1 and rows[3]["chosen_mask"] == ""
    assert chat.preference_digest(df.limit(0)).count() == 0
    plan = chat.preference_digest(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark, sf, docs):
    """Each stage against a brute-force version on its own input."""
    from corpusforge.llm.queries import oracle_sql
    from tests.llm.test_jaccard import brute

    con = duckdb.connect()
    table, held = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, sf)
        if name != "sharding":
            assert out.columns == docs.columns
        pandas = table.toPandas()
        con.register("documents", pandas)
        con.execute(f"create or replace view benchmark as select * from '{sf}/benchmark.parquet'")
        got = Counter(r["doc_id"] for r in out.collect())
        if name == "quality_rules":
            want = {r[0]: 1 for r in con.execute(f"select doc_id from ({oracle_sql()['op10_quality_rules']}) where kept").fetchall()}
        elif name == "ngram_jaccard_join":
            want = {d: 1 for d, _, c in brute([(r["doc_id"], r["text"]) for r in table.collect()]) if d == c}
        elif name == "benchmark_decontamination":
            want = {r[0]: 1 for r in con.execute(f"select doc_id from ({oracle_sql()['op7_decontamination']}) where not contaminated").fetchall()}
        elif name == "source_mixing":
            want = {r[0]: r[1] for r in con.execute(f"select doc_id, taken // size from ({oracle_sql()['op2_mixing']}) where taken > 0").fetchall()}
        else:
            want = Counter(r["doc_id"] for r in table.collect())
        assert dict(got) == dict(want), name
        held[name] = sum(got.values())
        path = common.Scratch(spark).path("stage")
        out.write.parquet(path)
        table = spark.read.parquet(path)
    assert corpus_pipeline.run(spark, sf).count() == held["sharding"]


def test_pipeline_stages_take_empty_tables(spark, sf, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_stages_on_odd_rows(spark, sf, odd):
    """Nulls, long texts, repeated rows and clashing names, each stage on the same rows."""
    good = spark.createDataFrame([(d, f"{'the cat sat on a mat and it was not the same as that %d ' % i * 1}{' '.join(f'w{i}x{j}' for j in range(80))}", "en", src, 9) for i, (d, src) in enumerate([(20, "s"), (20, "s"), (21, None), (None, "t"), (None, "t")])], "doc_id long, text string, lang string, source string, n_chars long")
    long = spark.range(1).select(F.lit(30).cast("long").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(150_000)), lambda i: F.concat(F.lit("the w"), i.cast("string"))), " ").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    extra = [c for c in odd.columns if c not in good.columns]
    plain = good.union(long).union(good.where("doc_id = 21"))
    docs = odd.unionByName(plain.select("*", *[F.lit(0).cast(odd.schema[c].dataType).alias(c) for c in extra])).withColumn("_row", F.lit(1)).withColumn("look", F.lit("x"))
    want = {"quality_rules": {20: 2, 21: 2, 30: 1, None: 2}, "ngram_jaccard_join": {20: 2, 21: 1, 30: 1, None: 2}}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name != "sharding":
            assert out.columns == docs.columns
        got = Counter(r["doc_id"] for r in rows)
        if name == "quality_rules":
            assert got == want[name]
        elif name == "ngram_jaccard_join":
            assert {k: got[k] for k in want[name]} | {None: got[None]} == want[name] | {None: 3}
            assert got[5] == 1 and got[1] == got[2] == got[3] == got[4] == 1
        elif name == "benchmark_decontamination":
            assert len(rows) == docs.count()
        elif name == "source_mixing":
            assert set(got) <= {r["doc_id"] for r in docs.collect()} and max(got.values()) <= 12 and not {1, 2, 3} & set(got)
        else:
            assert len(rows) == docs.count()


def test_results_outlive_other_runs(spark, sf, docs):
    """What one call left for its result is deleted by its owner only."""
    from corpusforge.llm import mixing, sharding

    mixed, placed = mixing.mix_sources(docs), sharding.assign_shards(docs)
    want = sorted(mixed.collect()), placed.count()
    before = mixing.take_mix(docs)
    made = corpus_pipeline.run(spark, sf)
    assert (sorted(mixed.collect()), placed.count()) == want and before.count() > 0 and made.count() > 0
    with common.owning(spark) as owner:
        kept = sharding.assign_shards(docs)
        assert kept.count() == want[1] and len(owner.paths) == 1
    assert not owner.paths
    folder = common.shared_root(spark).removeprefix("file://") + "/corpusforge"
    names = Counter(n.rsplit("-", 1)[0] for n in os.listdir(folder))
    jac = names["components"] + names["sketches"]
    from corpusforge.llm import jaccard_join

    found = jaccard_join.jaccard_components(docs)
    names = Counter(n.rsplit("-", 1)[0] for n in os.listdir(folder))
    assert names["components"] + names["sketches"] == jac + 1 and found.count() == docs.count()


def test_long_pages_and_turns(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", ("é" if i % 2 else "x") * (3_000_000 + i % 3), 0, 0, 0) for i in range(6)], PAGES)
    rows = {r["page_id"]: r for r in warc.archive_round_trip(pages).collect()}
    assert [rows[i]["payload_bytes"] for i in range(6)] == [(2 if i % 2 else 1) * (3_000_000 + i % 3) for i in range(6)]
    assert all(r["record_type"] == "response" for r in rows.values())
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", ("word %d " % t) * 60_000 + ("end" if t == 3 and c else "")) for c in (0, 1) for t in range(4)]
    made = chat.preference_digest(spark.createDataFrame([(*t, 0, 0, 0) for t in turns], CONV)).first()
    assert made["n_prompt_turns"] == 3 and len(made["rejected"]) == len(made["chosen"]) + 3
    start, end = map(int, made["chosen_mask"].split(":"))
    assert made["chosen"][start:end].startswith("word 3 ") and end == len(made["chosen"])


def test_equal_pages_are_dealt_out_without_their_payload(spark):
    """A third of the pages equal: revisits carry no payload, responses need no shuffle."""
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("same "), 400)).otherwise(F.concat(F.repeat(F.lit("x"), 200), F.col("id"))).alias("html"))
    folder = common.Scratch(spark).path("warc-hot")
    index = warc.write_archives(pages, folder)
    kinds = {r["record_type"]: r["count"] for r in index.groupBy("record_type").count().collect()}
    assert kinds == {"response": 2001, "revisit": 999} and index.where("record_type = 'revisit'").agg(F.max("refers_to"), F.min("refers_to")).first()[0] == 0
    assert warc.read_records(index, folder).where("record_type = 'response'").select(F.max(F.length("payload"))).first()[0] == 2000

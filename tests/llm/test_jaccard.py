import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corpusforge.llm import jaccard_join as J
from corpusforge.llm.common import Scratch, mark_possible_members
from corpusforge.llm.components import connected_components

SCHEMA = "doc_id long, text string, cid string, look long"


def brute(rows, k=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            up[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)) if d is not None)


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    return J.jaccard_components(df, **options)


def corpus(n=120, seed=5):
    """Near copies at every distance, a passage that many share, copies, short and odd texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    base, passage = [r.choice(words) for _ in range(120)], [r.choice(words) for _ in range(70)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(0, 14)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(passage + [r.choice(words) for _ in range(r.randrange(5, 60))])) for i in range(n)]
    rows += [(2000 + i, " ".join(r.choice(words) for _ in range(r.randrange(1, 9)))) for i in range(30)]
    rows += [(3000, None), (3001, ""), (3002, " \n\t"), (3003, "A B c"), (3004, "a b C"), (3005, rows[0][1]), (3005, rows[0][1]), (3006, "one two three four five six"), (3007, "x " * 30000)]
    return rows


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 7}, {"chunk_rows": 7, "direct_work": 1e9}, {"chunk_rows": 20, "direct_work": 1e9, "sketch": 16}, {"chunk_rows": 7, "direct_work": 0, "deep_sketch": 128}, {"chunk_shingles": 900, "sketch": 32}])
def test_equals_brute_force(spark, options):
    rows = corpus()
    got = sorted(tuple(r) for r in run(spark, rows, **options).collect())
    assert got == brute(rows)


def test_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (None, "other text here"), (9, None)]
    assert sorted(map(str, (tuple(r) for r in run(spark, rows).collect()))) == sorted(map(str, [(None, 2, 7), (None, 2, 7), (7, 2, 7), (None, 1, None), (9, 0, 9)]))
    assert J.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one(spark):
    rows = corpus(40) + [(None, "lonely text without id"), (None, "lonely text without id"), (None, "second lonely text")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    kept = J.keep_one_per_component(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({d for d, _, c in brute(rows) if d == c})
    assert ids.count(None) == 2


def test_keep_one_judges_each_row_by_its_own_component(spark):
    one, two, three, lone, other = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [
        (1, one), (5, one + " near"), (5, two), (5, two), (5, two + " near"), (5, three), (5, three.upper()),
        (None, one), (None, lone), (None, lone), (7, None), (7, None), (7, ""), (7, other), (8, two), (9, "one id"),
    ]
    kept = J.keep_one_per_component(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)).collect()
    got = sorted(((r["doc_id"], (r["text"] or str(r["text"])).lower()[:4]) for r in kept), key=str)
    want = [(1, "a0 a"), (5, "b0 b"), (5, "c0 c"), (None, "d0 d"), (7, "none"), (7, ""), (7, "e0 e"), (9, "one ")]
    assert got == sorted(want, key=str)


def test_heap_merge_and_search_agree(spark):
    assert list(J.heap_merge([[1, 3, 5], [1, 5], [], [5]])) == [(1, 2), (3, 1), (5, 3)]
    rows = corpus(60)
    small, probes, J.SMALL_MERGE = J.SMALL_MERGE, J.PROBES, 0

    def links():
        block = J._Block(75, 100)
        for i, (_, t) in enumerate(rows):
            s = J.shingle_set(t)
            if len(s):
                block.add(i, s, True)
        block.run(None)
        return connected(block.links)

    def connected(pairs):
        up = {}
        for a, b in pairs:
            up.setdefault(a, {a}), up.setdefault(b, {b})
            both = up[a] | up[b]
            for x in both:
                up[x] = both
        return {frozenset(x) for x in up.values()}

    try:
        by_count = links()
        J.SMALL_MERGE = 10**9
        by_heap = links()
        J.PROBES = 1
        by_single_probes = links()
    finally:
        J.SMALL_MERGE, J.PROBES = small, probes
    assert by_count == by_heap == by_single_probes


def test_overlap_bound():
    assert J.required_overlap(75, 100, 32) == 1 and J.required_overlap(75, 100, 64) == 13 and J.required_overlap(75, 100, 512) > 270


def test_route_at_the_end_of_the_exact_bound(spark):
    """385 shingles and a subset of 289 of them, which a third document has too."""
    assert 100 * 289 >= 75 * 385
    sets = {0: [*range(289), *range(1000, 1711)], 1: list(range(385)), 2: list(range(289))}
    rows = spark.createDataFrame([(c, len(v), v[:512]) for c, v in sets.items()], "cid long, n long, sketch array<long>")
    leads = {c: {c} for c in sets}
    with Scratch(spark) as scope:
        for r in J._route(rows, 75, 100, 512, scope).collect():
            leads[r["cid"]].add(r["lead"])
    assert leads[1] & leads[2]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 201), (201, 200), (5, 5), (None, 3)] + [(500, 500 + i) for i in range(1, 300)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "u long, v long"), Scratch(spark)).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == got[201] == 200 and all(got[500 + i] == 500 for i in range(300)) and len(got) == 61 + 2 + 300
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).count() == 0


@pytest.mark.parametrize("bits", [None, 1 << 16, 1 << 26])
def test_bitmap_never_misses(spark, bits):
    df = spark.range(20000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit(1).alias("_bits2"))
    members = df.where("k % 7 = 0 or k is null")
    out = mark_possible_members(df, "k", members, "m", bits)
    assert out.where("(k % 7 = 0 or k is null) and not m").count() == 0
    assert out.count() == 20000 and out.where("m").count() < (8000 if bits == 1 << 16 else 4200)


def test_no_leader_is_one_task(spark):
    """Members, stragglers and cells of one hot leader are dealt out by salt."""
    rows = spark.range(20000).select(F.lit(1).cast("long").alias("lead"), F.col("id").alias("cid"), (F.col("id") % 10).cast("int").alias("chunk"))
    leads = spark.createDataFrame([(1, 10), (2, 3)], "lead long, chunks int")
    joined = J._salted(rows, leads)
    assert joined.count() == 20000 and joined.select("lead", "cid", "chunk", "chunks").distinct().count() == 20000
    salts = rows.select(F.pmod(F.xxhash64("cid", F.lit(3)), F.lit(J.SALTS)).alias("s")).groupBy("s").count().agg(F.max("count")).first()[0]
    assert salts < 3 * 20000 / J.SALTS


def test_cells_are_bounded(spark):
    with Scratch(spark) as scope:
        placed = spark.range(3000).select(F.lit(0).cast("long").alias("lead"), F.pmod("id", F.lit(30)).cast("int").alias("chunk"), F.col("id").alias("cid"))
        rest = placed.where("cid % 2 = 1").select("lead", "cid", F.lit(30).alias("chunks"))
        cells = J._cells(placed, rest, 100, scope).groupBy("lead", "chunk").agg(F.count_if("query").alias("q"), F.count_if(~F.col("query")).alias("h")).collect()
        assert len(cells) == 30 * 15 and max(r["q"] for r in cells) < 200 and {r["h"] for r in cells} == {100}
        assert sum(r["q"] for r in cells) == 1500 * 30

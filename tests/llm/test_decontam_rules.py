import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusforge.llm import decontam as D
from corpusforge.llm import quality_rules as Q

ITEMS = "item_id long, text string"


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, it in items:
            b = words(it)
            n = min(10, len(b))
            for s in {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else ():
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) == s:
                        hit.update(range(p, p + n))
                        found.add(i)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(str(i) for i in found if i is not None)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def cases():
    r = random.Random(3)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(1, 40)))) for i in range(25)] + [(30, "A, b; C!"), (31, ""), (32, None), (None, "null id item of at least ten words to be one window"), (-1, "null id item of at least ten words to be one window too"), (33, "rep " * 30), (3, "second text of item three"), (34, "Ünï cödé w0rds")]
    docs = []
    for i in range(120):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 60))]
        if i % 3 == 0:
            b = (items[r.randrange(25)][1]).split()
            a = r.randrange(len(b))
            w[5:5] = b[a : a + r.randrange(1, 30)]
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "rep " * 5000), (203, "x null id item of at least ten words to be one window y"), (204, "a B c"), (205, "ünï cödé W0RDS"), (206, "Ünï cödé w0rds"), (206, "Ünï cödé w0rds"), (None, "a b c")]
    return docs, items


@pytest.mark.parametrize("block", [D.BLOCK_WORDS, 60])
def test_equals_brute_force(spark, block):
    docs, items = cases()
    df = spark.createDataFrame([(d, t, 1, 1) for d, t in docs], "doc_id long, text string, _n_words int, value int")
    got = D.contamination_report(df, spark.createDataFrame(items, ITEMS), block_words=block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)


def test_empty_tables(spark, odd):
    none = spark.createDataFrame([], ITEMS)
    assert D.contamination_report(odd, none).where("contaminated").count() == 0
    assert D.contamination_report(odd.limit(0), none).count() == 0
    kept = D.drop_contaminated(odd, spark.createDataFrame([(1, "word")], ITEMS))
    assert kept.count() == odd.count() - 2 and kept.columns == odd.columns
    assert {r["_n_words"] for r in kept.collect()} == {0}


def test_winnow_guarantee():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 50, 400).astype(np.uint64)
    kept = D.winnow(grams, 6)
    assert all(((kept >= p) & (kept < p + 6)).any() for p in range(len(grams) - 5))
    assert D.excise("One, TWO three; four", [(1, 3)]) == "One, ; four"
    assert D.merge_spans([(5, 7), (0, 3), (2, 5)]) == [(0, 7)]


def rule_brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_rules_equal_brute_force(spark, docs, odd):
    extra = spark.createDataFrame([(-1, "a b a b a b a\nx\nx\r\nx\r", None, None, 0), (-2, "one two\nthree one two\nthree", None, None, 0), (-3, "a  b", None, None, 0)], docs.schema)
    for df in (docs.union(extra), odd):
        texts = Counter((r["doc_id"], *rule_brute(r["text"])) for r in df.collect())
        got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in Q.quality_report(df).collect())
        assert got == texts


def test_rules_keep_clean_documents(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = Q.quality_report(docs).join(labels, "doc_id").toPandas()
    assert r[(r.quality == 1) & ~r.base_failed].kept.all()
    assert not r[r.base_failed].kept.any()


def test_rules_columns_and_plan(spark, odd):
    assert Q.keep_good(odd).columns == odd.columns and Q.keep_good(odd.limit(0)).count() == 0
    plan = Q.quality_report(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange"))

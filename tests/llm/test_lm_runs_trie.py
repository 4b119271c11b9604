"""Language-model scores, periodic runs and the prefix trie against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusforge.llm import lm_scoring, prefix_trie, runs
from corpusforge.llm.common import owning
from corpusforge.llm.queries import op11_lm_scoring, op12_periodic_runs

DOC = "doc_id long, text string"


def crc(x):
    return zlib.crc32(b"" if x is None else str(x).encode())


# --- runs ---------------------------------------------------------------------


def all_runs(words):
    """Every period compared with the whole sequence; the smallest period of equal ends stays."""
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    s, found = np.array([names[w] for w in words], dtype=np.int64), {}
    for q in range(1, len(s) // 4 + 1):
        same = np.concatenate(([0], (s[q:] == s[:-q]).astype(np.int8), [0]))
        edge = np.flatnonzero(np.diff(same))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            length = b - a + q
            if length >= max(6, 4 * q):
                found.setdefault((a, length), q)
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_sequences(seed):
    rng = random.Random(seed)
    for _ in range(400):
        n, letters = rng.randint(1, 90), rng.choice([1, 2, 2, 3, 6])
        words = [b"%d" % rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            a, p = rng.randrange(n), rng.randint(1, 9)
            for i in range(a + p, min(n, a + rng.randint(1, 60))):
                words[i] = words[i - p]
        if rng.random() < 0.4:
            words += words[: rng.randint(0, n)]
        assert runs.periodic_runs(words) == all_runs(words), words


def test_previous_factors():
    rng = random.Random(1)
    for _ in range(100):
        s = np.array([rng.randrange(3) for _ in range(rng.randint(1, 40))])
        order, ranks = runs.suffix_array(s)
        t = s.tolist()
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        length, place = runs.longest_previous_factors(order, runs.lcp_array(order, ranks))
        for i in range(len(t)):
            best = max((next(k for k in range(len(t) - i + 1) if i + k == len(t) or t[j + k] != t[i + k]) for j in range(i)), default=0)
            assert length[i] == best
            assert best == 0 or (place[i] < i and t[place[i] : place[i] + best] == t[i : i + best])


def want_runs(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), crc(doc_id)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    dropped = {i for a, size, q in found for i in range(a + q, a + size)}
    lines = "".join(f"{a},{size},{q}\n" for a, size, q in found)
    rest = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())


def test_op12(spark, sf, docs):
    got = sorted(map(tuple, op12_periodic_runs(spark, sf).collect()))
    assert got == sorted(want_runs(r.doc_id, r.text) for r in docs.collect())
    assert sum(r[1] for r in got) > 10


def test_runs_edge_cases(spark, odd):
    got = runs.run_report(odd).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((want_runs(r.doc_id, r.text) for r in odd.collect()), key=repr)
    assert runs.run_report(odd.limit(0)).count() == 0
    spans = {r.doc_id: r.runs for r in runs.find_runs(odd).collect()}
    assert [tuple(x) for x in spans[4]] == [(0, 75000, 5)] and spans[1] == []


# --- language model -----------------------------------------------------------


def tokens_of(text):
    return [*(text or "").encode().lower().split(), b""]


def brute_scores(rows, order=3):
    """(doc index -> columns) with dictionaries instead of batches."""
    parts = [crc(i) % 10 for i, _ in rows]
    grams = lambda toks, k, i: tuple(toks[j] if j >= 0 else None for j in range(i - k + 1, i + 1))

    def count(keep):
        c = [Counter() for _ in range(order + 1)]
        for (_, text), m in zip(rows, parts, strict=True):
            if keep(m):
                toks = tokens_of(text)
                c[0][()] += 1
                for k in range(1, order + 1):
                    c[k].update(grams(toks, k, i) for i in range(len(toks)))
        return c

    def estimate(c, toks, i):
        total = sum(c[1].values())
        f, bucket = [c[1][grams(toks, 1, i)] / max(1, total)], 0
        for k in range(2, order + 1):
            context = c[0][()] if i == 0 else c[k - 1][grams(toks, k - 1, i - 1)]
            f.append(c[k][grams(toks, k, i)] / context if context else 0.0)
            if context:
                bucket = (k - 2) * lm_scoring.WIDTH + min(lm_scoring.WIDTH, context.bit_length())
        return bucket, f

    kept, full = count(lambda m: m > 1), count(lambda m: m > 0)
    held = defaultdict(list)
    for (_, text), m in zip(rows, parts, strict=True):
        if m == 1:
            toks = tokens_of(text)
            for i in range(len(toks)):
                b, f = estimate(kept, toks, i)
                held[b].append(f)
    weights = {}
    usable = lambda b: [True, True, *(b > (k - 2) * lm_scoring.WIDTH for k in range(2, order + 1))]
    for b in range((order - 1) * lm_scoring.WIDTH + 1):
        weights[b] = [u / sum(usable(b)) for u in usable(b)]
    for _ in range(lm_scoring.STEPS):
        moved = 0.0
        for b, fs in held.items():
            e = [0.0] * (order + 1)
            for f in fs:
                share = [weights[b][0] / (len(kept[1]) + 1), *(w * x for w, x in zip(weights[b][1:], f, strict=True))]
                for k in range(order + 1):
                    e[k] += share[k] / sum(share)
            e = [x + lm_scoring.PRIOR if u else 0 for x, u in zip(e, usable(b), strict=True)]
            new = [x / sum(e) for x in e]
            moved = max(moved, *(abs(x - y) for x, y in zip(new, weights[b], strict=True)))
            weights[b] = new
        if moved < lm_scoring.SETTLED:
            break
    n, v, out = sum(full[1].values()), len(full[1]), []
    for (doc_id, text), m in zip(rows, parts, strict=True):
        toks, score, base, known = tokens_of(text), 0.0, 0.0, 0
        for i, t in enumerate(toks):
            b, f = estimate(full, toks, i)
            score += math.log10(weights[b][0] / (v + 1) + sum(w * x for w, x in zip(weights[b][1:], f, strict=True)))
            base += math.log10((full[1][(t,)] + 0.1) / (n + 0.1 * (v + 1)))
            known += full[1][(t,)] > 0
        out.append((doc_id, m == 0, len(toks), known, n, round(base, 5), round(score, 5)))
    return out


def rounded(df):
    return sorted(((*r[:5], round(r[5], 5), round(r[6], 5)) for r in df.collect()), key=repr)


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-4) and g[6] == pytest.approx(w[6], abs=1e-4)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_against_dictionaries(spark, docs, order):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    if order != 3:
        rows = rows[:60]
    close(rounded(lm_scoring.corpus_scores(spark.createDataFrame(rows, DOC), order)), brute_scores(rows, order))


def test_small_batches_and_ranges_change_nothing(spark, sf, docs, monkeypatch):
    once = rounded(op11_lm_scoring(spark, sf))
    monkeypatch.setattr(lm_scoring, "BATCH_TOKENS", 500)
    monkeypatch.setattr(lm_scoring, "RANGE_KEYS", 2000)
    close(rounded(lm_scoring.corpus_scores(docs)), once)


def test_model_beats_the_base_on_held_out_text(spark, sf):
    rows = [r for r in op11_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)


def test_probabilities_add_up(spark):
    """Over all known words and one unknown, the last token's probabilities sum to 1."""
    learn = [(i, t) for i, t in enumerate(["a b c a b", "b c a", "a a b", "c b a b", "a b"] * 8)]
    asked = [i for i in range(1000, 4000) if crc(i) % 10 == 0][:4]
    rows = learn + [(i, f"a b {w}") for i, w in zip(asked, ["a", "b", "c", "zz"], strict=True)]
    got = {r.doc_id: r.score for r in lm_scoring.corpus_scores(spark.createDataFrame(rows, DOC)).collect()}
    want = {r[0]: r[6] for r in brute_scores(rows)}
    assert all(got[i] == pytest.approx(want[i], abs=1e-4) for i in asked)


def test_scores_edge_cases(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    close(rounded(lm_scoring.corpus_scores(odd)), brute_scores(rows))
    assert lm_scoring.corpus_scores(odd.limit(0)).count() == 0
    only = [(i, "x y") for i in range(2000) if crc(i) % 10 == 0][:3]
    assert [(r.score, r.base_score, r.train_tokens) for r in lm_scoring.corpus_scores(spark.createDataFrame(only, DOC)).collect()] == [(0, 0, 0)] * 3


def test_packed_numbers():
    for values in ([], [0], [0, 0], [255, 256, 2**63]):
        assert lm_scoring.unpack(lm_scoring.pack(np.array(values, dtype=np.uint64))).tolist() == values


# --- prefix trie --------------------------------------------------------------


def brute_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest()
            convs[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}
    paths = {}
    for c in turns:
        h = crc(c) % 6
        paths[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = []
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(who) if len(paths[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TRIE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
CONV = "conv_id long, turn int, role string, text string"


def check_trie(spark, rows):
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, CONV))
    assert sorted((tuple(r) for r in got.select(*TRIE).collect()), key=repr) == brute_trie(rows)


@pytest.mark.parametrize("seed", range(3))
def test_trie_of_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-250, 450), 90) + [0, 100, 200]:
        for t in range(rng.randint(1, 8)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "\U0001f600c"])))
    check_trie(spark, rows)


def test_trie_edge_cases(spark):
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, None, "user", "late"), (7, 3, "user", ""), (8, 3, "b", "tie"), (8, 3, "a", "tie"), (8, 3, "a", "tie"), (100, 0, "user", "y" * 50_000)]
    rows += [(101, 0, "user", "y" * 50_000), (101, 1, "assistant", "z")]
    check_trie(spark, rows)
    check_trie(spark, [(10_000 + i, t, "user", "same") for i in range(300) for t in range(2)])
    empty = spark.createDataFrame([], CONV)
    assert prefix_trie.conversation_trie(empty).count() == 0
    more = spark.createDataFrame([(1, 0, "u", "t", 5, "x")], CONV + ", depth int, owner string")
    assert prefix_trie.conversation_trie(more).count() == 2 or crc(1) % 6 > 0


def test_trie_with_frequent_prefixes(spark, monkeypatch):
    from corpusforge.llm import common

    monkeypatch.setattr(common, "HEAVY", 3)
    monkeypatch.setattr(prefix_trie, "PACKED", 8)
    rng = random.Random(9)
    check_trie(spark, [(c, t, "user", "hello" if t < 2 else rng.choice("ab")) for c in range(200) for t in range(rng.randint(1, 6))])


def test_owned_tables_go(spark, sf):
    with owning(spark) as owner:
        prefix_trie.conversation_trie(spark.read.parquet(f"{sf}/conversations.parquet")).count()
        assert len(owner.paths) == 1

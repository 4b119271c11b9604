import hashlib
import math
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusforge.llm import language_id as L
from corpusforge.llm import pii as P
from corpusforge.llm import quality_classifier as C


def base_brute(t):
    """The patterns as they are written, leftmost and non-overlapping."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m.group())
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_equals_the_patterns(docs):
    rng = np.random.default_rng(2)
    alphabet = list("ab.@-_%+ 0123456789()\n") + ["é", "\U0001f600"]
    random_texts = ["".join(rng.choice(alphabet, rng.integers(0, 80))) for _ in range(3000)]
    fixed = ["a.b@c.d_e@f.g 1.2.3.4.5 256.1.1.1 01.002.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 123-4567 ++12", "a@b@c.d", "x@.y @z.w"]
    for t in random_texts + fixed + [r["text"] or "" for r in docs.collect()]:
        assert P.detect(t) == base_brute(t), t


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail john [dot] doe (at) example [dot] com now", [("email", "john [dot] doe (at) example [dot] com")]),
        ("jane at example dot org", [("email", "jane at example dot org")]),
        ("call plus one five five five one two three four five six seven ok", [("phone", "plus one five five five one two three four five six seven")]),
        ("ip 192 dot 168 dot 1 dot 10!", [("ip", "192 dot 168 dot 1 dot 10")]),
        ("jоhn@exаmple.com", [("email", "jоhn@exаmple.com")]),
        ("４１１１ １１１１ １１１１ １１１１", [("card", "４１１１ １１１１ １１１１ １１１１")]),
        ("j​ohn@ex​ample.com", [("email", "j​ohn@ex​ample.com")]),
        ("look at the dot on it, we met at noon. three two one go", []),
        ("plain@example.com stays base", []),
        ("write bosbt.42 at mail8.example.com today", [("email", "bosbt.42 at mail8.example.com")]),
        ("it is available at example.com or 3 @ 4.5 each, m² and 5º", []),
        ("john @ example.com", [("email", "john @ example.com")]),
        ("john-at-example-dot-com", [("email", "john-at-example-dot-com")]),
        ("𝓳𝓸𝓱𝓷@example.com and ⓐ", [("email", "𝓳𝓸𝓱𝓷@example.com")]),
        ("4111 1111 one one one one 1111", [("card", "4111 1111 one one one one 1111")]),
        ("+1 (five five five) 123-4567", [("phone", "+1 (five five five) 123-4567")]),
        ("null eins zwei drei vier", []),
        ("we are at this point in the story, look at the point me", []),
        ("paul at firma punkt de, jo.doe at casa punto es", [("email", "jo.doe at casa punto es")]),
        ("½ ² ① Ⅳ", []),
        ("", []),
    ],
)
def test_deobfuscation(text, found):
    base, added = P.find_spans(text)
    assert base == P.detect(text)
    assert [(k, text[a:b]) for k, a, b in added] == found


@pytest.mark.parametrize(
    ("text", "base", "found"),
    [
        ("mail j\u043ehn@example.com", "hn@example.com", [("email", "j\u043ehn@example.com")]),
        ("jo\u200bhn@example.com", "hn@example.com", [("email", "jo\u200bhn@example.com")]),
        ("john [dot] doe@example.com", "doe@example.com", [("email", "john [dot] doe@example.com")]),
        ("jane@mail.example [dot] com now", "jane@mail.example", [("email", "jane@mail.example [dot] com")]),
        ("john@mail.g\u043eogle.com", "john@mail.g", [("email", "john@mail.g\u043eogle.com")]),
        ("+1 555 123 456 seven eight nine", "+1 555 123 456", [("phone", "+1 555 123 456 seven eight nine")]),
        ("three two one@example.com", "one@example.com", []),
        ("john@example.com\u200b, +1 555 123 4567\u200b", "john@example.com", []),
    ],
)
def test_disguise_on_one_side_extends_the_base_span(text, base, found):
    spans, added = P.find_spans(text)
    assert spans == P.detect(text) and text[spans[0][1] : spans[0][2]] == base
    assert [(k, text[a:b]) for k, a, b in added] == found
    for _, a, b in added:
        assert P.redact(text, spans + added) == P.redact(text, added)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("plus 4 nine 1 five 1 two 3 four 5 six", ["plus 4 nine 1 five 1 two 3 four 5 six"]),
        ("+4 nine 1 five 1 two 3 four 5 six ok", ["+4 nine 1 five 1 two 3 four 5 six"]),
        ("call +one 555 123 4567", ["+one 555 123 4567"]),
        ("call +1 555 one 23 4567", ["+1 555 one 23 4567"]),
        ("call +1 555 123 45 six seven.", ["+1 555 123 45 six seven"]),
        ("4111 1111 1111 111 one", ["4111 1111 1111 111 one"]),
        ("in 2019 one of 30, chapter 5 two or three 12", []),
        ("5 one@example.com", []),
        ("+49 151 2345678. One of us", []),
    ],
)
def test_few_spelled_digits_among_plain_ones(text, found):
    base, added = P.find_spans(text)
    assert base == P.detect(text)
    assert [text[a:b] for _, a, b in added] == found


def test_added_spans_of_later_kinds_are_not_inside_earlier_ones():
    """However many lie between: each disguised address has an address-like part of its own."""
    text = " ".join(f"u{i}@1.2.3.{i}​4.example.com" for i in range(12))
    base, added = P.find_spans(text)
    mails = [(a, b) for k, a, b in added if k == "email"]
    assert len(mails) == 12 and not any(a <= s[1] and s[2] <= b for a, b in mails for s in added if s[0] != "email")


def test_redact_covers_overlapping_spans():
    assert P.redact("0123456789", [("email", 1, 4), ("phone", 3, 7), ("card", 8, 9)]) == "0[EMAIL]7[CARD]9"


def test_long_texts_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000, "a@" * 100_000, "one two " * 30_000, "one 1 " * 30_000, "1 one dot " * 20_000, "x at y dot " * 20_000):
        P.find_spans(t)
    for n in (100_000, 400_000):  # blank runs beside a sign
        for t in (f"é‍{' ' * n}x", f"a ‍@{' ' * n}b", f"x [ {' ' * n}at", f"one{' ' * n}two{' ' * n}", f"[at]{' ' * n}[dot]{' ' * n}", f"a{' ' * n}at{' ' * n}b dot com"):
            began = time.process_time()
            P.find_spans(t)
            assert time.process_time() - began < 5, (n, t[:8])


def test_clean_documents_get_no_spans(docs):
    assert all(not P.find_spans(r["text"])[1] for r in docs.collect())


def test_pii_rows(spark, odd):
    rows = P.personal_data(odd).collect()
    assert len(rows) == odd.count() and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    assert P.personal_data(odd.limit(0)).count() == 0
    assert P.redact("a@b.c and +1 555 123 4567", P.detect("a@b.c and +1 555 123 4567")) == "[EMAIL] and [PHONE]"


def test_language(spark, docs, odd):
    out = L.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang_pred == out.lang).mean() >= 0.95 and out.score.between(0, 1).all()
    rows = L.identify_languages(odd).collect()
    assert len(rows) == odd.count() and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert L.identify_languages(odd.limit(0)).count() == 0
    assert {r["lang_pred"] for r in L.identify_languages(odd.withColumn("lang", odd["lang"].substr(9, 0)).where("lang is null")).collect()} <= {"und"}


def test_ngrams_equal_brute_force():
    text = "Ab, bä! 12 ab"
    s = " ab bä ab "
    want = Counter(s.replace(" ", "")) + Counter(s[i : i + 2] for i in range(len(s) - 1)) + Counter(s[i : i + 3] for i in range(len(s) - 2))
    codes, counts = L.ngrams(text)
    spell = lambda c: "".join(chr((c >> k) & 0x1FFFFF) for k in (42, 21, 0) if (c >> k) & 0x1FFFFF)
    assert {spell(int(c)): int(n) for c, n in zip(codes, counts, strict=True)} == dict(want)


def brute_profiles(rows, size):
    """Ranked n-grams by language, by counting characters."""
    grams = {}
    for lang, text in rows:
        c = grams.setdefault(lang, Counter())
        letters = "".join(x if unicodedata.category(x)[0] == "L" else " " for x in (text or "").lower())
        s = f" {' '.join(letters.split())} " if letters.strip() else ""
        c.update(x for x in s if x != " ")
        c.update(s[i : i + 2] for i in range(len(s) - 1))
        c.update(s[i : i + 3] for i in range(len(s) - 2))
    order = lambda g: (len(g), g)  # codes grow with the length, then by code points
    return {k: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], order(x[0])))[:size]] for k, c in grams.items()}


def test_language_equals_brute_force(spark, docs):
    """Learning, ranking and out-of-place distance, on all rows of the small table."""
    rows = docs.select("doc_id", "text", "lang").collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    profiles = brute_profiles([(r["lang"], r["text"]) for r in rows if r["lang"] is not None and not held(r["doc_id"])], L.PROFILE)
    want = {}
    for r in rows:
        own = brute_profiles([("x", r["text"])], L.PROFILE)["x"]
        if not own:
            want[r["doc_id"]] = ("und", 0.0)
            continue
        gaps = {k: sum(min(abs(p.index(g) - i), L.PROFILE) if g in set(p) else L.PROFILE for i, g in enumerate(own)) / (L.PROFILE * len(own)) for k, p in profiles.items()}
        best = min(sorted(gaps), key=gaps.get)
        want[r["doc_id"]] = (best, 1 - gaps[best])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify_languages(docs, learn_docs=10**9).collect()}
    assert {d: p[0] for d, p in got.items()} == {d: p[0] for d, p in want.items()}
    assert all(got[d][1] == pytest.approx(want[d][1]) for d in want)


def test_numerals_are_no_letters():
    for t in ("½ ² ① Ⅳ ٣", "12 ³", "_", "🙂"):
        assert L.ngrams(t)[0].size == 0
    assert L.ngrams("ª")[0].size and L.ngrams("中")[0].size


def test_rows_without_id_are_sampled_one_by_one(spark):
    rows = [(None, f"{'der die das und ' if i % 2 else 'the of and to '}{'abcdefghij'[i % 10] * (i % 7 + 1)} {i}", "de" if i % 2 else "en") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = L.learn_profiles(df, learn_docs=200)
    assert made.names == ["de", "en"] and made.predict("der die das")[0] == "de"


def brute_statistics(text):
    """The sixteen statistics from their names, word by word."""
    raw = (text or "").encode()
    words = raw.split()
    shown = [b for b in raw if b > 32]
    n, chars = len(words), max(1, len([b for b in raw if b >= 33]))
    lines = [x.strip() for x in raw.split(b"\n") if x.strip()]
    root = lambda x: math.asin(math.sqrt(min(1, max(0, x))))
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    upper, lower = (sum(a <= b <= z for b in raw) for a, z in ((65, 90), (97, 122)))
    triples = [tuple(words[i : i + 3]) for i in range(n - 2)]
    kinds, places = Counter(words), Counter(shown)
    return [
        math.log1p(n),
        math.log1p(mean),
        math.log1p(math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes))),
        root(sum(33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"!?()-" for b in raw) / chars),
        root(sum(48 <= b <= 57 for b in raw) / chars),
        root(upper / max(1, upper + lower)),
        root(sum(b >= 128 for b in raw) / chars),
        root(len(kinds) / max(1, n)),
        root(1 - len(set(triples)) / len(triples) if triples else 0),
        root(1 - len(set(lines)) / len(lines) if lines else 0),
        math.log1p(n / max(1, len(lines))),
        root(sum(w[-1:] in (b".", b"!", b"?", b",", b";", b":") for w in words) / max(1, n)),
        root(sum(words[i] == words[i + 1] for i in range(n - 1)) / max(1, n)),
        -sum(c / chars * math.log(c / chars) for c in places.values()),
        root(max(kinds.values(), default=0) / max(1, n)),
        root(sum(s <= 2 for s in sizes) / max(1, n)),
    ]


def test_statistics_equal_brute_force(docs):
    for t in [r["text"] for r in docs.collect()] + [None, "", " \n", "a", "A a a. a a a!", "x\nx\n\ny", "é ü 12 #$"]:
        assert C.document_statistics(t) == pytest.approx(brute_statistics(t), abs=1e-9), t


def test_quality_equals_brute_force(spark, sf, docs):
    """The whole query: statistics, class moments, both shrinkages, densities."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    x = {r["doc_id"]: np.array(brute_statistics(r["text"])) for r in docs.collect()}
    train = [d for d in x if d in known and zlib.crc32(str(d).encode()) % 5]
    rows, y = np.array([x[d] for d in train]), np.array([known[d] for d in train])
    center, scale = rows.mean(0), np.where(rows.std(0) > 1e-9, rows.std(0), 1)
    z, p = (rows - center) / scale, rows.shape[1]
    cov = {c: np.cov(z[y == c].T, bias=True) for c in (0, 1)}
    both = sum(cov[c] * (y == c).sum() for c in (0, 1)) / len(y)
    got = {r["doc_id"]: r["score"] for r in C.quality_scores(docs, labels).collect()}
    for d, v in x.items():
        density = []
        for c in (0, 1):
            s = (1 - C.POOLED) * cov[c] + C.POOLED * both
            s = (1 - C.RIDGE) * s + C.RIDGE * (np.trace(s) / p + 1e-6) * np.eye(p)
            gap = (v - center) / scale - z[y == c].mean(0)
            density.append(-0.5 * gap @ np.linalg.solve(s, gap) - 0.5 * np.linalg.slogdet(s)[1] + np.log(((y == c).sum() + 1) / (len(y) + 2)))
        assert got[d] == pytest.approx(1 / (1 + np.exp(-np.clip(density[1] - density[0], -C.CLIP, C.CLIP))), abs=1e-6)


def test_quality(spark, sf, docs, odd):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = C.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() >= 0.8 and out.score.between(0, 1).all()
    rows = C.quality_scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = C.quality_scores(odd, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert C.quality_scores(odd.limit(0), labels).count() == 0


def test_discriminant_equals_densities():
    """Against the textbook formula, without shrinkage."""
    p = len(C.FEATURES)
    rng = np.random.default_rng(0)
    x = {0: rng.normal(0, 1, (400, p)), 1: rng.normal(0.5, 2, (300, p))}
    moments = {c: np.hstack([np.ones((len(v), 1)), v]).T @ np.hstack([np.ones((len(v), 1)), v]) for c, v in x.items()}
    model = C.Discriminant(moments, pooled=0.0, ridge=0.0)
    probe = rng.normal(0.2, 1, (20, p))
    want = []
    for row in probe:
        d = []
        for c in (0, 1):
            cov = np.cov(x[c].T, bias=True)
            z = row - x[c].mean(0)
            d.append(-0.5 * z @ np.linalg.solve(cov, z) - 0.5 * np.linalg.slogdet(cov)[1] + np.log((len(x[c]) + 1) / 702))
        want.append(1 / (1 + np.exp(-np.clip(d[1] - d[0], -30, 30))))
    assert model.score(probe) == pytest.approx(np.array(want), abs=1e-6)

"""Recall of generated disguises against their known spans, and the mapping of rewritten
texts against a version that carries a span for each character."""

import random

import pytest

from corpusforge.llm import pii as P

FILLER = "please write to me soon about the garden and the old house by the river before we meet again".split()
LOOKALIKE = {v: k for k, v in reversed(P.HOMOGLYPHS.items()) if v.isalpha()}
DIGITS = "zero one two three four five six seven eight nine".split()


def wide(t):
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t)


def swap_letters(r, t):
    at = [i for i, c in enumerate(t) if c in LOOKALIKE]
    for i in r.sample(at, min(len(at), r.randrange(1, 4))):
        t = t[:i] + LOOKALIKE[t[i]] + t[i + 1 :]
    return t


def insert_invisible(r, t):
    for _ in range(r.randrange(1, 4)):
        i = r.randrange(1, len(t))
        t = t[:i] + r.choice("​‍⁠­") + t[i:]
    return t


def brackets(r, word):
    a, b = r.choice(["[]", "()", "{}", "<>"])
    gap, inner = r.choice(["", " "]), r.choice(["", " "])
    return f"{gap}{a}{inner}{word}{inner}{b}{gap}"


def spell(r, t, share):
    """Digits as words, with the blanks that then part them."""
    out = []
    for c in t:
        if c.isdigit() and r.random() < share:
            out.append(f" {DIGITS[int(c)]} ")
        else:
            out.append(c)
    return " ".join("".join(out).split())


def email(r):
    name = lambda n: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(n))
    local = name(r.randrange(3, 8)) + r.choice(["", "." + name(4), "_" + name(3), str(r.randrange(10, 99))])
    domain = r.choice(["", name(4) + "."]) + name(r.randrange(4, 9)) + r.choice([".com", ".org", ".net", ".de", ".co.uk"])
    plain = f"{local}@{domain}"
    at, dot = r.choice(["at", "AT", "arroba"]), r.choice(["dot", "DOT", "punkt"])
    style = r.randrange(7)
    if style == 0:
        return plain, f"{local} {at} {domain.replace('.', f' {dot} ')}".replace("  ", " ")
    if style == 1:
        return plain, local + brackets(r, at) + domain.replace(".", brackets(r, dot))
    if style == 2:
        return plain, local + brackets(r, r.choice([at, "@"])) + domain
    if style == 3:
        return plain, swap_letters(r, plain)
    if style == 4:
        return plain, insert_invisible(r, plain)
    if style == 5:
        return plain, wide(plain)
    return plain, plain.replace("@", r.choice([" @ ", "@ ", " @"]))


def number(r, plain):
    style = r.randrange(4)
    if style == 0:
        return spell(r, plain.replace("+", " plus ") if plain[0] == "+" else plain, 1.0)
    if style == 1:
        return spell(r, plain, 0.4)
    if style == 2:
        return wide(plain).replace("　", " ")
    return insert_invisible(r, plain)


def phone(r):
    plain = f"+{r.randrange(1, 99)} {r.randrange(100, 999)} {r.randrange(1000000, 9999999)}"
    return plain, number(r, plain)


def card(r):
    while True:
        digits = "".join(r.choice("0123456789") for _ in range(16))
        if P.luhn(digits):
            plain = " ".join(digits[i : i + 4] for i in range(0, 16, 4))
            return plain, number(r, plain)


def ip(r):
    parts = [str(r.randrange(1, 256)) for _ in range(4)]
    plain = ".".join(parts)
    style = r.randrange(4)
    if style == 0:
        return plain, r.choice([" dot ", " punkt ", " DOT "]).join(parts)
    if style == 1:
        return plain, brackets(r, r.choice(["dot", "."])).join(parts)
    if style == 2:
        return plain, wide(plain)
    return plain, insert_invisible(r, plain)


@pytest.mark.parametrize(("kind", "make"), [("email", email), ("phone", phone), ("card", card), ("ip", ip)])
def test_recall_of_disguises(kind, make):
    r, n, found, missed = random.Random(11), 0, 0, []
    while n < 600:
        plain, shown = make(r)
        if shown == plain:
            continue
        before, after = (" ".join(r.choice(FILLER) for _ in range(r.randrange(1, 12))) for _ in range(2))
        text = f"{before}: {shown}, {after}."
        start = len(before) + 2
        n += 1
        base, added = P.find_spans(text)
        if (kind, start, start + len(shown)) in base + added:
            found += 1
        else:
            missed.append(shown)
    assert found / n >= 0.9, (found / n, missed[:12])


def test_clean_prose_gets_no_spans():
    r = random.Random(4)
    for _ in range(300):
        words = [r.choice([*FILLER, "at", "one", "two", "plus", "point", "null", "@"]) for _ in range(60)]
        text = " ".join(words).replace("@", "and")
        assert P.find_spans(text)[1] == [], text


def naive(text, steps):
    """(text, source span of each character) after each list of edits."""
    chars = [(c, (i, i + 1)) for i, c in enumerate(text)]
    for edits in steps:
        out, done = [], 0
        for a, b, new in edits:
            out += chars[done:a]
            span = (chars[a][1][0], chars[b - 1][1][1])
            out += [(c, span) for c in new]
            done = b
        chars = out + chars[done:]
    return chars


def test_mapping_equals_a_span_per_character():
    r = random.Random(7)
    for _ in range(400):
        text = "".join(r.choice("abc .@") for _ in range(r.randrange(1, 30)))
        new, steps, size = P.Rewritten(text), [], len(text)
        for _ in range(r.randrange(1, 4)):
            cuts = sorted(r.sample(range(size + 1), min(size + 1, 2 * r.randrange(0, 4))))
            edits = [(a, b, r.choice(["", "x", "yz"])) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
            steps.append(edits)
            new.rewrite(edits)
            size = len(new.text)
        want = naive(text, steps)
        assert new.text == "".join(c for c, _ in want)
        assert [new.back(i) for i in range(size)] == [s for _, s in want]

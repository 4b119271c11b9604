"""Personal data in texts, with offset-preserving deobfuscation.

Base detection finds e-mail addresses, IP addresses, card and phone numbers as they
stand.  For disguised ones a transducer rewrites the text (homoglyphs, invisible
characters, "[at]" and "dot" spellings, spelled digits) and keeps for every piece of
the rewritten text the span it came from; what the same detectors find there is
mapped back to source characters.  Every span is in code points, end exclusive.

Detection is linear in the text's length: e-mail addresses are searched outwards from
each "@", the other patterns never rescan a run.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts_of

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin at the start of a run of digits, and takes whole runs.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def detect(text: str) -> list[Span]:
    """Base spans, by kind as listed, then start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


# --- the transducer ----------------------------------------------------------

#: Letters of other scripts that look like ASCII ones.
HOMOGLYPHS = dict(
    zip(
        "аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅαοεικνρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijsdhqwABEKMHOPCTXIJSaoeiknptuxABEZHIKMNOPTYX",
        strict=True,
    )
)
HOMOGLYPHS |= {"․": ".", "。": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "–": "-", "—": "-", " ": " ", " ": " "}
#: Characters that show nothing.
INVISIBLE = frozenset("­​‌‍⁠﻿")

#: Digits spelled in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_AT = "at|arroba|ät|chez"
_DOT = "dot|punkt|punto|point"
#: Last labels that a wholly spoken address may have.
TOP_LABELS = frozenset("com org net edu gov mil int info biz io ai app dev me tv eu us uk ca au nz in ie de at ch fr be lu es mx ar cl co pe it pt br nl se no dk fi pl cz ru ua jp cn kr".split())
#: Last labels that are everyday words too, as in "at this point in time".
WORD_LABELS = frozenset("in me it us at de be es no pt".split())
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))

_BRACKET = re.compile(rf"[\[({{<][ \t]*(?:({_AT}|@)|({_DOT}|\.))[ \t]*[\])}}>]", re.I)
_SPOKEN_MAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+)([ \t]+(?:{_AT})[ \t]+|[ \t]*@[ \t]*)[A-Za-z0-9-]+(?:(?:[ \t]+(?:{_DOT})[ \t]+|\.)[A-Za-z0-9-]+)+", re.I)
_JOINED_MAIL = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9.]+([-_]at[-_])[A-Za-z0-9]+(?:[-_]dot[-_][A-Za-z0-9]+)+(?![A-Za-z0-9_-])", re.I)
_JOINED_DOT = re.compile(r"[-_]dot[-_]", re.I)
_SPOKEN_DOT = re.compile(rf"[ \t]+(?:{_DOT})[ \t]+", re.I)
_NUMBER_DOT = re.compile(rf"(?<=[0-9])[ \t]+(?:{_DOT})[ \t]+(?=[0-9])", re.I)
_SPELLED = re.compile(rf"(?<!\w)(?:plus[ \t-]+)?(?:{_WORD}|[0-9])(?:(?:[ \t-]+(?:{_WORD}|{_DOT}|[0-9]))*[ \t-]+(?:{_WORD}|[0-9]))?(?![\w@])", re.I)
_SPELLED_PART = re.compile(rf"(plus)|({_DOT})|({_WORD})|([0-9])|[ \t-]+", re.I)
_ODD = re.compile("[ ­²³¹Ͱ-ԯ٠-٩۰-۹०-९​-‍‐‑–—․ ⁠⁰-ₜ①-⓿。﹒﹫﻿！-～\U0001d400-\U0001d7ff]")
_SIGN = re.compile(rf"[\[({{<][ \t]*(?:{_AT}|{_DOT}|@|\.)[ \t]*[\])}}>]|[ \t](?:{_DOT})[ \t]|[ \t]@|@[ \t]|[ \t](?:{_AT})[ \t]+[A-Za-z0-9-]+\.[A-Za-z]|[-_]at[-_]|(?<!\w)(?:{_WORD})(?:[ \t-]+(?:{_WORD}|{_DOT})(?!\w)|[ \t()-]{{1,3}}[0-9])|(?:[0-9][ \t()-]{{1,3}}|\+[ \t()-]{{0,3}}|(?<!\w)plus[ \t-]+)(?:{_WORD})(?!\w)", re.I)
# Up to three characters between a run of spelled digits and further digits.
_DIGITS_BEFORE = re.compile(r"(?:[0-9][ \t()-]{1,3}|\+[ \t()-]{0,3})\Z")
_DIGITS_AFTER = re.compile(r"[ \t()-]{1,3}[0-9]")


class Rewritten:
    """A rewritten text and where its pieces came from."""

    def __init__(self, text: str):
        self.text = text
        # Piece i is text[at[i]:at[i + 1]]; it came from source[i] (start, end), and if
        # whole[i] its characters stand for the span together.
        self.at, self.source, self.whole = [0], [(0, len(text))], [False]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the sorted, disjoint spans of the text."""
        out, at, source, whole, size, done = [], [], [], [], 0, 0

        def put(piece: str, span: tuple[int, int], fixed: bool) -> None:
            nonlocal size
            if piece or fixed:
                at.append(size)
                source.append(span)
                whole.append(fixed)
                out.append(piece)
                size += len(piece)

        def copy(a: int, b: int) -> None:
            while a < b:
                i = bisect_right(self.at, a) - 1
                end = min(b, self.at[i + 1] if i + 1 < len(self.at) else len(self.text))
                if self.whole[i]:
                    put(self.text[a:end], self.source[i], True)
                else:
                    base = self.source[i][0] - self.at[i]
                    put(self.text[a:end], (a + base, end + base), False)
                a = end

        for a, b, new in edits:
            copy(done, a)
            if new:
                put(new, (self.back(a)[0], self.back(b - 1)[1]), True)
            done = b
        copy(done, len(self.text))
        self.text, self.at, self.source, self.whole = "".join(out), at or [0], source or [(0, 0)], whole or [False]

    def back(self, i: int) -> tuple[int, int]:
        """Source span of character ``i``."""
        p = bisect_right(self.at, i) - 1
        if self.whole[p]:
            return self.source[p]
        start = self.source[p][0] + i - self.at[p]
        return start, start + 1

    def changed(self, a: int, b: int) -> bool:
        """Whether the characters a to b differ from a plain stretch of the source."""
        first, last = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        return any(self.whole[first : last + 1]) or self.back(b - 1)[1] - self.back(a)[0] != b - a


def _plain_character(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", c)  # full width, circled and mathematical forms
    return plain if len(plain) == 1 and plain.isascii() else c


def _spell(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn runs of spelled digits into digits: three or more of them, or fewer
    among or next to plain digits or a plus sign."""
    edits = []
    for m in _SPELLED.finditer(text):
        parts = [p for p in _SPELLED_PART.finditer(text, *m.span()) if p.lastindex]
        spelled = sum(p.lastindex == 3 for p in parts)
        if not spelled:
            continue
        if spelled < 3 and not any(p.lastindex in (1, 4) for p in parts):
            if not (_DIGITS_BEFORE.search(text[max(0, m.start() - 4) : m.start()]) or _DIGITS_AFTER.match(text, m.end())):
                continue
        for k, p in enumerate(parts):
            new = ("", "+", ".", DIGIT_WORDS[p.group().lower()] if p.lastindex == 3 else "", p.group())[p.lastindex]
            # The white space up to the next part goes with this one.
            edits.append((p.start(), parts[k + 1].start() if k + 1 < len(parts) else p.end(), new))
    return edits


def _mail_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn spoken and spaced signs of an address into "@" and ".".

    "at", "dot" and a spaced "@" are everyday signs too.  They count if the address has a
    known last label, and a spoken "at" before a written domain only if the part before
    is no plain word.
    """
    edits = []
    for m in _SPOKEN_MAIL.finditer(text):
        sign, dots = m.group(2), [(*d.span(), ".") for d in _SPOKEN_DOT.finditer(text, m.end(2), m.end())]
        label = re.split(r"[ \t.]", m.group())[-1].lower()
        plain_word = m.group(1).isalpha()
        noun = any(text[a:b].strip().lower() != "dot" for a, b, _ in dots)  # "point" and the like
        known = label in TOP_LABELS and not (plain_word and noun and label in WORD_LABELS)
        if sign == "@" and dots or known and (dots or sign.strip() == "@" and sign != "@" or sign != "@" and not plain_word):
            edits += ([(*m.span(2), "@")] if sign != "@" else []) + dots
    for m in _JOINED_MAIL.finditer(text):
        if re.split(r"[-_]", m.group())[-1].lower() in TOP_LABELS:
            edits += [(*m.span(1), "@"), *((*d.span(), ".") for d in _JOINED_DOT.finditer(text, m.end(1), m.end()))]
    edits.sort()
    return [e for i, e in enumerate(edits) if i == 0 or e[0] >= edits[i - 1][1]]


def _bracket_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn bracketed signs, with the blanks around them, into "@" and ".".

    Blanks are walked from the bracket outwards, each once, so runs of them cost their length.
    """
    edits, done = [], 0
    for m in _BRACKET.finditer(text):
        start, end = m.span()
        while start > done and text[start - 1] in " \t":
            start -= 1
        while end < len(text) and text[end] in " \t":
            end += 1
        edits.append((start, end, "@" if m.group(1) else "."))
        done = end
    return edits


def deobfuscate(text: str) -> Rewritten | None:
    """The text rewritten step by step; None if it shows no sign of a disguise."""
    odd = _ODD.search(text) is not None
    if not odd and _SIGN.search(text) is None:
        return None
    out = Rewritten(text)
    if odd:
        edits = [(m.start(), m.end(), new) for m in _ODD.finditer(text) if (new := _plain_character(m.group())) != m.group()]
        if edits:
            out.rewrite(edits)
    for edits_of in (_bracket_edits, _mail_edits, _spell, lambda t: [(*m.span(), ".") for m in _NUMBER_DOT.finditer(t)]):
        edits = edits_of(out.text)
        if edits:
            out.rewrite(edits)
    return out


def find_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and the spans that deobfuscation adds.

    An added span is inside no base span of its kind and inside no added span of a kind
    listed before its own; it may extend base spans, which stay, or overlap others.
    """
    text = text or ""
    base = detect(text)
    new = deobfuscate(text)
    if new is None:
        return base, []
    # Spans of a kind, base or added, are disjoint and in order.
    taken: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    for kind, a, b in base:
        taken[kind].append((a, b))
    added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}

    def inside(spans: list[tuple[int, int]], start: int, end: int) -> bool:
        i = bisect_right(spans, start, key=lambda s: s[0])
        return i > 0 and end <= spans[i - 1][1]

    for kind, a, b in detect(new.text):  # by kind as listed
        if not new.changed(a, b):
            continue
        start, end = new.back(a)[0], new.back(b - 1)[1]
        if not inside(taken[kind], start, end) and not any(inside(added[k], start, end) for k in KINDS[: KINDS.index(kind)]):
            added[kind].append((start, end))
    return base, [(k, a, b) for k in KINDS for a, b in added[k]]


def spell_spans(spans: list[Span]) -> str:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first names them all."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


_SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in texts_of(batch):
            base, added = find_spans(text)
            kinds = [k for k, _, _ in base]
            rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(spell_spans(base).encode()).hexdigest(), spell_spans(base + added), len(added)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), f.type) for c, f in zip(columns, list(_SCHEMA)[1:], strict=True))], schema=_SCHEMA)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_email, n_ip, n_card,
    n_phone (base spans), base_sha256, spans (base and added ones), n_added.

    Edge cases: null and empty texts have no spans; repeated rows get equal results; an
    empty table gives an empty result; further columns are ignored.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_scan, schema)

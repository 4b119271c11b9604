"""Text expressions: hashing, normalising, matching and token estimates.

Everything here is a Column expression of built-in functions.  White space is that of
ECMAScript (U+FEFF in, U+0085 out), lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that ``\s`` and ``trim`` of ECMAScript treat as white space.
SPACE = r"[\t\n\x0B\f\r    -     　﻿]"
#: Characters of which two count as one token more.
SPECIALS = "{}()[];:,.<>!=+-*/%&|^~@#$\"'`\\"
_SPECIAL_CLASS = r"[{}()\[\];:,.<>!=+\-*/%&|^~@#$\"'`\\]"
_RUN = r"[\x00-\x08\x0E-\x1F\x21-\x7F]+"
_WIDE = r"[^\x00-\x7F   - 　    ᠎\u0085﻿]"
_ASTRAL = r"[\x{10000}-\x{10FFFF}]"
#: The token budget of any model, its share of a chunk and of an overlap.
TOKEN_LIMIT, TARGET_SHARE, OVERLAP_SHARE = 512, 0.85, 0.18
#: Chunks and segments need more characters than this.
MIN_CHUNK_CHARS = 20


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_hash(text: Column | str) -> Column:
    """md5 of the content in hex."""
    return F.md5(_col(text).cast("binary"))


def trim_all(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"^{SPACE}+|{SPACE}+$", "")


def normalize_text(text: Column | str) -> Column:
    """Trimmed, with each run of white space as one space."""
    return F.regexp_replace(trim_all(text), f"{SPACE}+", " ")


def query_words(query: Column | str) -> Column:
    """Lower-cased words longer than two characters, repeats kept."""
    return F.filter(F.split(F.lower(_col(query)), f"{SPACE}+"), lambda w: F.length(w) > 2)


def exact_match(text: Column | str, query: Column) -> Column:
    """Whether the lower-cased text holds the whole lower-cased query, literally."""
    return F.contains(F.lower(F.coalesce(_col(text), F.lit(""))), F.lower(query))


def matched_fraction(text: Column | str, words: Column) -> Column:
    """Share of the words that the lower-cased text holds; 0 without words."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    return F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: F.contains(low, w))), F.size(words)), F.lit(0.0))


def text_score(text: Column | str, query: str, exact_boost: float = 1.5, partial_boost: float = 0.3) -> Column:
    """Boost of an exact match, else a share of the partial boost; 0 for queries of one character."""
    if len(query) <= 1:
        return F.lit(0.0)
    q = F.lit(query)
    return F.when(exact_match(text, q), F.lit(float(exact_boost))).otherwise(F.lit(float(partial_boost)) * matched_fraction(text, query_words(q)))


def token_estimate(text: Column | str, special_tokens: bool = True) -> Column:
    """Estimated tokens: runs of ASCII by length, each wider character, half the specials.

    Characters outside the basic plane count twice, as the two UTF-16 units they are.
    """
    t = _col(text)
    runs = F.aggregate(
        F.regexp_extract_all(t, F.lit(_RUN), F.lit(0)),
        F.lit(0),
        lambda n, r: n + F.when(F.length(r) <= 4, 1).when(F.length(r) <= 10, 2).otherwise(F.shiftright(F.length(r) + 3, 2)),
    )
    # What is not ASCII is little in most texts, and counted by itself.
    beyond = F.regexp_replace(t, F.lit(r"[\x00-\x7F]+"), F.lit(""))
    wide = F.regexp_count(beyond, F.lit(_WIDE)) + F.regexp_count(beyond, F.lit(_ASTRAL))
    extra = F.floor(F.regexp_count(t, F.lit(_SPECIAL_CLASS)) / 2).cast("int")
    made = runs + wide + extra + F.lit(2 if special_tokens else 0)
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.lit(0)).otherwise(made).cast("int")


def chunking_params(limit: int = TOKEN_LIMIT) -> dict[str, int]:
    """Most tokens, target and overlap of a chunk."""
    target = int(limit * TARGET_SHARE)
    return {"max_tokens": limit, "target_tokens": target, "overlap_tokens": int(target * OVERLAP_SHARE)}


def model_token_limit(model: str | None = None) -> int:
    """Every known and unknown model has the same limit."""
    return TOKEN_LIMIT

"""Quality rules: a threshold table compiled into one projection.

Every statistic is an expression of the text; a table of (statistic, least, most)
becomes the verdict.  DataFrame functions only, no shuffle, no user functions.

Repeated three-word windows are found by sorting: each window's hash and place are
one array, equal neighbours after the sort are repeats, and the covered words are
summed from the gaps between repeated places.  All of it is O(n log n) in the
words of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with", "as", "was", "at", "by", "be", "this", "are", "from", "or", "an",
    "der", "die", "das", "und", "ist", "ein", "eine", "mit", "von", "auf", "den", "im", "zu", "für", "nicht", "sich",
    "le", "la", "les", "de", "des", "et", "un", "une", "en", "que", "dans", "pour", "est", "sur", "pas", "du", "au",
    "el", "los", "las", "y", "por", "con", "para", "se", "del", "una", "no", "su", "al", "lo",
)

#: Statistic, least and most value that a kept text may have (None: no bound).
#: Bounds are wide on purpose: a rule is there to reject what no prose looks like.
THRESHOLDS = (
    ("n_words", 50, None),
    ("repeat_ratio", None, 0.5),
    ("mean_word_length", 2.0, 20.0),
    ("symbol_ratio", None, 0.2),
    ("dup_line_ratio", None, 0.5),
    ("stop_word_ratio", 0.01, None),
)

_SPACES = r"\\x20\\x09-\\x0D"

#: Words inside three-word windows that occur twice or more; a.w are the words.
_REPEATS = """
    transform(array(sort_array(transform(slice(a.w, 3, size(a.w)), (z, i) -> struct(xxhash64(a.w[i], a.w[i + 1], z) as h, i as p)))),
      s -> transform(array(sort_array(filter(transform(s, (x, i) ->
               if((i > 0 and s[i - 1].h = x.h) or (i + 1 < size(s) and s[i + 1].h = x.h), x.p, -1)), p -> p >= 0))),
             r -> aggregate(zip_with(r, slice(r, 2, size(r)), (x, y) -> least(3, coalesce(y - x, 3))), 0L, (n, g) -> n + g))[0])[0]
"""

#: Ratios of the statistics b.
_RATIOS = {
    "n_words": "b.n_words",
    "repeat_ratio": "b.n_repeat_words / greatest(b.n_words, 1)",
    "mean_word_length": "b.word_chars / greatest(b.n_words, 1)",
    "symbol_ratio": "b.n_symbols / greatest(b.n_words, 1)",
    "dup_line_ratio": "b.n_dup_lines / greatest(b.n_lines, 1)",
    "stop_word_ratio": "b.n_stop_words / greatest(b.n_words, 1)",
}


def judgement(text: str = "text") -> Column:
    """One struct of all statistics of a text and the verdict.

    Words, lines and statistics are bound by lambdas over one-element arrays, so each
    is made once wherever the optimizer moves the expression, into a filter say.
    """
    listed = ", ".join(f"'{w}'" for w in STOP_WORDS)
    bounds = [f"{_RATIOS[name]} >= {least}D" for name, least, _ in THRESHOLDS if least is not None] + [f"{_RATIOS[name]} <= {most}D" for name, _, most in THRESHOLDS if most is not None]
    failed = "(b.n_words < 50 or 100 * b.n_repeat_words > 50 * b.n_words)"
    return F.expr(f"""
        transform(array(named_struct('t', coalesce({text}, ''))), x -> transform(array(named_struct(
            't', x.t,
            'w', filter(split(x.t, '[{_SPACES}]+'), w -> w <> ''),
            'l', filter(split(x.t, '\\n'), l -> l rlike '[^{_SPACES}]'))),
          a -> transform(array(named_struct(
            'n_words', cast(size(a.w) as long),
            'word_chars', cast(length(translate(a.t, ' \\t\\n\\u000b\\u000c\\r', '')) as long),
            'n_symbols', cast(regexp_count(a.t, '[#*$%&|<>]') as long),
            'n_dup_lines', cast(size(a.l) - size(array_distinct(a.l)) as long),
            'n_lines', cast(size(a.l) as long),
            'n_repeat_words', if(size(a.w) < 3, 0L, {_REPEATS}),
            'n_stop_words', cast(size(filter(a.w, w -> lower(w) in ({listed}))) as long))),
          b -> named_struct('n_words', b.n_words, 'word_chars', b.word_chars, 'n_symbols', b.n_symbols, 'n_dup_lines', b.n_dup_lines,
            'n_repeat_words', b.n_repeat_words, 'n_stop_words', b.n_stop_words, 'base_failed', {failed}, 'kept', not {failed} and {" and ".join(bounds)}))[0])[0])[0]
    """)


def rule_columns(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_stop_words, base_failed and kept.

    Edge cases: a null text counts as empty: no words, base_failed, not kept;
    repeated rows get equal verdicts; an empty table gives an empty result; columns
    of ``docs`` named like the new ones are replaced.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept"]
    docs = docs.drop(*new, "_judged")
    return docs.select("*", judgement().alias("_judged")).select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"_judged.{c}") for c in new])


def quality_report(docs: DataFrame) -> DataFrame:
    """Per document the statistics and the verdict, without the text."""
    return rule_columns(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that pass the rules; columns as they were.

    Edge cases: null, empty and short texts go; repeated rows stay or go together; an
    empty table gives an empty result; the rules add no column, so no name can clash.
    """
    return docs.where(judgement().getField("kept"))

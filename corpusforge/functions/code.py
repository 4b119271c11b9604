"""Expressions that find definitions, calls and symbols in source text.

Patterns are lists by language; all are applied with ``regexp_extract_all``, so a whole
file is one row and one pass a pattern, without user functions.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import extension

_NAME, _JS = "[a-zA-Z_][a-zA-Z0-9_]*", "[a-zA-Z_$][a-zA-Z0-9_$]*"

#: What a definition looks like in each language (group 1 is its name).
DEFINITIONS = {
    "javascript": [
        rf"(?:async\s+)?function\s+({_JS})\s*\(",
        rf"(?:const|let|var)\s+({_JS})\s*=\s*(?:async\s*)?\([^)]*\)\s*=>",
        rf"class\s+({_JS})",
        rf"(?m)^\s*(?:async\s+)?({_JS})\s*\([^)]*\)\s*\{{",
        rf"({_JS})\s*\([^)]*\)\s*\{{",
    ],
    "python": [rf"def\s+({_NAME})\s*\(", rf"class\s+({_NAME})\s*[:(]"],
    "go": [rf"func\s+(?:\([^)]*\)\s+)?({_NAME})\s*\("],
    "rust": [rf"fn\s+({_NAME})\s*[<(]", rf"impl(?:\s*<[^>]*>)?\s+({_NAME})"],
    "java": [rf"(?:public|private|protected)?\s*(?:static)?\s*(?:\w+)\s+({_NAME})\s*\(", rf"class\s+({_NAME})"],
}
#: Extensions of each language but the default, javascript.
LANGUAGE_EXTENSIONS = {"python": [".py", ".pyw"], "go": [".go"], "rust": [".rs"], "java": [".java", ".kt", ".scala"]}
#: A call, and what names a symbol in a snippet.
CALL = rf"\b({_JS})\s*\("
SYMBOLS = [
    rf"function\s+({_JS})",
    rf"class\s+({_JS})",
    rf"(?:const|let|var)\s+({_JS})\s*=",
    rf"def\s+({_NAME})",
    rf"class\s+({_NAME})",
    rf"func\s+({_NAME})",
    rf"fn\s+({_NAME})",
    rf"(?:public|private|protected|static)\s+\w+\s+({_NAME})\s*\(",
]
#: Lower-cased names that are no definition and no call.
BUILTINS = [
    "if", "for", "while", "switch", "catch", "function", "async", "await", "return", "throw", "new", "typeof", "instanceof", "delete", "void", "console", "require", "import", "export",
    "super", "this", "parseint", "parsefloat", "string", "number", "boolean", "array", "object", "map", "set", "promise", "error", "json", "math", "date", "regexp", "def", "class",
    "print", "len", "range", "str", "int", "float", "list", "dict", "tuple", "bool", "type", "isinstance", "hasattr", "getattr", "setattr", "func", "make", "append", "cap", "panic",
    "recover", "else", "try", "finally", "with", "all", "race", "resolve", "reject",
]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def without_backtracking(pattern: str) -> str:
    """A pattern of equal matches that doesn't try again what can't match: what follows a name, an
    argument list or a margin never begins with one of their characters, and where a name
    fails, its rest fails too."""
    tight = pattern.replace("[a-zA-Z0-9_$]*)", "[a-zA-Z0-9_$]*+)").replace("[^)]*\\)", "[^)]*+\\)").replace("^\\s*", "^\\s*+")
    return "(?<![a-zA-Z_$])" + tight if pattern.startswith(f"({_JS})") else tight


_KEYWORD, _END = re.compile(r"(?:\(\?:async\\s\+\)\?)?(function|class|def|func|fn|impl)\b"), re.compile(r"(=>|=|\\\(|\\\{)$")


def needed(pattern: str) -> list[str]:
    """What every match of a pattern holds: the keyword that it begins with, and its end."""
    return [*(m.group(1) for m in [_KEYWORD.match(pattern)] if m), *(m.group().lstrip("\\") for m in [_END.search(pattern)] if m)]


def _found(text: Column, pattern: str, held: Column | None = None) -> Column:
    """Matches of a pattern; only a text that has what they hold is searched.  ``held``: a text,
    cheaper to make, that has what ``text`` has."""
    found = F.regexp_extract_all(text, F.lit(without_backtracking(pattern)), F.lit(1))
    has = [F.contains(text if held is None else held, F.lit(x)) for x in needed(pattern)]
    return F.when(reduce(Column.__and__, has), found).otherwise(F.array().cast("array<string>")) if has else found


def _all(text: Column, patterns: list[str]) -> Column:
    found = [_found(text, p) for p in patterns]
    return F.concat(*found) if len(found) > 1 else found[0]


def _meaningful(names: Column) -> Column:
    return F.array_distinct(F.filter(names, lambda n: (F.length(n) > 1) & ~F.lower(n).isin(BUILTINS)))


def language(path: Column | str) -> Column:
    ext = extension(path)
    out = F.lit("javascript")
    for name, listed in LANGUAGE_EXTENSIONS.items():
        out = F.when(ext.isin(listed), name).otherwise(out)
    return out


def definitions(content: Column | str, path: Column | str) -> Column:
    """Distinct names defined in the file, in order of pattern, then place."""
    text, lang = F.coalesce(_col(content), F.lit("")), language(path)
    cases = [(lang == name, _all(text, patterns)) for name, patterns in DEFINITIONS.items()]
    chosen = reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(cases[1:]), cases[0][1])
    return _meaningful(chosen)


def strip_strings_and_comments(content: Column | str, path: Column | str | None = None) -> Column:
    """Text without comments and with empty strings; Python rules for .py and .pyw."""
    text = F.regexp_replace(_col(content), r"(?m)//[^\n\r\x{2028}\x{2029}]*", "")
    text = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    if path is not None:
        python = F.regexp_replace(text, r"(?m)#[^\n\r\x{2028}\x{2029}]*", "")
        for quotes in ('"""', "'''"):
            python = F.regexp_replace(python, f"(?s){quotes}.*?{quotes}", "")
        text = F.when(extension(path).isin(".py", ".pyw"), python).otherwise(text)
    for q in ('"', "'", "`"):
        text = F.regexp_replace(text, rf"{q}(?:[^{q}\\]++|\\[^\n\r])*+{q}", q + q)
    return text


def calls(content: Column | str, path: Column | str | None = None) -> Column:
    """Distinct names called in the file, strings and comments left out."""
    text = F.coalesce(_col(content), F.lit(""))
    return _meaningful(_found(strip_strings_and_comments(text, path), CALL, text))


def call_data(content: Column | str, path: Column | str) -> Column:
    """Struct of definitions and of calls to names that the file does not define."""
    defined = definitions(content, path)
    return F.struct(defined.alias("definitions"), F.array_except(calls(content, path), defined).alias("calls"))


def symbols(content: Column | str) -> Column:
    """Distinct symbols of a snippet, longer than two characters."""
    found = _all(F.coalesce(_col(content), F.lit("")), SYMBOLS)
    return F.array_distinct(F.filter(found, lambda n: F.length(n) > 2))

"""Splitting source text into chunks: one file to many rows.

The scanner carries state from line to line (open strings, comments, brackets), so it runs
in Python, one file at a time and many files at once; input and output are Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MIN_CHUNK_CHARS, OVERLAP_SHARE, SPECIALS, TARGET_SHARE, TOKEN_LIMIT

#: Tokens that every model input has besides its text.
EXTRA = 2
MAX_CHUNKS = 1000
#: Overlap: lines looked at, and blank lines taken, at most.
LOOK_BACK, BLANK_LINES = 50, 10

_JS = r"^(export\s+)?(async\s+)?(function|class|const|let|var)\s+\w+"
_TS = r"^(export\s+)?(async\s+)?(function|class|const|let|var|interface|type)\s+\w+"
_CPP = r"^(class|struct|namespace|template|void|int|bool)\s+\w+"
_SHELL = r"^(\w+\s*\(\)|function\s+\w+)"
_TAG = r"(?i)^(<(div|section|article|header|footer|nav|main|aside|form|table|template|script|style)\b)"
#: How a top-level construct begins, by extension.
CONSTRUCTS = {
    "js": _JS,
    "jsx": _JS,
    "mjs": _JS,
    "cjs": _JS,
    "ts": _TS,
    "tsx": _TS,
    "py": r"^(class|def|async\s+def)\s+\w+",
    "pyw": r"^(class|def|async\s+def)\s+\w+",
    "pyx": r"^(cdef|cpdef|def|class)\s+\w+",
    "java": r"^(public|private|protected)?\s*(static\s+)?(class|interface|enum|void|int|String|boolean)\s+\w+",
    "kt": r"^(class|interface|object|fun|val|var)\s+\w+",
    "kts": r"^(class|interface|object|fun|val|var)\s+\w+",
    "scala": r"^(class|object|trait|def|val|var)\s+\w+",
    "c": r"^(struct|enum|union|void|int|char|float|double)\s+\w+",
    "cpp": _CPP,
    "cc": _CPP,
    "cxx": _CPP,
    "h": _CPP,
    "hpp": _CPP,
    "hxx": _CPP,
    "cs": r"^(public|private|protected)?\s*(static\s+)?(class|interface|struct|enum|void|int|string|bool)\s+\w+",
    "csx": r"^(public|private|protected)?\s*(static\s+)?(class|interface|struct|enum|void|int|string|bool)\s+\w+",
    "go": r"^(func|type|const|var)\s+\w+",
    "rs": r"^(pub\s+)?(fn|struct|enum|trait|impl|const|static|mod)\s+\w+",
    "php": r"^(class|interface|trait|function|const)\s+\w+",
    "phtml": r"^(<\?php|class|interface|trait|function)\s*",
    "rb": r"^(class|module|def)\s+\w+",
    "rake": r"^(class|module|def|task|namespace)\s+\w+",
    "swift": r"^(class|struct|enum|protocol|func|var|let|extension)\s+\w+",
    "r": r"^(\w+)\s*(<-|=)\s*function",
    "lua": r"^(function|local\s+function)\s+\w+",
    "sh": _SHELL,
    "bash": _SHELL,
    "zsh": _SHELL,
    "fish": r"^function\s+\w+",
    "css": r"^(\.|#|@media|@keyframes|@font-face|\w+)\s*[{,]",
    "scss": r"^(\$\w+:|@mixin|@function|@include|\.|#|@media)\s*",
    "sass": r"^(\$\w+:|=\w+|\+\w+|\.|#|@media)\s*",
    "less": r"^(@\w+:|\.|#|@media)\s*",
    "styl": r"^(\$\w+\s*=|\w+\(|\.|#)\s*",
    "html": _TAG,
    "htm": _TAG,
    "xml": r"^(<\w+|\s*<!\[CDATA\[)",
    "svg": r"^(<svg|<g|<path|<defs|<symbol)\b",
    "json": r'^(\s*"[\w-]+"\s*:\s*[\[{])',
    "yaml": r"^(\w[\w-]*:\s*[|>]?$|\w[\w-]*:\s*$)",
    "yml": r"^(\w[\w-]*:\s*[|>]?$|\w[\w-]*:\s*$)",
    "toml": r"^(\[\[?\w+\]?\]?|\w+\s*=)",
    "ini": r"^(\[\w+\]|\w+\s*=)",
    "env": r"^[A-Z_][A-Z0-9_]*=",
    "makefile": r"^([A-Za-z0-9_./-]+)\s*:(?!=)",
    "mk": r"^([A-Za-z0-9_./-]+)\s*:(?!=)",
    "dockerfile": r"(?i)^(FROM|RUN|CMD|LABEL|EXPOSE|ENV|ADD|COPY|ENTRYPOINT|VOLUME|USER|WORKDIR|ARG|ONBUILD|STOPSIGNAL|HEALTHCHECK|SHELL)\s+",
    "md": r"^(#{1,6}\s+|```|\*{3}|_{3})",
    "mdx": r"^(#{1,6}\s+|```|import\s+|export\s+)",
    "txt": r"^.{50,}",
    "rst": r"^(={3,}|-{3,}|~{3,}|\.\.\s+\w+::)",
    "sql": r"(?i)^(CREATE|ALTER|INSERT|UPDATE|DELETE|SELECT|DROP|GRANT|REVOKE|WITH|DECLARE|BEGIN|END)\s+",
    "pl": r"^(sub|package|use|require)\s+\w+",
    "pm": r"^(sub|package|use|require)\s+\w+",
    "vim": r"^(function|command|autocmd|let\s+g:)\s*",
}
_BY_EXTENSION = {e: re.compile(p.replace("$)", r"\Z)"), re.A) for e, p in CONSTRUCTS.items()}

_SPACE_CHARS = "\t\n\x0b\x0c\r   " + "".join(map(chr, range(0x2000, 0x200B))) + "     ﻿"
_BEYOND = re.compile(r"[^\x00-\x7f]+")
_WIDE = re.compile("[^\x00-\x7f   -      ᠎\x85﻿]")
_SPECIAL = SPECIALS.encode("ascii")
_TURN = re.compile(r"\\|/\*|//|['\"`{}\[\]()]")
_BANNER = re.compile(rf"[{_SPACE_CHARS}]*(/\*\*|//[{_SPACE_CHARS}]*[-=]{{3,}}|#[{_SPACE_CHARS}]*[-=]{{3,}})")
_OPEN, _CLOSE = {"{": 0, "[": 1, "(": 2}, {"}": 0, "]": 1, ")": 2}


#: Tokens of a run by its length; ``_run_tokens`` knows longer ones.
_RUN_TOKENS = [1 if n <= 4 else 2 if n <= 10 else -(-n // 4) for n in range(64)]


def _run_tokens(runs: list[bytes]) -> int:
    try:
        return sum(map(_RUN_TOKENS.__getitem__, map(len, runs)))
    except IndexError:
        return sum(_RUN_TOKENS[n] if n < len(_RUN_TOKENS) else -(-n // 4) for n in map(len, runs))


def count_tokens(text: str) -> int:
    """Estimated tokens without the extra ones; same estimate as the Column expression."""
    if not text:
        return 0
    plain = text.isascii()
    raw = (text if plain else _BEYOND.sub(" ", text)).encode()
    out = _run_tokens(raw.split()) + (len(raw) - len(raw.translate(None, _SPECIAL))) // 2
    if plain:
        return out
    wide = _WIDE.findall(text)
    return out + len(wide) + sum(map("\uffff".__lt__, wide))


@dataclass
class _Lexer:
    """What is open at the end of the lines seen so far."""

    quote: str = ""
    comment: bool = False
    depth: list[int] = field(default_factory=lambda: [0, 0, 0])  # braces, brackets, parentheses

    def feed(self, line: str) -> str:
        """Scan a line; returns its part outside of a comment that was open before."""
        at = 0
        if self.comment:
            end = line.find("*/")
            if end < 0:
                return ""
            self.comment, at = False, end + 2
        rest, skip = line[at:], at
        while m := _TURN.search(line, skip):
            what, skip = m.group(), m.end()
            if self.quote:
                if what == "\\":
                    skip = m.end() + 1
                elif what == self.quote:
                    self.quote = ""
                elif len(what) == 2:
                    skip = m.start() + 1
            elif what == "/*":
                end = line.find("*/", m.start() + 1)
                if end < 0:
                    self.comment = True
                    break
                skip = end + 2
            elif what == "//":
                break
            elif what in "'\"`":
                self.quote = what
            elif what in _OPEN:
                self.depth[_OPEN[what]] += 1
            elif what in _CLOSE:
                self.depth[_CLOSE[what]] = max(0, self.depth[_CLOSE[what]] - 1)
        return rest

    @property
    def top(self) -> bool:
        """Outside of everything."""
        return not (any(self.depth) or self.quote or self.comment)

    @property
    def loose(self) -> bool:
        """Where a chunk may end at all: in no string, and in one block at most."""
        return self.depth[0] <= 1 and not self.quote


#: A chunk of so few lines, or below this share of its target, isn't ended for a new part's sake.
LEAST_LINES, RIPE = 3, 0.6


def _begins_part(line: str, before: str, construct: re.Pattern, lexer: _Lexer) -> bool:
    """Whether a line begins something new: a construct, a text at the margin outside of
    everything, or a banner after a blank line."""
    if construct.search(line.strip(_SPACE_CHARS)):
        return True
    if lexer.top and line[:1].strip(_SPACE_CHARS):
        return True
    return not before.strip(_SPACE_CHARS) and _BANNER.match(line) is not None


def construct_pattern(path: str) -> re.Pattern:
    name = path.rsplit("/", 1)[-1].lower()
    stem, dot, ext = name.rpartition(".")
    known = _BY_EXTENSION.get(ext) if dot and stem else None
    if known is None:
        known = _BY_EXTENSION.get(name if name in ("dockerfile", "makefile") else "env" if name.startswith(".env") else "js")
    return known


def smart_chunk(content: str, path: str, max_tokens: int | None = None, target_tokens: int | None = None, overlap_tokens: int | None = None, max_chunks: int = MAX_CHUNKS, count=count_tokens) -> list[dict]:
    """Chunks of a file: text, start_line, end_line (from 1) and token_count.

    A chunk ends where the next line would exceed the target, or at a line that begins a
    construct once it holds three fifths of the target.  It starts with the last lines of
    the one before, up to the overlap.  A line too long for a model is cut by itself.
    Chunks of 20 characters or fewer (trimmed) are dropped; after ``max_chunks`` only the
    open one follows.  token_count includes the extra tokens except where a split ended
    the chunk.
    """
    limit = max_tokens or TOKEN_LIMIT
    target = target_tokens or int(TOKEN_LIMIT * TARGET_SHARE)
    overlap = overlap_tokens or int(int(TOKEN_LIMIT * TARGET_SHARE) * OVERLAP_SHARE)
    begins, lexer, out = construct_pattern(path), _Lexer(), []
    lines = content.split("\n")
    held: list[tuple[str, int]] = []  # open lines and their tokens
    first, tokens = 0, 0

    def emit(text: str, start: int, end: int, n: int) -> None:
        if len(text.strip(_SPACE_CHARS)) > MIN_CHUNK_CHARS:
            out.append({"text": text, "start_line": start, "end_line": end, "token_count": n})

    def joined() -> str:
        return "\n".join(x for x, _ in held)

    for i, line in enumerate(lines):
        n = count(line)
        rest = lexer.feed(line)
        if n + EXTRA > limit:
            emit(joined(), first + 1, first + len(held), tokens + EXTRA)
            step = max(100, int(len(line) / max(1, n) * target))
            for at in range(0, len(line), step):
                emit(line[at : at + step], i + 1, i + 1, count(line[at : at + step]) + EXTRA)
            held, tokens, first = [], 0, i + 1
            continue
        full = tokens + n + EXTRA > target
        ripe = len(held) > LEAST_LINES and tokens + EXTRA > RIPE * target and lexer.loose
        natural = ripe and _begins_part(rest, held[-1][0], begins, lexer)
        if held and (full or natural):
            emit(joined(), first + 1, first + len(held), tokens)
            kept: list[tuple[str, int]] = []
            tokens = 0
            for text, size in held[: -LOOK_BACK - 1 : -1]:
                if tokens >= overlap or (size > 0 and tokens + size > overlap):
                    break
                if size > 0 or (len(kept) < BLANK_LINES):
                    kept.append((text, size))
                    tokens += size
            held = kept[::-1]
            first = max(0, i - len(held))
        held.append((line, n))
        tokens += n
        if len(out) >= max_chunks:
            break
    emit(joined(), first + 1, len(lines), tokens + EXTRA)
    return out


#: Characters of chunks that a task holds before it hands them on, about.
PIECE_CHARS = 1 << 20
_PIECE = pa.schema([("file", pa.string()), ("chunk_no", pa.int32()), ("text", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("token_count", pa.int32())])


def _piece(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)


def chunk_files(files: DataFrame, content: str = "content", path: str = "file", **options) -> DataFrame:
    """``files(file, content)`` to (file, chunk_no, text, start_line, end_line, token_count).

    A null content has no chunks.  Chunks are handed on in pieces, so a task's memory does not
    grow with the texts of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chars = [], 0
            for name, body in zip(*batch.columns, strict=True):  # Arrow scalars: one text at a time becomes a string
                name, body = name.as_py(), body.as_py()
                for no, c in enumerate(smart_chunk(body, name or "", **options) if body else []):
                    rows.append((name, no, c["text"], c["start_line"], c["end_line"], c["token_count"]))
                    chars += len(c["text"])
                    if chars >= PIECE_CHARS:
                        yield _piece(rows)
                        rows, chars = [], 0
            if rows:
                yield _piece(rows)

    return files.selectExpr(f"`{path}` as file", f"`{content}` as content").mapInArrow(run, "file string, chunk_no int, text string, start_line int, end_line int, token_count int")


@F.udtf(returnType="chunk_no int, text string, start_line int, end_line int, token_count int")
class SmartChunk:
    """``smart_chunk(content, path [, max_tokens => ..., target_tokens => ..., overlap_tokens => ...,
    max_chunks => ...])`` in SQL; a null content has no chunks."""

    def eval(self, content: str, path: str, max_tokens: int = None, target_tokens: int = None, overlap_tokens: int = None, max_chunks: int = MAX_CHUNKS):  # noqa: RUF013
        for no, c in enumerate(smart_chunk(content, path or "", max_tokens, target_tokens, overlap_tokens, max_chunks) if content else []):
            yield no, c["text"], c["start_line"], c["end_line"], c["token_count"]


def register_smart_chunk(spark: SparkSession, name: str = "smart_chunk") -> None:
    """Make the table function known to SQL, for use with LATERAL."""
    spark.udtf.register(name, SmartChunk)

"""Path expressions: globs, ignore rules, MIME types, containment."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories that are never crawled.
PRUNED_DIRECTORIES = ("node_modules", ".git")
#: Substrings of installation and system directories.
NON_PROJECT = ("/program files/", "/program files (x86)/", "/appdata/local/programs/", "/appdata/roaming/", "/applications/", "/contents/resources/")
#: Substrings of temporary workspaces.
TEMPORARY = ("temp-workspace", ".tmp", "\\temp\\", "/tmp/", "\\\\temp\\\\")

#: MIME type of each extension.
MIME_TYPES = {
    ".js": "text/javascript",
    ".mjs": "text/javascript",
    ".cjs": "text/javascript",
    ".ts": "text/typescript",
    ".tsx": "text/typescript",
    ".jsx": "text/javascript",
    ".mts": "text/typescript",
    ".cts": "text/typescript",
    ".json": "application/json",
    ".json5": "application/json",
    ".jsonc": "application/json",
    ".yaml": "text/yaml",
    ".yml": "text/yaml",
    ".toml": "text/x-toml",
    ".xml": "application/xml",
    ".csv": "text/csv",
    ".html": "text/html",
    ".htm": "text/html",
    ".xhtml": "application/xhtml+xml",
    ".css": "text/css",
    ".scss": "text/x-scss",
    ".sass": "text/x-sass",
    ".less": "text/x-less",
    ".styl": "text/x-stylus",
    ".vue": "text/x-vue",
    ".svelte": "text/x-svelte",
    ".astro": "text/x-astro",
    ".md": "text/markdown",
    ".markdown": "text/markdown",
    ".mdx": "text/markdown",
    ".txt": "text/plain",
    ".rst": "text/x-rst",
    ".adoc": "text/asciidoc",
    ".tex": "text/x-tex",
    ".py": "text/x-python",
    ".pyw": "text/x-python",
    ".pyx": "text/x-cython",
    ".rb": "text/x-ruby",
    ".erb": "text/x-ruby",
    ".rake": "text/x-ruby",
    ".gemspec": "text/x-ruby",
    ".go": "text/x-go",
    ".rs": "text/x-rust",
    ".java": "text/x-java",
    ".kt": "text/x-kotlin",
    ".kts": "text/x-kotlin",
    ".groovy": "text/x-groovy",
    ".scala": "text/x-scala",
    ".clj": "text/x-clojure",
    ".cljs": "text/x-clojure",
    ".c": "text/x-c",
    ".h": "text/x-c",
    ".cpp": "text/x-c++",
    ".cc": "text/x-c++",
    ".cxx": "text/x-c++",
    ".hpp": "text/x-c++",
    ".hxx": "text/x-c++",
    ".m": "text/x-objectivec",
    ".mm": "text/x-objectivec",
    ".cs": "text/x-csharp",
    ".vb": "text/x-vb",
    ".fs": "text/x-fsharp",
    ".sh": "text/x-shellscript",
    ".bash": "text/x-shellscript",
    ".zsh": "text/x-shellscript",
    ".fish": "text/x-shellscript",
    ".bat": "text/x-batch",
    ".cmd": "text/x-batch",
    ".ps1": "text/x-powershell",
    ".psm1": "text/x-powershell",
    ".sql": "text/x-sql",
    ".pgsql": "text/x-sql",
    ".mysql": "text/x-sql",
    ".ini": "text/x-ini",
    ".cfg": "text/plain",
    ".conf": "text/plain",
    ".properties": "text/x-properties",
    ".env": "text/plain",
    ".swift": "text/x-swift",
    ".dart": "text/x-dart",
    ".hs": "text/x-haskell",
    ".ml": "text/x-ocaml",
    ".ex": "text/x-elixir",
    ".exs": "text/x-elixir",
    ".erl": "text/x-erlang",
    ".lua": "text/x-lua",
    ".pl": "text/x-perl",
    ".pm": "text/x-perl",
    ".r": "text/x-r",
    ".jl": "text/x-julia",
    ".tf": "text/x-terraform",
    ".hcl": "text/x-hcl",
    ".nix": "text/x-nix",
    ".cmake": "text/x-cmake",
    ".gradle": "text/x-groovy",
    ".dockerfile": "text/x-dockerfile",
    ".proto": "text/x-protobuf",
    ".graphql": "text/x-graphql",
    ".gql": "text/x-graphql",
    ".sol": "text/x-solidity",
    ".svg": "image/svg+xml",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_path(path: Column | str, windows: bool = False) -> Column:
    """Forward slashes; lower case only where the file system ignores case."""
    p = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    return F.lower(p) if windows else p


def basename(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"(?<![^/])([^/]*+)/*+$", 1)  # tried once a name


def dirname(path: Column | str) -> Column:
    p = _col(path)
    d = F.regexp_extract(p, r"^(.*?)/+[^/]*/*$", 1)
    return F.when(d != "", d).when(p.startswith("/"), "/").otherwise(".")


def extension(path: Column | str) -> Column:
    """Lower-cased extension with its dot; '' for names without one or with a leading dot only."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^(?!\.\.$).+(\.[^.]*)$", 1))


def mime_type(path: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("text/plain"))


def workspace_key(path: Column | str) -> Column:
    return F.substring(F.md5(_col(path).cast("binary")), 1, 12)


def path_to_uri(path: Column | str) -> Column:
    """file:// URI with percent-encoded segments."""
    encoded = F.url_encode(_col(path))
    return F.concat(F.lit("file://"), F.replace(F.replace(encoded, F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")))


def uri_to_path(uri: Column | str) -> Column:
    u = F.regexp_replace(_col(uri), "^file://", "")
    return F.url_decode(F.replace(u, F.lit("+"), F.lit("%2B")))


def is_inside(path: Column | str, root: str) -> Column:
    """Lexical containment: relative parts resolved beforehand, ``..`` refused."""
    p = normalize_path(path)
    top = root.replace("\\", "/").rstrip("/")
    return ((p == top) | p.startswith(top + "/")) & ~p.rlike(r"(^|/)\.\.(/|$)")


def is_non_project(path: Column | str) -> Column:
    p = F.lower(normalize_path(path))
    return reduce(lambda a, b: a | b, [F.contains(p, F.lit(m)) for m in NON_PROJECT])


def is_temporary(path: Column | str, tmpdir: str = "/tmp") -> Column:
    p = F.lower(_col(path))
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(p, F.lit(m)) for m in TEMPORARY]) | p.startswith(tmpdir.lower()), F.lit(False))


# --- globs and ignore rules ----------------------------------------------------

_GLOB = re.compile(r"\*\*/|\*\*|\*|\?|.", re.S)
_GLOB_MEANING = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_to_regex(pattern: str) -> str:
    """Anchored regular expression of a glob; the same text means the same in Java, RE2 and Python."""
    return "^" + "".join(_GLOB_MEANING.get(t) or (f"\\{t}" if t in "\\.[]{}()+-^$|" else t) for t in _GLOB.findall(pattern)) + "$"


def exclude_predicate(path: Column | str, patterns: list[str], root: str = "") -> Column:
    """Whether any pattern excludes the path.

    Patterns without a slash are matched with the basename, others with the path below
    ``root``; a path outside of ``root`` is not excluded.
    """
    p = normalize_path(path)
    top = root.rstrip("/")
    relative = F.when(p.startswith(top + "/"), F.substr(p, F.lit(len(top) + 2))) if top else p
    named = [x for x in patterns if "/" not in x]
    deep = [x for x in patterns if "/" in x]
    tests = [target.rlike("|".join(f"(?:{glob_to_regex(x)})" for x in group)) for target, group in ((basename(p), named), (relative, deep)) if group]
    found = reduce(lambda a, b: a | b, tests, F.lit(False))
    return F.coalesce(relative.isNotNull() & found, F.lit(False)) if top else F.coalesce(found, F.lit(False))


def gitignore_predicate(path: Column | str, lines: list[str]) -> Column:
    """Whether a root ignore file excludes the relative path; the last rule that matches wins.

    Comments, blank lines, negation, anchoring by a slash and directory-only rules are
    supported.
    """
    p = normalize_path(path)
    out = F.lit(False)
    for line in lines:
        rule = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\r\n"))
        if not rule or rule.startswith("#"):
            continue
        negated, rule = rule.startswith("!"), rule.removeprefix("!")
        directory, rule = rule.endswith("/"), rule.rstrip("/")
        anchored, rule = "/" in rule, rule.lstrip("/")
        body = glob_to_regex(rule)[1:-1]
        regex = "^" + ("" if anchored else "(?:.*/)?") + body + ("/.*$" if directory else "(?:/.*)?$")
        out = F.when(p.rlike(regex), F.lit(not negated)).otherwise(out)
    return out


def allowed_file(path: Column | str, extensions: list[str], names: list[str] = ()) -> Column:
    """Whether the extension or the whole name is listed."""
    ext = [e if e.startswith(".") else f".{e}" for e in extensions]
    return extension(path).isin([e.lower() for e in ext]) | basename(path).isin(list(names))


def in_pruned_directory(path: Column | str, pruned: tuple[str, ...] = PRUNED_DIRECTORIES) -> Column:
    return F.arrays_overlap(F.split(dirname(path), "/"), F.array(*[F.lit(x) for x in pruned]))

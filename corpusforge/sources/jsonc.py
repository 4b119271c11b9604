"""JSON with comments and trailing commas, for configuration files."""

from __future__ import annotations

import json
import re

# A string, a comment, or a comma before a closing bracket (comments between them allowed).
_PIECES = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/|,(?=(?:\s|//[^\n]*|/\*.*?\*/)*[}\]])', re.S)


def strip_jsonc(text: str) -> str:
    """The text as plain JSON."""
    return _PIECES.sub(lambda m: m.group() if m.group()[0] == '"' else " ", text.lstrip("﻿"))


def parse_jsonc(text: str):
    return json.loads(strip_jsonc(text))


def merge_config(defaults: dict, *layers: dict) -> dict:
    """Later layers win; None leaves a value as it is."""
    out = dict(defaults)
    for layer in layers:
        out |= {k: v for k, v in layer.items() if v is not None}
    return out

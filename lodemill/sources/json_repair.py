"""Mending JSON that a model wrote: fences, comments, trailing commas, bare keys, single quotes, and what is not closed."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A string in double quotes, a string in single quotes, or a comment.
PIECE = re.compile(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|//[^\n]*|/\*.*?\*/', re.S)
PYTHON_WORDS = {"True": "true", "False": "false", "None": "null"}


def is_complete(text: str) -> bool:
    """Whether braces and brackets outside strings are closed."""
    depth, inside, escaped = [], False, False
    for c in text:
        if inside:
            inside, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            inside = True
        elif c in "{[":
            depth.append("}" if c == "{" else "]")
        elif c in "}]" and (not depth or depth.pop() != c):
            return False
    return not depth and not inside and bool(text.strip())


def _outside(part: str) -> str:
    part = re.sub(r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", r'\1"\2"\3', part)
    return re.sub(r"\b(True|False|None)\b", lambda m: PYTHON_WORDS[m[1]], part)


def _string(piece: str) -> str:
    if piece.startswith(("//", "/*")):
        return ""
    body = piece[1:-1]
    if piece[0] == "'":
        body = body.replace("\\'", "'").replace('"', '\\"')
    return '"' + re.sub(r"[\x00-\x1f]", lambda m: json.dumps(m[0])[1:-1], body) + '"'


def repair(text: str | None) -> str | None:
    """JSON that can be read, or null."""
    if not text:
        return None
    text = re.sub(r"```\w*", "", text.lstrip("\ufeff"))
    begin, end = text.find("{"), text.rfind("}")
    if begin < 0 or end < begin:
        return None
    text = text[begin : end + 1]
    out, at, held = [], 0, []
    for m in PIECE.finditer(text):
        held.append(text[at : m.start()])
        held.append(_string(m[0]))
        at = m.end()
    held.append(text[at:])
    joined = "".join(x if k % 2 else x.replace("\r", " ") for k, x in enumerate(held))
    parts = re.split(r'("(?:\\.|[^"\\])*")', joined)
    out = "".join(p if k % 2 else _outside(p) for k, p in enumerate(parts))
    # a bare key or a comma may stand beside a string: look at the whole, strings masked
    out = _trailing(out)
    try:
        json.loads(out)
    except ValueError:
        return None
    return out


def _trailing(text: str) -> str:
    """Without commas before a closing brace or bracket, outside strings."""
    parts = re.split(r'("(?:\\.|[^"\\])*")', text)
    return "".join(p if k % 2 else re.sub(r",(\s*[}\]])", r"\1", p) for k, p in enumerate(parts))


@F.pandas_udf(T.StringType())
def repaired(text: pd.Series) -> pd.Series:
    return text.map(repair)

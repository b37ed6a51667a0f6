"""HTML: the text of the body, the title and what the head says."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIPPED = ("script", "style", "noscript", "template", "title")
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


class _Page(HTMLParser):
    """Collects the body's text, headings and the head's entries in one pass."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.title: list[str] = []
        self.headings: list[list[str]] = []
        self.meta: dict[str, str] = {}
        self.lang = self.charset = ""
        self.open: list[str] = []
        self.in_heading = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang", self.lang)
        if tag == "meta":
            self.charset = a.get("charset", self.charset)
            if a.get("name"):
                self.meta.setdefault(a["name"].lower(), a.get("content", ""))
        if tag in SKIPPED:
            self.open.append(tag)
        if tag in BLOCKS:
            self.text.append(" ")
        if tag in ("h1", "h2", "h3"):
            self.headings.append([])
            self.in_heading += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        if tag in BLOCKS:
            self.text.append(" ")
        if tag in ("h1", "h2", "h3"):
            self.in_heading = max(0, self.in_heading - 1)

    def handle_data(self, data: str) -> None:
        if self.open:
            if self.open[-1] == "title" and len(self.open) == 1:
                self.title.append(data)
            return
        self.text.append(data)
        if self.in_heading:
            self.headings[-1].append(data)


def _flat(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", "".join(parts)).strip()


def parse(html: str | None) -> dict:
    """Body, title, language, charset, headings and the named meta entries of a page."""
    page = _Page()
    page.feed(html or "")
    page.close()
    return {
        "body": _flat(page.text), "title": _flat(page.title), "lang": page.lang, "charset": page.charset, "headings": [_flat(h) for h in page.headings],
        "description": page.meta.get("description", ""), "keywords": page.meta.get("keywords", ""), "author": page.meta.get("author", ""),
    }


PARSED = "struct<body:string,title:string,lang:string,charset:string,headings:array<string>,description:string,keywords:string,author:string>"


def parsed(html: Column) -> Column:
    """All of a page as a struct, by Arrow batches."""
    schema = T.StructType([T.StructField(c, T.ArrayType(T.StringType()) if c == "headings" else T.StringType()) for c in ("body", "title", "lang", "charset", "headings", "description", "keywords", "author")])

    @F.pandas_udf(schema)
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(x) for x in pages], columns=schema.names)

    return run(html)


def title(html: Column, fallback: Column | None = None) -> Column:
    """The title's text, native; the fallback (a file's name, a host) where it is blank."""
    own = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return own if fallback is None else F.coalesce(F.nullif(own, F.lit("")), fallback)


def language(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<html[^>]*\blang=\"([^\"]*)\"", 1)


def charset(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<meta[^>]*\bcharset=\"?([A-Za-z0-9_-]+)", 1)


def first_heading(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", ""))

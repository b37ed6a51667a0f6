"""Fill-in-the-middle against plain Python."""

from __future__ import annotations

import hashlib
import re

from lodemill.llm import fill_in_middle

from .test_operators import DOCS, odd_rows


def plain_fim(key, text, seed: int = 1, plain: int = 10, back: int = 20) -> tuple:
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return len(units), "plain", None, None, text
    if h[3] % 100 < back:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(rows, **how) -> set[str]:
    for r in rows:
        want = plain_fim(r["doc_id"], r["text"], **how)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["moved"]) == want, r["doc_id"]
        assert r["restored"] == (r["text"] or "")
    return {r["form"] for r in rows}


def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = fill_in_middle.restore(fill_in_middle.transform(docs)).collect()
    assert len(got) == docs.count() and check(got) == {"plain", "psm", "spm"}


def test_marks_and_unusual_signs(spark):
    texts = ["<P>", "a<S>b", "x <M", "<", "<<P", "a<" * 30, "P>S>M>" * 5, "<P<S<M" * 9, "\0a\0", "é́ 日本 a😀b c\r\n", "Zz" * 400, " " * 50, "�﻿ab", "a", "İıſ", "word " * 30_000]
    docs = spark.createDataFrame([(i, t) for i in range(40) for t in texts], "doc_id long, text string")
    for how in ({}, {"seed": 7, "plain_percent": 0, "suffix_first_percent": 50}):
        got = fill_in_middle.restore(fill_in_middle.transform(docs, **how)).collect()
        names = {"seed": "seed", "plain_percent": "plain", "suffix_first_percent": "back"}
        assert len(got) == 40 * len(texts)
        check(got, **{names[k]: v for k, v in how.items()})


def test_odd_rows(spark):
    odd, none = spark.createDataFrame(odd_rows(), DOCS), spark.createDataFrame([], DOCS)
    got = fill_in_middle.restore(fill_in_middle.transform(odd))
    assert check(got.collect()) and got.columns == [*odd.columns, "n", "form", "prefix_chars", "middle_chars", "moved", "restored"]
    assert fill_in_middle.restore(fill_in_middle.transform(none)).count() == 0
    clash = odd.selectExpr("doc_id", "text", "'x' as N", "1 as form", "text as moved", "map('a', 1) as m", "doc_id as __draw", "text as __body")
    got = fill_in_middle.restore(fill_in_middle.transform(clash))
    assert check(got.collect()) and {"m", "__draw", "__body"} < set(got.columns)
    replaced = fill_in_middle.restore(fill_in_middle.transform(odd, out="text").select("doc_id", "text", "form"), text="text", out="text")
    assert sorted(map(str, replaced.select("doc_id", "text").collect())) == sorted(str(x) for x in odd.selectExpr("doc_id", "coalesce(text, '') as text").collect())

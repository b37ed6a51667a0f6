"""Keywords by trigrams against LIKE over all rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodemill.operators import keyword_index, store


def test_pieces_between_wild_cards():
    assert keyword_index.literals("ab%c_def") == ["ab", "c", "def"] and keyword_index.literals("%") == [] and keyword_index.literals("a\\%b") == ["a%b"]
    assert keyword_index.trigrams("abcab") == {"abc", "bca", "cab"} and keyword_index.trigrams("ab") == set()


@pytest.mark.parametrize("listed", [keyword_index.LISTED, 3])
def test_as_like_over_all_rows(spark, monkeypatch, listed):
    monkeypatch.setattr(keyword_index, "LISTED", listed)
    monkeypatch.setattr(keyword_index, "SPAN", 16)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé😀 ") for _ in range(rng.choice([0, 2, 3, 30, 200]))) for _ in range(300)] + [None, "abc", "abc", "100% abc_d", "x" * 50_000 + "needle"]
    rows = spark.createDataFrame([(k % 250, t, "z") for k, t in enumerate(texts)], "id long, t string, _m string").drop("_m")
    index = keyword_index.build(rows, "t", ["id", "t"])
    for keyword in ("abc", "ab", "é😀 ", "abé😀", "needle", "a%é a", "_b_a", "nothing", "%", "aaaa", "b a", "0\\% a"):
        want = store.matching(rows, contains={"t": keyword})
        assert sorted(map(str, index.search(keyword).collect())) == sorted(map(str, want.collect())), keyword
    assert keyword_index.build(rows.limit(0), "t", ["id"]).search("abc").count() == 0


def test_few_documents_are_read(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    index = keyword_index.build(docs, "text", ["doc_id"])
    n = docs.count()
    for keyword in ("license", "hereby granted", "zzz"):
        read, found = index.candidates(keyword).count(), docs.where(F.col("text").contains(keyword)).count()
        assert found <= read <= max(3 * found, 0.25 * n), (keyword, read, found)
    assert index.candidates("th") is None
    assert index.postings.agg(F.max(F.size("gaps"))).first()[0] <= keyword_index.SPAN


def test_trigrams_are_dealt_out_as_lists(spark, monkeypatch):
    monkeypatch.setattr(keyword_index, "SPAN", 4)
    texts = ["abcabc", "", "ab", None, "xabc\u00e9\U0001f600", "abcabd", "bca"]
    got = {(r["gram"], r["segment"]): r["at"] for r in keyword_index._lists(list(range(7)), [t or "" for t in texts]).to_pylist()}
    want = {}
    for k, t in enumerate(texts):
        for g in keyword_index.trigrams(t or ""):
            want.setdefault((g, k // 4), []).append(k % 4)
    assert got == want and got["abc", 0] == [0] and got["abc", 1] == [0, 1]
    rows = spark.createDataFrame(list(enumerate(texts)), "_n long, t string").coalesce(1)
    assert keyword_index._each(rows).count() == len({g for g, _ in want}) and keyword_index._each(rows.limit(0)).count() == 0


def test_large_alphabets_give_the_same_lists(monkeypatch):
    texts = ["abcabc", "", "\U0001f600\u00e9abc", "xyzabc", "ab"]
    want = keyword_index._lists(list(range(5)), texts)
    monkeypatch.setattr(keyword_index, "LARGEST", 0)
    assert keyword_index._lists(list(range(5)), texts).to_pylist() == want.to_pylist() and {r["gram"] for r in want.to_pylist()} == set().union(*map(keyword_index.trigrams, texts))


@pytest.mark.parametrize("limits", [(8, 1 << 20, 4096), (1, 1 << 20, 4096), (1, 0, 0), (10**9, 0, 0)])
def test_all_keywords_in_one_pass(spark, monkeypatch, limits):
    for name, value in zip(("OFTEN", "BROADCAST", "LISTED"), limits, strict=True):
        monkeypatch.setattr(keyword_index, name, value)
    monkeypatch.setattr(keyword_index, "SPAN", 16)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.choice([0, 2, 3, 30, 90]))) for _ in range(200)] + [None, "100% abc_d"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    index = keyword_index.build(rows, "t", ["id"])
    for words in (("abc", "a%d b", "b", "nothing", "cab", "0\\% a", "_abc"), ("abcd", "dcba", "nothing")):
        scans, search = [], keyword_index.KeywordIndex.search
        monkeypatch.setattr(keyword_index.KeywordIndex, "search", lambda *a: scans.append(a))
        got = sorted((r["keyword"], r["id"]) for r in index.search_all(words).collect())
        monkeypatch.setattr(keyword_index.KeywordIndex, "search", search)
        want = sorted((w, r["id"]) for w in words for r in store.matching(rows, contains={"t": w}).collect())
        assert got == want and not scans
    assert keyword_index.build(rows.limit(0), "t", ["id"]).search_all(("abc", "a")).count() == 0

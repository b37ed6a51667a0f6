"""Edit distances of short and long sequences against the plain table."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from lodemill.functions import evaluation


def plain(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        above, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            above, row[j + 1] = row[j + 1], min(above + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def changed(rng, text: str, n: int, letters: str) -> str:
    out = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(out) + 1), rng.random()
        if kind < 0.4 and at < len(out):
            out[at] = rng.choice(letters)
        elif kind < 0.7:
            out.insert(at, rng.choice(letters))
        elif at < len(out):
            del out[at]
    return "".join(out)


@pytest.mark.parametrize("columns", [1, 3, 64, 512])
def test_as_by_the_table(monkeypatch, columns):
    monkeypatch.setattr(evaluation, "COLUMNS", columns)
    rng = random.Random(columns)
    for _ in range(400):
        letters = rng.choice(["ab", "abcdeé😀"])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        b = changed(rng, a, rng.randint(0, 9), letters) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert evaluation.edit_distance(a, b) == plain(a, b), (a, b)
        for band in (abs(len(a) - len(b)) or 1, 7, 200):
            if a and b and band >= abs(len(a) - len(b)):
                found, true = evaluation._within(a, b, band), plain(a, b)
                assert found == true if true <= band else found >= true, (a, b, band)


def test_longer_sequences():
    rng = random.Random(9)
    a = "".join(rng.choice("abcd ") for _ in range(1500))
    for n in (0, 5, 200, 900):
        b = changed(rng, a, n, "abcd ")
        assert evaluation.edit_distance(a, b) == plain(a, b) == evaluation.edit_distance(list(b), list(a))
    assert evaluation.edit_distance(a, a[::-1]) == plain(a, a[::-1]) and evaluation.edit_distance(a, "") == len(a)


@pytest.mark.parametrize("least", [1, 8])
def test_many_pairs_side_by_side(monkeypatch, least):
    monkeypatch.setattr(evaluation, "LEAST", least)
    rng = random.Random(least)
    pairs = []
    for _ in range(300):
        letters = rng.choice(["ab", "abcdeé😀", "abcdefghijklmnopqrst "])
        a = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 20, 63, 64, 65, 128, 150])))
        pairs.append((a, changed(rng, a, rng.randint(0, 40), letters) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))))
    called, own = [], evaluation._side_by_side
    monkeypatch.setattr(evaluation, "_side_by_side", lambda *a: called.append(len(a[0])) or own(*a))
    assert evaluation.edit_distances(pairs) == [plain(a, b) for a, b in pairs]
    assert sum(called) > 200 and evaluation.edit_distances([]) == []


def test_texts_of_200_kb_take_seconds(spark):
    rng = random.Random(5)
    a = "".join(rng.choice("abcdefghij klmno.") for _ in range(200_000))
    near, far = changed(rng, a, 1000, "abc "), "".join(rng.choice("abcdefghij klmno.") for _ in range(200_000))
    began = time.perf_counter()
    assert 700 < evaluation.edit_distance(a, near) <= 1000
    assert time.perf_counter() - began < 20
    d = spark.createDataFrame([(1, a, near), (2, a, a), (3, "abc", "abd"), (4, "", a), (5, None, "x"), (6, a[:2100], near[:2100])], "id int, p string, t string")
    got = {r["id"]: r[1] for r in d.select("id", evaluation.character_accuracy(F.col("p"), F.col("t"))).collect()}
    assert got[2] == 1.0 and abs(got[3] - 2 / 3) < 1e-12 and got[4] == 0.0 and got[5] == 0.0
    assert abs(got[1] - (1 - evaluation.edit_distance(a, near) / max(len(a), len(near)))) < 1e-12 and abs(got[6] - (1 - plain(a[:2100], near[:2100]) / 2100)) < 1e-12
    assert evaluation.edit_distance(a[:40_000], far[:40_000]) > 10_000  # unlike each other: the band is the whole table


def test_word_accuracy_of_all_pairs_as_by_the_table(spark, sf):
    from lodemill.plans import catalog, text

    pairs = {r["doc_id"]: (r["guess"], r["truth"]) for r in text._pairs(spark, sf).collect()}
    got = {r["doc_id"]: r["accuracy"] for r in catalog.QUERIES["word_accuracy"](spark, sf).collect()}
    assert got.keys() == pairs.keys()
    for k, (guess, truth) in pairs.items():
        a, b = (" ".join(x.lower().split()).split(" ") if x else [] for x in (guess, truth))
        want = float(not a and not b) if not a or not b else 1 - plain(a, b) / max(len(a), len(b))
        assert abs(got[k] - want) < 1e-6, k


def test_recursive_chunks_hold_all_signs_in_order(spark, sf):
    """Without overlap chunks are the text, cut; none is longer than asked; a cut lies at the coarsest separator that serves."""
    from lodemill.functions import splitting

    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        for size in (40, 500):
            chunks = splitting.recursive(r["text"], size, 0)
            assert all(len(c) <= size for c in chunks)
            assert "".join("".join(chunks).split()) == "".join(r["text"].split())
            at = 0
            for c in chunks:
                at = r["text"].index(c, at) + len(c)
    assert splitting.recursive("aa\n\nbb\n\ncc", 8, 0) == ["aa\n\nbb\n\n", "cc"] and splitting.recursive("aa bb\ncc dd", 6, 0) == ["aa bb\n", "cc dd"]
    assert splitting.recursive("abcdef", 4, 1) == ["abcd", "def"] and splitting.recursive("one two three", 8, 2) == ["one two ", "o three"]
    assert splitting.recursive("", 4, 1) == [""] and splitting.recursive("   ", 2, 0) == []

"""Hard negatives against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemill.llm import hard_negatives

ROWS = "vec_id long, embedding array<float>, label int, anchor_id string, score double, id int"


def plain_negatives(rows, scale=None, positives=5, negatives=3, low=50, high=95, every=5) -> list[tuple]:
    one: dict[int, tuple] = {}
    for key, vector, label in rows:
        if key is None or vector is None or label is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        if key not in one or (label, vector) < one[key]:
            one[key] = (label, vector)
    whole = {k: (label, [int(np.floor(scale * float(np.float32(x)))) if scale else int(x) for x in v]) for k, (label, v) in one.items()}
    out = []
    for a, (label, v) in whole.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), k, other == label) for k, (other, w) in whole.items() if k != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [(n, k) for n, k, same in scored if not same and low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(a, p, i + 1, k, -s, -n) for i, (n, k) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **how) -> list[tuple]:
    table = spark.createDataFrame([(*r, "x", 0.5, 1) for r in rows], ROWS)
    return sorted(map(tuple, hard_negatives.mine(table, F.col("vec_id") % 5 == 0, **how).collect()))


def random_rows(n: int, size: int, seed: int, spread: int = 9) -> list[tuple]:
    rng = np.random.default_rng(seed)
    return [(int(k) - 20, [float(x) for x in rng.integers(-2, spread, size)], int(rng.integers(0, 4))) for k in range(n)]


def test_as_by_plain_loops(spark, monkeypatch):
    rows = random_rows(300, 6, 1)
    want = plain_negatives(rows)
    assert len(want) > 300 and mined(spark, rows) == want
    assert mined(spark, rows, group=7) == want  # several groups of anchors
    monkeypatch.setattr(hard_negatives, "TILE_ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "TILE_VECTORS", 11)
    assert mined(spark, rows) == want
    assert mined(spark, rows, positives=2, negatives=9, low=10, high=100) == plain_negatives(rows, positives=2, negatives=9, low=10, high=100)


def test_ties_copies_and_signs(spark):
    same = [(k, [1.0, 2.0], k % 2) for k in range(400)]
    assert mined(spark, same, high=100) == plain_negatives(same, high=100)
    mixed = random_rows(120, 2, 2, spread=3) + random_rows(120, 2, 2, spread=3)
    assert mined(spark, mixed) == plain_negatives(mixed)  # scores are zero or negative too; each row stands twice


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, None], 1), (2, None, 1), (3, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [4.0, 4.0], 1), (6, [9.0, 9.0], 1), (7, [3.0, 3.0], 2), (8, [3.0], 2), (9, [], 2), (10, [], 1), (11, [], 1)]
    got = mined(spark, rows)
    assert got == plain_negatives(rows) == [(0, 6, 1, 7, 8, 6), (10, 11, 1, 9, 0, 0)]
    assert mined(spark, []) == [] and mined(spark, rows[:1]) == []
    scaled = [(k, [float(x) / 7 for x in v], c) for k, v, c in random_rows(100, 5, 3)]
    assert mined(spark, scaled, scale=256) == plain_negatives(scaled, scale=256)


def test_large_components_stay_exact(spark):
    rows = [(k, [float(2**30 + k * 128), float(2**29 - 64 * k * k), 1.0], k % 3) for k in range(60)]
    assert mined(spark, rows) == plain_negatives(rows)
    with pytest.raises(Exception, match="do not fit"):
        mined(spark, [(k, [1e20, 1.0], 1) for k in range(6)])


def test_what_tasks_keep_can_be_merged():
    rng = np.random.default_rng(4)
    scores, ids = rng.integers(0, 5, (3, 200)).astype(float), np.arange(200)
    whole, parts = hard_negatives.Best(3, 5), hard_negatives.Best(3, 5)
    whole.offer(np.arange(3), scores, np.ones((3, 200), bool), ids)
    for columns in np.array_split(rng.permutation(200), 9):
        columns = np.sort(columns)
        parts.offer(np.arange(3), scores[:, columns], scores[:, columns] >= parts.floor(np.arange(3)), ids[columns])
    assert (whole.ids == parts.ids).all() and (whole.scores == parts.scores).all()
    assert whole.ids[0].tolist() == sorted(range(200), key=lambda k: (-scores[0, k], k))[:5]

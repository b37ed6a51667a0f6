"""Search over lists against scoring every vector."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemill.operators import retrieval, vector_lists
from lodemill.plans import retrieval as plans


def rows(df):
    return sorted((r["probe"] if r["probe"] is not None else -1, r["rank"], r["id"], r["score"]) for r in df.select("probe", "id", "score", "rank").collect())


def clustered(spark, n, seed, groups=20, size=16, spread=0.1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, size))
    x = centers[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, size))
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, vector array<float>")


def test_the_tables_of_the_catalogue(spark, sf):
    corpus, probes = plans.corpus(spark, sf).select("id", "vector"), plans.probes(spark, sf)
    lists = vector_lists.build(corpus, 20)
    assert rows(lists.search(probes, 20)) == rows(retrieval.top_k(corpus, probes, 20)) and lists.sizes.sum() == corpus.count()


@pytest.mark.parametrize("block", [7, retrieval.BLOCK])
def test_clusters_are_pruned_and_the_result_is_exact(spark, block):
    data = clustered(spark, 3000, 1)
    probes = data.where("id % 60 = 0").select(F.col("id").alias("probe"), F.col("vector").alias("probe_vector"))
    lists = vector_lists.build(data, 40)
    found, pairs = lists.searched(probes, 10, block)
    assert rows(found) == rows(retrieval.top_k(data, probes, 10))
    assert pairs.agg(F.sum("pairs")).first()[0] < 0.2 * 3000 * 50
    assert rows(lists.search(probes, 0)) == [] and len(rows(lists.search(probes.limit(2), 5000))) == 6000


def test_odd_vectors_and_ties(spark):
    data = [(k, [1.0, 0.0, 0.0, 1.0]) for k in range(40)] + [(40, None), (41, [0.0] * 4), (42, [1.0]), (43, []), (44, [-1.0, 0.0, 0.0, -1.0]), (45, [0.0, 1.0, 0.0, 0.0]), (46, [0.0, 2.0, 0.0, 0.0])]
    data = spark.createDataFrame(data, "id long, vector array<float>")
    probes = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 1.0]), (2, None), (3, [0.0] * 4), (4, [1.0, 2.0]), (5, [0.0, 1.0, 0.0, 0.0]), (6, [-1.0, -1.0, 0.0, 0.0])], "probe long, probe_vector array<float>")
    for n in (1, 3, 100):
        lists = vector_lists.build(data, n)
        for k in (1, 5, 44, 60):
            want = [r for r in rows(retrieval.top_k(data.where("size(vector) = 4 or vector is null or size(vector) != 4"), probes, k)) if r[0] != 4]
            assert [r for r in rows(lists.search(probes, k)) if r[0] != 4] == want, (n, k)
    assert {r[3] for r in rows(lists.search(probes, 3)) if r[0] == 4} == {0.0}
    none = vector_lists.build(data.limit(0), 4)
    assert rows(none.search(probes, 3)) == [] and rows(lists.search(probes.limit(0), 3)) == []


@pytest.mark.parametrize("side", [1, 7])
def test_a_task_scores_few_probes_at_a_time(spark, monkeypatch, side):
    monkeypatch.setattr(vector_lists, "SIDE", side)
    data = clustered(spark, 400, 5)
    probes = data.where("id % 20 = 0").select(F.col("id").alias("probe"), F.col("vector").alias("probe_vector"))
    assert rows(vector_lists.build(data, 8).search(probes, 6)) == rows(retrieval.top_k(data, probes, 6))

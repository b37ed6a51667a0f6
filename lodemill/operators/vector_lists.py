"""Exact vector search over lists: vectors lie by their nearest centroid, and lists that cannot hold a nearer one are not read.

Centroids are found by k-means over all vectors, as directions, so that cosine similarity and distance order alike. A list
knows its radius, and a vector its distance from the centroid; both bound what a probe can find there by the triangle
inequality. A probe first looks into the lists around it, which gives its k-th best so far, then into those whose bound is not
beyond that; of their vectors those are scored whose own bound is not. So the result is that of scoring all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodemill.functions.vectors import norm
from lodemill.operators import retrieval
from lodemill.sources.tables import written

#: Scores have six decimals; inside they are whole numbers of these.
UNIT = 1_000_000
#: Vectors and probes that a task scores at a time.
TILE, SIDE = 4096, 128


def _units(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of one size as directions, in double precision."""
    x = np.asarray(column.flatten(), np.float64).reshape(-1, size)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", centers, centers) - 2 * x @ centers.T, 0))


@dataclass
class Lists:
    """``table(list, offset, id, vector)`` in files by ranges of list and offset; the lists' centers, radii and sizes; ids of rows that have no direction of this ``size``."""

    table: DataFrame
    size: int
    centers: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    others: DataFrame

    def search(self, probes: DataFrame, k: int, block: int = retrieval.BLOCK) -> DataFrame:
        """``probe``, ``id``, ``score``, ``rank``: what ``retrieval.top_k`` gives for ``probes(probe, probe_vector)`` over the vectors of the lists.

        Probes that have no direction of this size have a score of 0 with every row. Probes are unique; they go out in
        blocks of at most ``block``, and only to files that may hold what they look for.
        """
        found, _ = self.searched(probes, k, block)
        return found

    def searched(self, probes: DataFrame, k: int, block: int = retrieval.BLOCK) -> tuple[DataFrame, DataFrame]:
        """The result of ``search``, and ``pairs``: how many pairs of a probe and a vector were scored, a row for each task that scored."""
        probes = written(probes.select("probe", "probe_vector"), "probes")
        n = norm(F.col("probe_vector"))
        fits = F.coalesce((F.size("probe_vector") == self.size) & (n > 0) & (n < float("inf")), F.lit(False))
        able, unable = probes.where(fits), probes.where(~fits)
        blocks = max(1, -(-able.count() // block))
        parts = [self._block(able.where(F.pmod(F.xxhash64("probe"), F.lit(blocks)) == b), k) for b in range(blocks)]
        kept = reduce(DataFrame.unionByName, parts)
        first = self.others.orderBy("id").limit(k)
        zero = able.select("probe").crossJoin(F.broadcast(first)).withColumn("score", F.lit(0).cast("long"))
        all_ids = self.table.select("id").unionByName(self.others).orderBy("id").limit(k)
        nothing = unable.select("probe").crossJoin(F.broadcast(all_ids)).withColumn("score", F.lit(0).cast("long"))
        every = kept.where("id is not null").select("probe", "id", "score").unionByName(zero).unionByName(nothing)
        place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "id"))
        best = every.withColumn("rank", place).where(F.col("rank") <= k).select("probe", "id", (F.col("score") / UNIT).alias("score"), "rank")
        return best, kept.where("id is null").select(F.col("score").alias("pairs"))

    def _block(self, probes: DataFrame, k: int) -> DataFrame:
        """Candidates ``probe, id, score`` of one block, which hold each probe's ``k`` best; rows without id count what was scored."""
        schema = f"probe {probes.schema['probe'].dataType.simpleString()}, id long, score long"
        arrow = probes.toArrow().combine_chunks()
        if not arrow.num_rows or not len(self.centers) or k <= 0:
            return probes.sparkSession.createDataFrame([], schema)
        units = _units(arrow.column(1).combine_chunks(), self.size)
        away = _distances(units, self.centers)
        order = np.argsort(away, axis=1, kind="stable")
        enough = np.cumsum(self.sizes[order], axis=1) - self.sizes[order] < k  # lists, nearest first, until there are k vectors
        near = np.zeros_like(away, bool)
        np.put_along_axis(near, order, enough, axis=1)
        first = written(self._scored(arrow.column(0), units, away, near, np.full(len(units), np.inf), k, schema), "near")
        place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "id"))
        kth = first.where("id is not null").withColumn("rank", place).where(F.col("rank") == k).select("probe", "score").toArrow()
        reached = dict(zip(kth.column(0).to_pylist(), kth.column(1).to_pylist(), strict=True))
        score = np.array([reached.get(p, -np.inf) for p in arrow.column(0).to_pylist()], np.float64)
        # a score that rounds to the k-th or more has a cosine of at least half a unit less
        most = np.sqrt(np.maximum(2 - 2 * (score - 0.5) / UNIT, 0)) + 1e-9
        far = ~near & (away - self.radii <= most[:, None])
        return first.unionByName(written(self._scored(arrow.column(0), units, away, far, most, k, schema), "far"))

    def _scored(self, names: pa.ChunkedArray, units: np.ndarray, away: np.ndarray, asked: np.ndarray, most: np.ndarray, k: int, schema: str) -> DataFrame:
        """The best of each task for each probe, from the lists that are ``asked`` for, among vectors that may lie within ``most``."""
        context = self.table.sparkSession.sparkContext
        wanted = np.flatnonzero(asked.any(axis=0))
        probes_of = {int(c): np.flatnonzero(asked[:, c]) for c in wanted}
        sent = context.broadcast((names, units, {c: away[p, c] for c, p in probes_of.items()}, probes_of, most))
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, units, away, probes_of, most = sent.value
            scores, ids, pairs = np.full((len(units), k), -UNIT * 4), np.zeros((len(units), k), np.int64), 0
            for whole in batches:
                for start in range(0, whole.num_rows, TILE):
                    batch = whole.slice(start, TILE)
                    lists, offsets, own = (np.asarray(batch.column(c)) for c in range(3))
                    vectors = _units(batch.column(3), size)
                    for c in np.unique(lists):
                        rows = np.flatnonzero(lists == c)
                        for first in range(0, len(probes_of[int(c)]), SIDE):
                            here = slice(first, first + SIDE)
                            p = probes_of[int(c)][here]
                            may = np.abs(away[int(c)][here, None] - offsets[rows]) <= most[p][:, None]
                            used = rows[may.any(axis=0)]
                            may = may[:, may.any(axis=0)]
                            pairs += int(may.sum())
                            if len(used):
                                got = np.where(may, np.floor(units[p] @ vectors[used].T * UNIT + 0.5).astype(np.int64), -UNIT * 4)
                                scores[p], ids[p] = _best(np.hstack([scores[p], got]), np.hstack([ids[p], np.broadcast_to(own[used], got.shape)]), k)
            for first in range(0, len(units), TILE):
                at, rank = np.nonzero(scores[first : first + TILE] > -UNIT * 4)
                kept = names.take(pa.array(first + at)).combine_chunks() if isinstance(names, pa.ChunkedArray) else names.take(pa.array(first + at))
                yield pa.RecordBatch.from_arrays([kept, pa.array(ids[first + at, rank]), pa.array(scores[first + at, rank])], ["probe", "id", "score"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, names.type), pa.nulls(1, pa.int64()), pa.array([pairs])], ["probe", "id", "score"])

        rows = self.table.where(F.col("list").isin(wanted.tolist())) if len(wanted) else self.table.limit(0)
        return rows.select("list", "offset", "id", "vector").mapInArrow(run, schema)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` of each row: higher scores first, ties by smaller id."""
    if scores.shape[1] > 4 * k:  # those that tie with the k-th stay
        floor = np.partition(scores, -k, axis=1)[:, -k]
        keep = (scores >= floor[:, None]).any(axis=0)
        scores, ids = scores[:, keep], ids[:, keep]
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def build(rows: DataFrame, n_lists: int = 100, iterations: int = 5, size: int | None = None) -> Lists:
    """Lists of ``rows(id, vector)``: ids are different whole numbers. ``size`` is the vectors' length, by default the most frequent one.

    K-means starts from ``n_lists`` vectors, those of the smallest hash, and takes ``iterations`` rounds over all vectors; the
    centers go out to every task, so their number is to be bounded (100 000 of 64 components are 50 MB). Rows whose vector is
    null, of another length, or without a direction are kept by their ids alone, since their score is 0 whatever is asked.
    """
    if size is None:
        top = rows.where("vector is not null").groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
        size = top["n"] if top else 0
    n = norm(F.col("vector"))
    fits = F.coalesce((F.size("vector") == size) & (n > 0) & (n < float("inf")), F.lit(False))
    able = rows.where(fits).select(F.col("id").cast("long").alias("id"), "vector")
    start = able.select("vector", F.xxhash64("id").alias("_h"), "id").orderBy("_h", "id").limit(n_lists).select("vector").toArrow().combine_chunks()
    others = written(rows.where(~fits).select(F.col("id").cast("long").alias("id")), "others")
    if not start.num_rows:
        empty = able.sparkSession.createDataFrame([], "list int, offset double, id long, vector array<float>")
        return Lists(empty, size, np.zeros((0, size)), np.zeros(0), np.zeros(0, np.int64), others)
    centers = _units(start.column(0).combine_chunks(), size)
    for _ in range(iterations):
        centers = _moved(able, centers, size)
    placed = _placed(able, centers, size)
    table = written(placed.repartitionByRange("list", "offset", "id").sortWithinPartitions("list", "offset", "id"), "lists")
    known = table.groupBy("list").agg(F.max("offset").alias("radius"), F.count("*").alias("n")).toArrow()
    radii, sizes, at = np.full(len(centers), -np.inf), np.zeros(len(centers), np.int64), np.asarray(known.column(0))
    radii[at], sizes[at] = np.asarray(known.column(1)) + 1e-9, np.asarray(known.column(2))
    return Lists(table, size, centers, radii, sizes, others)


def _moved(rows: DataFrame, centers: np.ndarray, size: int) -> np.ndarray:
    """Centers of what is nearest to each center: sums by task, added up by list. One that is nearest to nothing stays."""
    sent = rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = sent.value
        sums, counts = np.zeros_like(centers), np.zeros(len(centers), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, TILE):
                x = _units(batch.column(0).slice(start, TILE), size)
                nearest = np.argmin(_distances(x, centers), axis=1)
                np.add.at(sums, nearest, x)
                counts += np.bincount(nearest, minlength=len(centers))
        has = np.flatnonzero(counts)
        place = np.arange(size)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(has, size)), pa.array(np.tile(place, len(has))), pa.array(sums[has].ravel())], ["list", "place", "sum"])

    found = rows.select("vector").mapInArrow(run, "list long, place long, sum double").groupBy("list", "place").agg(F.sum("sum").alias("sum")).toArrow()
    out = np.zeros_like(centers)
    out[np.asarray(found.column(0)), np.asarray(found.column(1))] = np.asarray(found.column(2))
    length = np.sqrt(np.einsum("ij,ij->i", out, out))
    return np.where((length > 1e-12)[:, None], out / np.maximum(length, 1e-12)[:, None], centers)


def _placed(rows: DataFrame, centers: np.ndarray, size: int) -> DataFrame:
    """``list, offset, id, vector``: each vector with its nearest center and how far that is."""
    sent = rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TILE):
                batch = whole.slice(start, TILE)
                away = _distances(_units(batch.column(1), size), sent.value)
                nearest = np.argmin(away, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(nearest.astype(np.int32)), pa.array(away[np.arange(len(nearest)), nearest]), batch.column(0), batch.column(1)], ["list", "offset", "id", "vector"])

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.mapInArrow(run, f"list int, offset double, id long, vector {kind}")

"""Hard-negative mining by exact inner products: blocked dense matrix products in float64.

Anchors are a part of the rows and grow with them, so they go out in groups of bounded size: one group is broadcast at a
time and every task multiplies it, tile by tile, with the vectors of its own partition. Components are whole numbers, so a
product in float64 is exact below 2**53. A task keeps for each anchor its best five positives, or for each anchor and
positive its best three negatives, whatever the partition holds; what tasks kept is merged by rank windows. Negatives need
the positives' scores, so there are two passes over the vectors for a group of anchors.

Work is anchors times vectors by nature; a stated set of anchors is held against all vectors in blocks, nothing is joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Anchors that are broadcast together (64 components of 8 bytes: 16 MB), and the tile of anchors by vectors that a task multiplies at a time.
GROUP, TILE_ANCHORS, TILE_VECTORS = 32_768, 512, 4_096
#: Below every score.
LOWEST = np.iinfo(np.int64).min


class Best:
    """The first ``k`` of what each of ``n`` askers has been offered: higher scores first, ties by smaller id. What two tasks kept can be merged."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.scores, self.ids = np.full((n, k), LOWEST), np.zeros((n, k), np.int64)

    def floor(self, askers: np.ndarray) -> np.ndarray:
        """The score that a newcomer has to reach, as a column."""
        return self.scores[askers, -1][:, None]

    def offer(self, askers: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """A tile of scores, a row for each asker and a column for each of the ids; only where ``allowed``."""
        if np.count_nonzero(allowed) > 8 * self.k * len(askers) and len(ids) > self.k:
            within = np.where(allowed, scores, LOWEST)
            allowed = allowed & (scores >= np.partition(within, -self.k, axis=1)[:, -self.k][:, None])
        row, column = np.nonzero(allowed)
        if not len(row):
            return
        met = np.unique(row)
        held = askers[met]
        rows = np.concatenate([row, np.repeat(met, self.k)])
        values = np.concatenate([scores[row, column].astype(np.int64), self.scores[held].ravel()])
        names = np.concatenate([ids[column], self.ids[held].ravel()])
        order = np.lexsort((names, -values, rows))  # the lowest score is its own negative and comes last by the next line
        order = order[values[order] > LOWEST]
        rows, values, names = rows[order], values[order], names[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        take = rank < self.k
        at, rank = askers[rows[take]], rank[take]
        self.scores[held], self.ids[held] = LOWEST, 0
        self.scores[at, rank], self.ids[at, rank] = values[take], names[take]


@dataclass
class Vectors:
    """Rows of one length: ids, labels, and components as whole numbers in float64."""

    ids: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray

    def products(self, others: Vectors, start: int, stop: int) -> np.ndarray:
        """Inner products of the rows from ``start`` to ``stop`` with all ``others``, exact in any case."""
        ours = self.matrix[start:stop]
        most = float(np.abs(ours).max(initial=0)) * float(np.abs(others.matrix).max(initial=0)) * max(ours.shape[1], 1)
        if most < 2**53:
            return ours @ others.matrix.T
        if most < 2**63:
            return ours.astype(np.int64) @ others.matrix.T.astype(np.int64)
        raise ValueError("components are so large that their products do not fit in 64 bits")


def _by_length(batch: pa.RecordBatch | pa.Table, scale: float | None) -> Iterator[Vectors]:
    """Columns id, label, vector as tiles of rows of equal length, each by ascending id."""
    lists = batch.column(2)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes, values = np.asarray(lists.value_lengths()), np.asarray(lists.flatten(), np.float64)
    starts = np.cumsum(sizes) - sizes
    ids, labels = (np.asarray(batch.column(k)) for k in (0, 1))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        matrix = values[starts[rows][:, None] + np.arange(size)]
        yield Vectors(ids[rows], labels[rows], matrix if scale is None else np.floor(scale * matrix))


def _tiles(batches: Iterator[pa.RecordBatch], anchors: dict[int, Vectors], scale: float | None) -> Iterator[tuple[int, int, Vectors, Vectors, np.ndarray]]:
    """Each tile of scores: the vectors' length, the first of its anchors, the anchors, the vectors, the scores."""
    for whole in batches:
        for start in range(0, whole.num_rows, TILE_VECTORS):
            for vectors in _by_length(whole.slice(start, TILE_VECTORS), scale):
                size = vectors.matrix.shape[1]
                if size in anchors:
                    ours = anchors[size]
                    for first in range(0, len(ours.ids), TILE_ANCHORS):
                        stop = min(first + TILE_ANCHORS, len(ours.ids))
                        yield size, first, Vectors(ours.ids[first:stop], ours.labels[first:stop], ours.matrix[first:stop]), vectors, ours.products(vectors, first, stop)


def _kept(best: Best, names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    """What was kept as rows: ``columns`` of the asker, then id and score."""
    asker, rank = np.nonzero(best.scores > LOWEST)
    return pa.RecordBatch.from_arrays([pa.array(c[asker]) for c in [*columns]] + [pa.array(best.ids[asker, rank]), pa.array(best.scores[asker, rank])], names)


def valid_vectors(rows: DataFrame, key: str, vector: str, label: str, anchor: Column) -> DataFrame:
    """``id``, ``label``, ``vector``, ``anchor`` of the rows that take part, one for each id."""
    v = F.col(f"`{vector}`")
    sound = F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    part = rows.where(F.coalesce(sound, F.lit(False))).select(F.col(f"`{key}`").cast("long").alias("id"), F.struct(F.col(f"`{label}`").cast("long").alias("label"), v.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor")).alias("row"))
    return part.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*")


def mine(rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, group: int = GROUP) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives of each anchor and positive.

    Anchors are the rows for which ``anchor`` holds. An anchor's positives are its first ``positives`` other rows of the same
    label by score; the negatives of a positive are the first ``negatives`` rows of another label whose score is from ``low``
    to ``high`` percent of the positive's. Higher scores come first, ties by smaller id; all are returned if there are fewer,
    and a pair that has none has no row. ``scale`` makes whole numbers of components, floor(scale * x); without it they
    have to be whole. Keys and labels are whole numbers.

    Rows with a null key or label, a null vector, or a component that is null or not finite take no part. Of rows that share
    a key one counts, by least label, then vector, so that repeated rows count once. Vectors of different lengths have no
    score. No rows give none. Components whose products may pass 2**53 are multiplied as 64-bit integers; beyond that it raises.
    """
    spark = rows.sparkSession
    vectors = materialize(valid_vectors(rows, key, vector, label, anchor), "vectors")
    groups = max(1, -(-vectors.where("anchor").count() // group))
    if vectors.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        vectors = vectors.repartition(spark.sparkContext.defaultParallelism, "id")  # few bytes, much work
    found = [_mine_group(vectors, F.pmod(F.xxhash64("id"), F.lit(groups)) == g, scale, positives, negatives, low, high, last=groups == 1) for g in range(groups)]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows for each ``by``, with their ``rank``."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def _mine_group(vectors: DataFrame, chosen: Column, scale: float | None, positives: int, negatives: int, low: int, high: int, last: bool) -> DataFrame:
    """The rows of one group of anchors; written out unless it is the only group, so that its broadcast can go."""
    context = vectors.sparkSession.sparkContext
    asked = vectors.where(F.col("anchor") & chosen).select("id", "label", "vector").toArrow()
    anchors = {x.matrix.shape[1]: x for x in _by_length(asked, scale)}
    block, all_rows = context.broadcast(anchors), vectors.select("id", "label", "vector")
    near = _first(all_rows.mapInArrow(_positives(block, scale, positives), "anchor_id long, id long, score long"), ["anchor_id"], positives)
    pairs = near.select("anchor_id", "id", "score", "rank").toArrow()  # at most ``positives`` for each anchor of the group
    windows = context.broadcast(_windows(anchors, pairs, positives, low, high))
    far = all_rows.mapInArrow(_negatives(block, windows, scale, positives, negatives), "anchor_id long, positive_id long, positive_score long, id long, score long")
    out = _first(far, ["anchor_id", "positive_id"], negatives).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    if last:
        return out
    out = materialize(out, "negatives")
    block.destroy(), windows.destroy()
    return out


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _positives(block, scale: float | None, k: int) -> Mapper:
    """The best ``k`` positives of each anchor that a partition holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        best = {size: Best(len(x.ids), k) for size, x in anchors.items()}
        for size, first, ours, others, scores in _tiles(batches, anchors, scale):
            askers = np.arange(first, first + len(ours.ids))
            allowed = (ours.labels[:, None] == others.labels) & (ours.ids[:, None] != others.ids) & (scores >= best[size].floor(askers))
            best[size].offer(askers, scores, allowed, others.ids)
        for size, x in anchors.items():
            yield _kept(best[size], ["anchor_id", "id", "score"], [x.ids])

    return run


@dataclass
class Windows:
    """For each anchor and place a positive's id and score, and the lowest and highest score of its negatives; an empty window where there is none."""

    ids: np.ndarray
    scores: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _windows(anchors: dict[int, Vectors], pairs: pa.Table, k: int, low: int, high: int) -> dict[int, Windows]:
    anchor, other, score, rank = (np.asarray(c) for c in pairs.columns)
    out = {}
    for size, x in anchors.items():
        w = Windows(*[np.full((len(x.ids), k), fill) for fill in (0, 0, 1, 0)])
        mine = np.flatnonzero(np.isin(anchor, x.ids))
        at = np.searchsorted(x.ids, anchor[mine]), rank[mine] - 1
        w.ids[at], w.scores[at] = other[mine], score[mine]
        w.low[at] = [-(-low * s // 100) for s in score[mine].tolist()]
        w.high[at] = [high * s // 100 for s in score[mine].tolist()]
        out[size] = w
    return out


def _negatives(block, windows, scale: float | None, positives: int, k: int) -> Mapper:
    """The best ``k`` negatives within the window of each anchor and positive that a partition holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, asked = block.value, windows.value
        best = {size: Best(len(x.ids) * positives, k) for size, x in anchors.items()}
        for size, first, ours, others, scores in _tiles(batches, anchors, scale):
            different, w = ours.labels[:, None] != others.labels, asked[size]
            stop = first + len(ours.ids)
            for place in range(positives):
                askers = np.arange(first, stop) * positives + place
                least = np.maximum(w.low[first:stop, place][:, None], best[size].floor(askers))
                best[size].offer(askers, scores, different & (scores >= least) & (scores <= w.high[first:stop, place][:, None]), others.ids)
        for size, x in anchors.items():
            w = asked[size]
            yield _kept(best[size], ["anchor_id", "positive_id", "positive_score", "id", "score"], [np.repeat(x.ids, positives), w.ids.ravel(), w.scores.ravel()])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor of ``embeddings``, whose labels are first changed where vec_id is divisible by 7."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0, scale=256)


ORACLE = """
with sound as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.id as anchor_id, a.label = b.label as same, b.id, list_inner_product(a.v, b.v)::bigint as score
  from (select * from sound where id % 50 = 0) a join sound b on a.id <> b.id),
positives as (select anchor_id, id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
negatives as (
  select p.*, s.id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id)::int as rank
  from positives p join scored s on s.anchor_id = p.anchor_id and not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from negatives where rank <= 3"""

"""Connected components of a table of links, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the least node it is connected to) for every node of ``links(a, b)``.

    A round of large stars ties each node's larger neighbours to the least neighbour, a round of small stars does so
    with the smaller ones; both shrink paths to stars in a logarithmic number of rounds, hold at most as many rows as
    there are links, and never gather a node's neighbours in one place. Null ends and links of a node to itself are
    ignored; an empty table gives an empty result.
    """
    edges = links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "links")
    before = _state(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(least).distinct()
        edges = materialize(small, "stars")
        after = _state(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        before = after
    raise RuntimeError("the stars did not settle")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

"""Quality classifier: a document's own evidence and its site's record, by hierarchical empirical Bayes.

A logistic model over a text's shape gives each document a probability of being good. Summed by host and by path these
give the record of a site; a path's record is shrunk toward its host's, a host's toward the whole corpus', as strongly
as the spread between hosts (and between paths of a host) says that records are chance. A site's posterior against the
corpus' then moves the document's own odds, by a bounded amount.

Texts are read once. Everything after the features works on narrow rows. Sums by host and path are decimal, so they do
not depend on the order of the rows. The table of sites is joined as a broadcast only up to a counted size; a larger
one is joined in shards, so that a host with a third of all rows is dealt over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import identified, materialize, slices, spare, string_bytes
from .linear import fit_dense

#: Labelled rows that the model is fitted on at most; they are taken by a hash of the key.
SAMPLE = 20_000
#: A document is kept from this posterior probability on.
THRESHOLD = 0.5
#: How far a site may move a document's log odds, and how sure a document's own evidence may be.
SITE_LIMIT, OWN_LIMIT = 1.5, 8.0
#: Sites that are broadcast at most; over how many shards a larger table of sites is copied.
BROADCAST_SITES, SHARDS = 50_000, 32
#: Bytes of text that a task looks at at a time.
SLICE = 4 << 20

#: Classes of bytes that are counted: other signs, upper case, digits, bars, exclamation marks, line feeds, letters.
CLASSES = ("#$%&*+<=>@^_~`\\{}[]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "|", "!", "\n", "abcdefghijklmnopqrstuvwxyz")
FEATURES = 13


def features_of(texts: list[str | None], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The shape of each text, a row of ``FEATURES`` numbers."""
    sizes = np.diff(offsets)
    counts = np.zeros((len(sizes), len(CLASSES)))
    for k, signs in enumerate(CLASSES):
        table = np.zeros(256, np.int64)
        table[list(signs.encode())] = 1
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=total[1:])
        counts[:, k] = total[offsets[1:]] - total[offsets[:-1]]
    words = np.zeros((len(sizes), 4))
    for i, text in enumerate(texts):
        if text:
            w = text.split()
            n = len(w)
            words[i] = n, len(set(w)), sum(a == b for a, b in zip(w, w[1:], strict=False)), len(set(zip(w, w[1:], w[2:], strict=False)))
    n, size = np.maximum(words[:, 0], 1), np.maximum(sizes, 1)
    signs, upper, digits, bars, marks, feeds, lower = counts.T
    return np.column_stack(
        [
            np.log1p(words[:, 0]), np.minimum(np.log1p(size / n), 4), np.minimum(signs / n, 3), upper / np.maximum(upper + lower, 1), digits / size, np.minimum(bars / n, 1), np.minimum(marks / n, 1),
            words[:, 1] / n, words[:, 1] / np.sqrt(n), words[:, 2] / n, words[:, 3] / np.maximum(n - 2, 1), np.minimum(feeds / n, 1), (words[:, 0] == 0).astype(float),
        ]
    )


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``features``, array<double>. A null text is an empty one."""
    others = [c for c in docs.columns if c not in (text, "features")]
    kept = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in slices(whole, text, SLICE):
                column = batch.column(batch.num_columns - 1)
                x = features_of(column.to_pylist(), *string_bytes(column))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*others, "features"])

    return kept.mapInArrow(run, kept.drop(text).withColumn("features", F.array().cast("array<double>")).schema)


def fit(featured: DataFrame, labels: DataFrame, key: str, label: str, sample: int = SAMPLE) -> Column:
    """The log odds that a row of ``featured`` is good, as a column of its ``features``.

    Fitted on at most ``sample`` different labels of 0 or 1, each with one row: of several with its key, the one of the
    least features. Without both kinds of labels the odds are even.
    """
    chosen = labels.where(F.col(f"`{label}`").isin(0, 1)).select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("y")).where("k is not null").distinct()
    chosen = chosen.orderBy(F.xxhash64("k"), "k", "y").limit(sample)
    joined = featured.join(F.broadcast(chosen), F.col(f"`{key}`") == F.col("k")).groupBy("k", "y").agg(F.min("features").alias("features"))
    rows = joined.orderBy("k", "y").collect()
    y = np.array([r["y"] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return F.lit(0.0)
    x = np.array([r["features"] for r in rows])
    middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    w = fit_dense((x - middle) / spread, y, l2=0.3)
    scaled = w[:-1] / spread
    total = F.lit(float(w[-1] - scaled @ middle))
    for k, weight in enumerate(scaled):
        total = total + F.get("features", F.lit(k)) * float(weight)
    return total


def _exact(x: Column) -> Column:
    return F.sum(x.cast("decimal(20,9)")).cast("double")


def _squares(n: str) -> Column:
    """The sum of a count's squares; these pass the digits of ``_exact`` from 316 228 rows of a site on."""
    return F.sum(F.col(n).cast("decimal(19,0)") * F.col(n).cast("decimal(19,0)")).cast("double")


def log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def sites(evidence: DataFrame) -> DataFrame:
    """``host``, ``path``, ``host_posterior``, ``path_posterior``, ``prior`` from ``evidence(host, path, p)``, a row for each path.

    Posterior means of a Beta prior whose strength is set by moments: from the variance of the hosts' means around the
    corpus' mean (of the paths' means around their hosts'), less what chance explains, between 1 and 10000 documents.
    """
    paths = materialize(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), _exact(F.col("p")).alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), _exact(F.col("s")).alias("host_s"))
    n, mean = hosts.agg(F.sum("host_n"), F.sum(F.col("host_s").cast("decimal(38,9)")).cast("double") / F.sum("host_n")).first()
    mean = min(max(mean if mean is not None else 0.5, 1e-4), 1 - 1e-4)
    between = hosts.agg(_exact(F.col("host_n") * (F.col("host_s") / F.col("host_n") - mean) ** 2), F.count("*"), _squares("host_n")).first()
    strength = _strength(mean, n or 0, *between)
    hosts = hosts.withColumn("host_posterior", (F.col("host_s") + strength * mean) / (F.col("host_n") + strength))
    joined = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    within = joined.agg(_exact(F.col("n") * (F.col("s") / F.col("n") - F.col("host_s") / F.col("host_n")) ** 2), F.count("*"), _squares("n")).first()
    strength = _strength(mean, n or 0, *within)
    return joined.select("host", "path", "host_posterior", ((F.col("s") + strength * F.col("host_posterior")) / (F.col("n") + strength)).alias("path_posterior"), F.lit(mean).alias("prior"))


def _strength(mean: float, n: int, squares: float | None, groups: int, n_squared: float | None) -> float:
    """Documents that the prior counts for."""
    if groups < 2 or not squares or not n_squared:
        return 10_000.0
    chance = mean * (1 - mean)
    spread = (squares - (groups - 1) * chance) / max(n - n_squared / n, 1.0)
    return 10_000.0 if spread <= 0 else min(max(chance / spread - 1, 1.0), 10_000.0)


def with_sites(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join rows with their site by host and path, nulls being equal."""
    table = materialize(table, "sites")
    if table.count() <= BROADCAST_SITES:
        right = F.broadcast(table.withColumnRenamed("host", "_host").withColumnRenamed("path", "_path"))
        return rows.join(right, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))).drop("_host", "_path")
    right = table.select(F.col("host").alias("_host"), F.col("path").alias("_path"), *[c for c in table.columns if c not in ("host", "path")], F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("_at"))
    left = rows.withColumn("_shard", F.pmod(F.xxhash64("__id"), F.lit(SHARDS)).cast("int"))
    on = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")) & (F.col("_shard") == F.col("_at"))
    return left.join(right, on).drop("_host", "_path", "_at", "_shard")


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``__id``, ``key``, ``host``, ``path``, ``own`` (probability by the text alone), ``host_posterior``, ``path_posterior``, ``quality``, ``keep``.

    A row for each row of ``docs``; ``__id`` tells rows of one key with different texts apart. Null hosts and paths are
    sites of their own. A null or empty text has the shape of an empty one. Labels other than 0 and 1, and labels of
    unknown documents, are ignored; without good and bad ones nothing is known and everything is kept. An empty table
    gives an empty result.
    """
    names = {"key": key, "host": host, "path": path, "text": text}
    rows = docs.select(*[F.col(f"`{c}`").alias(name) for name, c in names.items()])
    return _score(identified(rows, "key", "text"), labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label")), sample, threshold)


def _score(docs: DataFrame, labels: DataFrame, sample: int, threshold: float) -> DataFrame:
    """As ``score``, for ``docs(__id, key, host, path, text)`` and ``labels(key, label)``."""
    narrow = docs.select("__id", "key", F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path"), "text")
    featured = materialize(features(narrow), "features")
    own = F.greatest(F.least(fit(featured, labels, "key", "label", sample), F.lit(OWN_LIMIT)), F.lit(-OWN_LIMIT))
    rows = featured.select("__id", "key", "host", "path", F.round(1 / (1 + F.exp(-own)), 9).alias("own"))
    rows = with_sites(rows, sites(rows.select("host", "path", F.col("own").alias("p"))))
    shift = log_odds(F.col("path_posterior")) - log_odds(F.col("prior"))
    quality = 1 / (1 + F.exp(-(log_odds(F.col("own")) + F.greatest(F.least(shift, F.lit(SITE_LIMIT)), F.lit(-SITE_LIMIT)))))
    return rows.withColumn("quality", F.round(quality, 6)).withColumn("keep", F.col("quality") >= threshold).drop("prior")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with their columns."""
    own, bad = spare(docs.columns, "__id"), spare(docs.columns, "__bad")
    marked = identified(docs, key, text, own)
    names = {"__id": own, "key": key, "host": host, "path": path, "text": text}
    scored = _score(marked.select(*[F.col(f"`{c}`").alias(name) for name, c in names.items()]), labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label")), sample, threshold)
    gone = scored.where("not keep").select(F.col("__id").alias(bad)).distinct()
    return marked.join(gone, F.col(own) == F.col(bad), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being good, with its source as host and its language as path."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, labels)
    digits = [F.round(c, 6).alias(c) for c in ("own", "host_posterior", "path_posterior")]
    return out.select(F.col("key").alias("doc_id"), *digits, "quality", "keep")

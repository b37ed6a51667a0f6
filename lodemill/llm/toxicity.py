"""Toxicity by classifier chains: categories are predicted one after another.

The linear model of a category sees a text's terms and, in steps, the log odds of the categories before it. While fitting,
those come from out-of-fold predictions, by models that have neither chosen their terms nor been fitted on the documents
that they predict, so that a later model learns from probabilities as good as it will meet. Terms are words, starts of
words and kinds of marks; they are counted on the executors and chosen there by chi-squared.

Labels that say no more than toxic or not are told apart by kind: a toxic document that holds a seed word of a kind is of
this kind (and may be of several). The kinds come first in the chain, toxic last, so that it learns from all of them; what
a kind's model learns beside its seeds are the words that stand with them. Scoring is a map over whole texts, without a
shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices
from .linear import fit_sparse, sigmoid

#: Labelled rows that the models are fitted on at most (by a hash of the key), terms that each model has, folds.
SAMPLE, TERMS, FOLDS = 20_000, 1_000, 3
#: Documents of the sample in which a term stands at least.
SEEN = 3
#: A document has a category from this probability on.
THRESHOLD = 0.3
#: Kinds of toxic documents by seed words: names that people are called, and judgements of worth.
KINDS = {"insult": ("idiot", "moron", "loser", "clown", "scum"), "contempt": ("trash", "pathetic", "disgusting", "worthless", "stupid")}
#: Log odds from which on each step of an earlier category counts.
STEPS = np.array([-4.0, -2.0, 0.0, 2.0, 4.0])
#: Lengths of the starts of words that are terms.
STARTS = (4, 5, 6)
#: Bytes of text that a task looks at at a time, words whose terms it keeps.
SLICE, KEPT_WORDS = 4 << 20, 300_000

WORDS = re.compile(r"\w+|[^\w\s]+")


def terms_of(word: str) -> list[str]:
    """The terms of a word or a run of marks: itself, its starts, and whether it is in capitals."""
    low = word.lower()
    out = [low, *(f"{low[:n]}*" for n in STARTS if len(low) > n)]
    if len(word) > 1 and word.isupper():
        out.append("^")
    return out


def text_terms(text: str | None) -> set[str]:
    return {t for w in set(WORDS.findall(text)) for t in terms_of(w)} if text else set()


def count_terms(sample: DataFrame, categories: list[str], folds: int) -> DataFrame:
    """``term`` and, for each fold, ``n<fold>`` documents that hold it and ``c<fold>_<k>`` of category k, counted on the executors.

    ``sample`` has ``fold``, ``text`` and a column of 0 and 1 for each category.
    """
    width = 1 + len(categories)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in rows:
            y = np.column_stack([np.ones(batch.num_rows, np.int64), *(np.asarray(batch.column(k + 2)) for k in range(len(categories)))]).tolist()
            for fold, text, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), y, strict=True):
                for t in text_terms(text):
                    c = counts.get(t)
                    if c is None:
                        c = counts[t] = [0] * (width * folds)
                    for k, v in enumerate(row):
                        c[fold * width + k] += v
            if len(counts) > 300_000:
                yield out(counts)
                counts = {}
        if counts:
            yield out(counts)

    def out(counts: dict[str, list[int]]) -> pa.RecordBatch:
        table = np.array(list(counts.values()), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(list(counts)), *map(pa.array, table.T)], ["term", *names])

    names = [f"n{f}" if k == 0 else f"c{f}_{k - 1}" for f in range(folds) for k in range(width)]
    kept = sample.select("fold", "text", *[F.col(f"`{c}`").cast("long") for c in categories])
    return kept.mapInArrow(run, "term string, " + ", ".join(f"{c} long" for c in names)).groupBy("term").agg(*[F.sum(c).alias(c) for c in names])


def choose_terms(counted: DataFrame, totals: np.ndarray, k: int, without: int | None, n: int = TERMS) -> list[str]:
    """The ``n`` terms with the largest chi-squared against category k, over all folds but one.

    ``totals`` has a row for each fold: its documents, and those of each category. What reaches the driver is ``n`` terms.
    """
    folds = [f for f in range(len(totals)) if f != without]
    every, positive = (float(totals[folds, c].sum()) for c in (0, k + 1))
    n1, a = (reduce(lambda x, y: x + y, (F.col(c.format(f)) for f in folds)).cast("double") for c in ("n{}", f"c{{}}_{k}"))
    apart = a * every - n1 * positive
    chi = apart * apart / (n1 * (every - n1) + 1)
    return [r[0] for r in counted.where(n1 >= SEEN).orderBy(chi.desc(), "term").limit(n).select("term").collect()]


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def stepped(before: np.ndarray) -> np.ndarray:
    """For each row and each category before, which of the steps its log odds reach."""
    return (before[:, :, None] >= STEPS).reshape(len(before), -1).astype(float)


class Chain:
    """Models of categories in order: terms, and for each category weights of its terms, of the steps before it, and a bias."""

    def __init__(self, terms: list[str], weights: np.ndarray, links: list[np.ndarray], bias: np.ndarray) -> None:
        self.terms, self.weights, self.links, self.bias = terms, weights, links, bias

    def log_odds(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        """For documents that hold term columns[k] in row rows[k]: a column for each category."""
        out = np.zeros((n, len(self.bias)))
        for k in range(len(self.bias)):
            out[:, k] = np.bincount(rows, self.weights[k][columns], minlength=n) + self.bias[k] + stepped(out[:, :k]) @ self.links[k]
        return out


def _fit_one(rows: np.ndarray, columns: np.ndarray, own: np.ndarray, before: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the terms in ``own`` (a mask), of the steps that the log odds before reach, and the bias."""
    use, width = own[columns], len(own)
    more_rows, more_columns = np.nonzero(stepped(before))
    w = fit_sparse(np.concatenate([rows[use], more_rows]), np.concatenate([columns[use], width + more_columns]), len(y), width + before.shape[1] * len(STEPS), y, l2=0.1, rounds=300)
    return w[:width] * own, w[width:-1], float(w[-1])


def fit_chain(rows: np.ndarray, columns: np.ndarray, fold: np.ndarray, ys: np.ndarray, terms: list[str], chosen: dict[tuple[int, int | None], np.ndarray]) -> Chain:
    """A chain from documents (of which rows[i] holds term columns[i]) with their folds and categories.

    ``chosen[k, f]`` is a mask of the terms for category k without fold f, and ``chosen[k, None]`` of those over all. A
    category with one value only gets its rate. The last category needs no out-of-fold predictions.
    """
    n, m = ys.shape
    weights, links, bias = np.zeros((m, len(terms))), [np.zeros(k * len(STEPS)) for k in range(m)], np.zeros(m)
    before = np.zeros((n, 0))
    for k in range(m):
        y = ys[:, k]
        if not 0 < y.sum() < n:
            bias[k] = logit(np.array([y.mean() if n else 0.0]))[0]
            before = np.column_stack([before, np.full(n, bias[k])])
            continue
        weights[k], links[k], bias[k] = _fit_one(rows, columns, chosen[k, None], before, y)
        if k + 1 == m:
            break
        outside = np.zeros(n)
        for f in np.unique(fold).tolist():
            train = fold != f
            place, mine = np.cumsum(train) - 1, train[rows]
            if not 0 < y[train].sum() < train.sum():
                outside[~train] = logit(np.array([y[train].mean() if train.any() else y.mean()]))[0]
                continue
            w, link, b = _fit_one(place[rows[mine]], columns[mine], chosen[k, f], before[train], y[train])
            outside[~train] = (np.bincount(rows, w[columns], minlength=n) + stepped(before) @ link + b)[~train]
        before = np.column_stack([before, outside])
    return Chain(terms, weights, links, bias)


def fit(sample: DataFrame, categories: list[str], terms: int = TERMS, folds: int = FOLDS) -> Chain:
    """A chain over ``sample(fold, text, categories)``, whose size the caller bounds."""
    counted = materialize(count_terms(sample, categories, folds), "terms")
    sums = {r["fold"]: r for r in sample.groupBy("fold").agg(F.count("*").alias("_n"), *[F.sum(f"`{c}`").alias(f"_{k}") for k, c in enumerate(categories)]).collect()}
    totals = np.array([[sums[f]["_n"], *(sums[f][f"_{k}"] for k in range(len(categories)))] if f in sums else [0] * (1 + len(categories)) for f in range(folds)], np.int64)
    asked = [(k, f) for k in range(len(categories)) for f in ((None,) if k + 1 == len(categories) else (None, *range(folds)))]
    words = {key: choose_terms(counted, totals, *key, terms) for key in asked}
    every = sorted({t for own in words.values() for t in own})
    number = {t: k for k, t in enumerate(every)}
    chosen = {key: np.isin(np.arange(len(every)), [number[t] for t in own]) for key, own in words.items()}
    shared = sample.sparkSession.sparkContext.broadcast(number)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(shared.value)
        for batch in rows:
            found = [sorted(known.of(x)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), *batch.columns[1:]], ["terms", "fold", *categories])

    kept = sample.select("text", "fold", *[F.col(f"`{c}`").cast("long") for c in categories])
    got = kept.mapInArrow(run, T.StructType([T.StructField("terms", T.ArrayType(T.IntegerType())), *kept.schema.fields[1:]])).toArrow()
    lists, fold = got.column("terms").to_pylist(), np.asarray(got.column("fold"))
    ys = np.column_stack([np.asarray(got.column(c)) for c in categories]).astype(float)
    order = sorted(range(len(lists)), key=lambda i: (fold[i], lists[i], *ys[i]))  # the same sums in whatever order the rows come
    sizes = [len(lists[i]) for i in order]
    rows, columns = np.repeat(np.arange(len(order)), sizes), np.array([c for i in order for c in lists[i]], np.int64)
    return fit_chain(rows, columns, fold[order], ys[order], every, chosen)


class Known(dict):
    """The numbers of the chosen terms in a word, by word."""

    def __init__(self, number: dict[str, int]) -> None:
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = tuple(self.number[t] for t in terms_of(word) if t in self.number)
        self[word] = out
        return out

    def of(self, text: str | None) -> set[int]:
        if len(self) > KEPT_WORDS:
            self.clear()
        return {k for got in map(self.__getitem__, set(WORDS.findall(text))) if got for k in got} if text else set()


def score(docs: DataFrame, chain: Chain, categories: list[str], text: str = "text") -> DataFrame:
    """Replace ``text`` by a probability ``p_<category>`` for each category. A null or empty text has no terms."""
    names = [f"p_{c}" for c in categories]
    others = [c for c in docs.columns if c != text and c not in names]
    kept = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`"))
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Chain = shared.value
        known = Known({t: k for k, t in enumerate(model.terms)})
        for whole in rows:
            for batch in slices(whole, text, SLICE):
                found = [known.of(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
                sizes = [len(x) for x in found]
                columns = np.array([k for x in found for k in sorted(x)], np.int64)
                p = sigmoid(model.log_odds(np.repeat(np.arange(len(found)), sizes), columns, len(found)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(np.ascontiguousarray(x)) for x in p.T)], [*others, *names])

    return kept.mapInArrow(run, T.StructType([*kept.drop(text).schema.fields, *(T.StructField(c, T.DoubleType()) for c in names)]))


def classify(docs: DataFrame, labels: DataFrame, categories: list[str], key: str = "doc_id", text: str = "text", sample: int = SAMPLE, terms: int = TERMS, kinds: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``docs`` without ``text``, with ``p_<category>`` for each category, in the order of the chain.

    ``labels`` has ``key`` and a column of 0 and 1 for each category; rows with other values or a null key, and labels
    of unknown documents, are ignored, and repeated ones count once. ``kinds`` are categories by seed words, of what the
    last category holds; they come before it. At most ``sample`` labels are used, each with one text: of several documents
    with its key, that of the least hash. Without labels of both kinds a category's probability is its rate (0 without
    any). Rows of ``docs`` are scored each for itself, repeated ones alike. An empty table gives an empty result.
    """
    kinds = kinds or {}
    every = [*categories[:-1], *kinds, categories[-1]]
    valid = reduce(lambda a, b: a & b, (F.col(f"`{c}`").isin(0, 1) for c in categories)) & F.col(f"`{key}`").isNotNull()
    chosen = labels.where(valid).select(F.col(f"`{key}`").alias("_k"), *[F.col(f"`{c}`") for c in categories]).distinct()
    chosen = chosen.orderBy(F.xxhash64("_k"), "_k", *categories).limit(sample)
    joined = docs.select(F.col(f"`{key}`").alias("_d"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), F.col("_d") == F.col("_k"))
    joined = joined.groupBy("_k", *categories).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    seen = [(F.coalesce(F.regexp_like(F.lower("text"), F.lit(rf"(?<!\w)(?:{'|'.join(map(re.escape, seeds))})(?!\w)")), F.lit(False)) & (F.col(f"`{categories[-1]}`") == 1)).cast("int").alias(kind) for kind, seeds in kinds.items()]
    joined = materialize(joined.select(F.pmod(F.xxhash64("_k"), F.lit(FOLDS)).cast("int").alias("fold"), "text", *categories[:-1], *seen, categories[-1]), "labelled")
    return score(docs, fit(joined, every, terms), every, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities of insult, of contempt and of being toxic, the earlier ones feeding the later."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = classify(docs, labels, ["toxic"], kinds=KINDS)
    return out.select("doc_id", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in (*KINDS, "toxic")], (F.col("p_toxic") >= THRESHOLD).alias("toxic"))

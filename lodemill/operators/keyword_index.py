"""Keyword search by trigrams: posting lists, intersected, and what they leave verified by LIKE.

Rows are numbered; a trigram's list holds the numbers of the rows whose text has it, as differences, in segments of a fixed
span of numbers, so that a trigram that stands in every row is many short lists in many places. A keyword's trigrams are
looked up in the files that may hold them, and only the rows that all of them share are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.sources.tables import written

#: Row numbers of a segment, and row numbers up to which rows are asked for by a filter that files are skipped by.
SPAN, LISTED = 1 << 15, 4096
#: A keyword that a row in so many may hold is not looked up; row numbers that are broadcast; what a trigram and its text may make as one number.
OFTEN, BROADCAST, LARGEST = 8, 1 << 20, 1 << 62
#: Signs of text whose trigrams a task holds before it hands them on.
HELD = 1_000_000


def literals(pattern: str) -> list[str]:
    """The pieces of a LIKE pattern that stand in every text it fits: what lies between its wild cards."""
    out, held, at = [], "", 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            held += pattern[at + 1]
            at += 1
        elif c in "%_":
            out.append(held)
            held = ""
        else:
            held += c
        at += 1
    return [x for x in [*out, held] if x]


def trigrams(text: str) -> set[str]:
    return {text[k : k + 3] for k in range(len(text) - 2)}


def grams_of(keyword: str) -> list[str]:
    """The trigrams that a text which a keyword fits has to hold."""
    return sorted(set().union(*[trigrams(x) for x in literals(keyword)]))


def _each(rows: DataFrame) -> DataFrame:
    """``gram``, ``segment``, ``at``: the trigrams of ``rows(_n, text)``, each with the numbers of the texts that hold it, among those that a task holds at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, texts, held = [], [], 0
        for batch in batches:
            for n, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                numbers.append(n)
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held > HELD:
                    yield _lists(numbers, texts)
                    numbers, texts, held = [], [], 0
        yield _lists(numbers, texts)

    return rows.mapInArrow(run, "gram string, segment long, at array<int>")


def _lists(numbers: list[int], texts: list[str]) -> pa.RecordBatch:
    """Trigrams of some texts, by segment, with the places of their texts in it in ascending order."""
    signs = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(np.array(numbers, np.int64), kind="stable")
    n = np.array(numbers, np.int64)[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    met = np.zeros(0x110000, bool)
    met[signs] = True
    alphabet = np.flatnonzero(met)  # signs by their places in it, so that a trigram and its text are one number, sorted once
    signs, many, some = (np.cumsum(met, dtype=np.int32) - 1)[signs].astype(np.int64), max(1, len(n)), max(1, len(alphabet))
    grams = (signs[:-2] * some + signs[1:-1]) * some + signs[2:] if len(signs) > 2 else np.zeros(0, np.int64)
    owner, ends = np.repeat(rank, sizes), np.repeat(np.cumsum(sizes), sizes)
    whole = np.arange(len(grams)) + 2 < ends[: len(grams)]  # within one text
    grams, owner, known = grams[whole], owner[: len(grams)][whole], None
    if some**3 * many >= LARGEST:
        known, grams = np.unique(grams, return_inverse=True)
    pairs = np.sort(grams * many + owner)
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
    code, number = pairs // many, n[pairs % many]
    segment = number // SPAN
    fresh = np.r_[True, code[1:] != code[:-1]] if len(code) else np.zeros(0, bool)
    begins = np.flatnonzero(fresh | np.r_[True, segment[1:] != segment[:-1]]) if len(code) else np.zeros(0, np.int64)
    different = code[fresh] if known is None else known[code[fresh]]
    code = np.cumsum(fresh) - 1
    spelled = alphabet[np.stack([different // (some * some), different // some % some, different % some], axis=1)].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    names = pa.array([spelled[k : k + 3] for k in range(0, len(spelled), 3)], pa.string())
    at = pa.ListArray.from_arrays(pa.array(np.r_[begins, len(code)], pa.int32()), pa.array((number % SPAN).astype(np.int32)))
    return pa.RecordBatch.from_arrays([names.take(pa.array(code[begins])), pa.array(segment[begins]), at], ["gram", "segment", "at"])


def _members(lists: DataFrame) -> DataFrame:
    """``k``, ``_n`` of the rows that all ``least`` of a keyword's lists hold, from ``lists(k, least, segment, gaps)``.

    What is shuffled are the lists; those of a keyword and a segment are counted side by side.
    """

    span = SPAN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, least, segment, held in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                at = np.flatnonzero(np.bincount(np.concatenate([np.cumsum(np.asarray(gaps.values), dtype=np.int64) for gaps in held.values])) == least)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(segment * span + at)], ["k", "_n"])

    return lists.groupBy("k", "least", "segment").agg(F.collect_list("gaps")).mapInArrow(run, "k int, _n long")


@dataclass
class KeywordIndex:
    """``rows`` with their numbers ``_n``, in files by number, and ``postings(gram, segment, gaps)``, in files by trigram."""

    rows: DataFrame
    postings: DataFrame
    text: str

    def _shared(self, grams: dict[int, list[str]]) -> DataFrame:
        """``k``, ``_n`` of the rows that hold all ``grams[k]``."""
        spark = self.rows.sparkSession
        asked = spark.createDataFrame([(g, k, len(own)) for k, own in grams.items() for g in own], "gram string, k int, least int")
        lists = self.postings.where(F.col("gram").isin(sorted(set().union(*grams.values()))))
        return _members(lists.join(F.broadcast(asked), "gram").select("k", "least", "segment", "gaps"))

    def candidates(self, keyword: str) -> DataFrame | None:
        """``_n`` of the rows that hold all trigrams of a keyword; none if it has no trigram, so that every row may fit."""
        grams = grams_of(keyword)
        return self._shared({0: grams}).select("_n") if grams else None

    def search_all(self, keywords: Sequence[str]) -> DataFrame:
        """``keyword`` beside the rows that ``search`` finds of each, in one pass over the rows.

        A keyword without trigrams, and one that more than a row of ``OFTEN`` may hold, is asked of every row.
        """
        grams = {k: own for k, word in enumerate(keywords) if (own := grams_of(word))}
        found = written(self._shared(grams), "candidates") if grams else self.rows.select(F.lit(0).alias("k"), "_n").limit(0)
        counts, n = dict(found.groupBy("k").count().collect()), self.rows.count()
        rare = [k for k in grams if counts.get(k, 0) * OFTEN <= n]
        held = found.where(F.col("k").isin(rare)).groupBy("_n").agg(F.collect_set("k").alias("_ks"))
        some = sum(counts.get(k, 0) for k in rare)
        if len(rare) == len(keywords) and some <= LISTED:
            rows = self.rows.where(F.col("_n").isin([r["_n"] for r in held.select("_n").collect()])).join(F.broadcast(held), "_n")
        else:
            rows = self.rows.join(F.broadcast(held) if some <= BROADCAST else held, "_n", "inner" if len(rare) == len(keywords) else "left")
        # a text without a keyword's pieces is left out before its wild cards are tried at every place
        fits = lambda k: reduce(and_, [F.contains(self.text, F.lit(x)) for x in literals(keywords[k])], F.lit(True)) & F.col(self.text).like(f"%{keywords[k]}%")
        may = lambda k: F.array_contains("_ks", F.lit(k)) & fits(k) if k in rare else fits(k)
        words = F.array_compact(F.array(*[F.when(may(k), F.lit(word)) for k, word in enumerate(keywords)]))
        return rows.select(F.explode(words).alias("keyword"), *[c for c in self.rows.columns if c != "_n"])

    def search(self, keyword: str) -> DataFrame:
        """The rows whose text is LIKE ``%keyword%``, as ``store.matching`` finds them; wild cards in a keyword are wild."""
        fits = F.col(self.text).like(f"%{keyword}%")
        found = self.candidates(keyword)
        if found is None:
            return self.rows.where(fits).drop("_n")
        found = written(found, "candidates")
        n = found.count()
        if n <= LISTED:
            return self.rows.where(F.col("_n").isin([r[0] for r in found.collect()])).where(fits).drop("_n")
        return self.rows.join(found, "_n", "left_semi").where(fits).drop("_n")


def build(rows: DataFrame, text: str, order: list[str]) -> KeywordIndex:
    """An index of ``text``; rows are numbered in the order of ``order``. Null texts hold nothing; texts are taken whole.

    A text gives each of its trigrams once. What is dealt out by trigram and segment are lists over many texts, not a row for
    each text and trigram; a segment's list has at most ``SPAN`` numbers.
    """
    from lodemill.operators.store import numbered

    placed = written(numbered(rows, order).withColumn("_n", F.col("_n") - 1).repartitionByRange("_n").sortWithinPartitions("_n"), "rows")
    lists = _each(placed.select("_n", F.col(text).cast("string"))).groupBy("gram", "segment").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("at"))
    gaps = F.transform("at", lambda x, i: x - F.when(i > 0, F.get(F.col("at"), i - 1)).otherwise(0))
    postings = lists.select("gram", "segment", gaps.alias("gaps")).repartitionByRange("gram", "segment").sortWithinPartitions("gram", "segment")
    return KeywordIndex(placed, written(postings, "postings"), text)

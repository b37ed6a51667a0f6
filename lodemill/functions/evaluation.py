"""Measures of parsed documents against a truth: accuracies, tables, token compression, questions and answers."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import estimate_tokens_by_script

#: A line that parts a table's header from its rows.
TABLE_RULE = r"^\|[-:|\s]+\|$"


def _by_emptiness(predicted: Column, truth: Column, value: Column) -> Column:
    """1 if both are empty or null, 0 if one is, else the value."""
    no_truth, no_guess = F.coalesce(truth == "", F.lit(True)), F.coalesce(predicted == "", F.lit(True))
    return F.when(no_truth & no_guess, 1.0).when(no_truth | no_guess, 0.0).otherwise(value)


#: Cells of a table of edit distances from which a pair of texts goes to the bit-parallel way alone, and columns that share a window.
LONG, COLUMNS = 4_000_000, 512
#: Cells from which pairs go there side by side; pairs of a block at most, and at least; signs of their longer texts; words of the shorter ones.
SHORT, MOST, LEAST, SIGNS, WORDS = 4096, 1024, 64, 1 << 22, 16


def character_accuracy(predicted: Column, truth: Column) -> Column:
    """1 less the edit distance over the longer length, in code points; all but short texts are compared 64 cells a word, many pairs at a time."""
    n, m = F.length(predicted), F.length(truth)
    long = n.cast("long") * m > SHORT
    far = _long_distance(F.when(long, predicted), F.when(long, truth))
    return _by_emptiness(predicted, truth, 1 - F.when(long, far).otherwise(F.levenshtein(F.when(~long, predicted), F.when(~long, truth))) / F.greatest(n, m))


@F.pandas_udf(T.IntegerType())
def _long_distance(predicted: pd.Series, truth: pd.Series) -> pd.Series:
    there = np.flatnonzero((predicted.notna() & truth.notna()).to_numpy())
    out = pd.Series([None] * len(predicted), dtype="Int32")
    out.iloc[there] = edit_distances(list(zip(predicted.iloc[there], truth.iloc[there], strict=True)))
    return out


def edit_distances(pairs: list[tuple[str, str]]) -> list[int]:
    """``edit_distance`` of many pairs of texts. Pairs whose shorter texts take as many words of 64 bits go side by side, a column at a time."""
    out, groups = [0] * len(pairs), {}
    for k, (a, b) in enumerate(pairs):
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        words = -(-len(short) // 64)
        if words > WORDS or not words or len(short) * len(long) > LONG:
            out[k] = edit_distance(long, short)
        else:
            groups.setdefault(words, []).append((len(long), k, short, long))
    for words, group in groups.items():
        group.sort(key=lambda x: -x[0])
        while group:
            size = min(MOST, max(LEAST, SIGNS // group[0][0]))
            alone = max(0, LEAST - 1) if len(group) >= LEAST else len(group)
            # the longest go alone where most of the block would have to wait for them
            alone = sum(n > 1.25 * group[alone][0] for n, *_ in group[:alone]) if alone < len(group) else alone
            for _, k, short, long in group[:alone]:
                out[k] = edit_distance(long, short)
            block, group = group[alone : alone + size], group[alone + size :]
            if block:
                for (_, k, _, _), d in zip(block, _side_by_side([x[2] for x in block], [x[3] for x in block], words), strict=True):
                    out[k] = int(d)
    return out


def _side_by_side(short: list[str], long: list[str], words: int) -> np.ndarray:
    """Edit distances of pairs, the longest ``long`` first.

    A column is the differences of neighbouring rows as two sets of bits, in ``words`` words for each pair; what leaves one
    word at its end enters the next. Columns go over the longer texts, and a pair is done when its own has ended.
    """
    points = lambda texts: np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n, m, k = np.array([len(x) for x in long]), np.array([len(x) for x in short]), len(short)
    letters, code = np.unique(points(short), return_inverse=True)
    pair, row = np.repeat(np.arange(k), m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    equal = np.zeros((words, len(letters) + 1, k), np.uint64)  # the last letter stands for all others
    np.bitwise_or.at(equal, (row >> 6, code, pair), np.uint64(1) << (row & 63).astype(np.uint64))
    equal = equal.reshape(words, -1)
    signs = points(long)
    at = np.minimum(np.searchsorted(letters, signs), len(letters) - 1)
    place = np.where(letters[at] == signs, at, len(letters))
    owner, column = np.repeat(np.arange(k), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    columns = np.zeros((n[0], k), np.int32)
    columns[column, owner] = place * k + owner
    going = np.searchsorted(-n, -np.arange(n[0]), side="left")  # pairs whose longer text has a column of this number
    one, top, end = np.uint64(1), np.uint64(63), ((m - 1) & 63).astype(np.uint64)
    up, down = np.full((words, k), ~np.uint64(0)), np.zeros((words, k), np.uint64)
    distance = m.astype(np.int64)
    for j in range(n[0]):
        g = going[j]
        more, less = one, np.uint64(0)  # the row above all others grows by one each column
        for w in range(words):
            p, q, same = up[w, :g], down[w, :g], equal[w].take(columns[j, :g])
            across = same | q
            same |= less
            steps = (((same & p) + p) ^ p) | same
            plus, minus = q | ~(steps | p), p & steps
            if w == words - 1:
                distance[:g] += ((plus >> end[:g]) & one).astype(np.int64) - ((minus >> end[:g]) & one).astype(np.int64)
            plus, more = (plus << one) | more, plus >> top
            minus, less = (minus << one) | less, minus >> top
            up[w, :g] = minus | ~(across | plus)
            down[w, :g] = plus & across
    return distance


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of strings or lists: within a band about the diagonal, which widens until the distance fits in."""
    start, stop = 0, min(len(a), len(b))
    while start < stop and a[start] == b[start]:
        start += 1
    end = 0
    while end < stop - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not len(a) or not len(b):
        return len(a) or len(b)
    band = max(abs(len(a) - len(b)), 64)
    while True:
        found = _within(a, b, band)
        if found <= band or band >= max(len(a), len(b)):
            return found
        band *= 4


def _within(a: Sequence, b: Sequence, band: int) -> int:
    """The distance if it is ``band`` or less, else no less than it.

    Columns go over ``b``; a column is the differences of neighbouring rows as two sets of bits, one for +1 and one for -1, in
    whole numbers of any length. Columns that stand together have a window of rows about the diagonal; below it the distance
    is taken to grow by one each column, and above it by one each row, which no way within the band depends on.
    """
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    low, high = 0, 0
    up, down, distance = 0, 0, 0  # of the rows from low to high, and the value of the last of them
    for first in range(0, len(b), COLUMNS):
        columns = b[first : first + COLUMNS]
        if (new := max(0, first - band)) > low:
            up, down, low = up >> (new - low), down >> (new - low), new
        if (new := min(len(a), first + len(columns) + band)) > high:
            up |= ((1 << (new - high)) - 1) << (high - low)
            distance, high = distance + new - high, new
        every, last, same = (1 << (high - low)) - 1, high - low - 1, {}
        for x in columns:
            equal = same.get(x)
            if equal is None:
                own = places.get(x, ())
                bits = bytearray((high - low) // 8 + 1)
                for i in own[bisect_left(own, low) : bisect_left(own, high)]:
                    bits[(i - low) >> 3] |= 1 << ((i - low) & 7)
                equal = same[x] = int.from_bytes(bits, "little")
            free = equal | down
            across = (((equal & up) + up) ^ up) | equal
            plus = down | (every & ~(across | up))
            minus = up & across
            distance += (plus >> last & 1) - (minus >> last & 1)
            plus, minus = (plus << 1 | 1) & every, minus << 1 & every
            up = minus | (every & ~(free | plus))
            down = plus & free
    return distance


def _normal(text: str) -> str:
    return re.sub(r"\s+", " ", text.strip()).lower()


@F.pandas_udf(T.DoubleType())
def word_accuracy(predicted: pd.Series, truth: pd.Series) -> pd.Series:
    """1 less the edit distance of lower-cased words over the longer count."""

    def one(p: str | None, t: str | None) -> float:
        if not p or not t:
            return float(not p and not t)
        a, b = _normal(p).split(" "), _normal(t).split(" ")
        return 1 - edit_distance(a, b) / max(len(a), len(b))

    return pd.Series([one(p, t) for p, t in zip(predicted, truth, strict=True)])


def table_rows(markdown: str) -> list[tuple[str, ...]]:
    """Cells of the rows of a Markdown table: trimmed, without bold marks, in lower case."""
    out = []
    for line in map(str.strip, markdown.split("\n")):
        if line.startswith("|") and line.endswith("|") and not re.fullmatch(TABLE_RULE[1:-1], line):
            cells = line[1:-1].split("|")
            while len(cells) > 1 and not cells[-1]:
                cells.pop()
            out.append(tuple(_normal(re.sub(r"\*\*(.+?)\*\*", r"\1", c.strip())) for c in cells))
    return out


@F.pandas_udf(T.DoubleType())
def table_similarity(predicted: pd.Series, truth: pd.Series) -> pd.Series:
    """1 less the edit distance of rows, over the nodes of the larger table (a root, its rows, their cells)."""

    def one(p: str | None, t: str | None) -> float:
        if not p or not t:
            return float(not p and not t)
        a, b = table_rows(p), table_rows(t)
        nodes = max(1 + sum(1 + len(r) for r in x) for x in (a, b))
        return min(1.0, max(0.0, 1 - edit_distance(a, b) / nodes))

    return pd.Series([one(p, t) for p, t in zip(predicted, truth, strict=True)])


def overall_accuracy(characters: Column, words: Column, tables: Column) -> Column:
    return 0.4 * characters + 0.3 * words + 0.3 * F.coalesce(tables, F.lit(0.0))


def full_accuracy(characters: Column, words: Column, tables: Column, compressed: Column) -> Column:
    """The overall accuracy and its parts, beside what ``compression`` says; ``tables`` is null where either side has none."""
    return F.struct(characters.alias("characters"), words.alias("words"), F.coalesce(tables, F.lit(0.0)).alias("tables"), overall_accuracy(characters, words, tables).alias("overall"), compressed.alias("compression"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, also where it is asked for within a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normal_words(text: Column) -> Column:
    """Lower-cased words of a trimmed text."""
    return F.split(F.lower(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")), " ", -1)


def information_retention(original: Column, compressed: Column) -> Column:
    """The share of the original's words of three letters or more that contain, or are contained in, one of the other's."""
    significant = F.filter(normal_words(original), lambda w: F.length(w) > 2)
    covered = let(F.array_distinct(normal_words(compressed)), lambda others: F.size(F.filter(significant, lambda w: F.exists(others, lambda c: F.contains(c, w) | F.contains(w, c)))))
    share = F.when(F.size(significant) > 0, covered / F.size(significant)).otherwise(1.0)
    return F.when(F.coalesce(original == "", F.lit(True)), 1.0).when(F.coalesce(compressed == "", F.lit(True)), 0.0).otherwise(share)


def compression(original: Column, compressed: Column) -> Column:
    """Tokens of both, their ratio (1 if nothing is left), the retention, and the product of the two."""
    a, b = estimate_tokens_by_script(original), estimate_tokens_by_script(compressed)
    ratio = F.when(b > 0, a / b).otherwise(1.0)
    kept = information_retention(original, compressed)
    return F.struct(a.alias("original_tokens"), b.alias("compressed_tokens"), ratio.alias("ratio"), kept.alias("retention"), (ratio * kept).alias("effective"))


def _covered(text: Column, words: Column) -> Column:
    """The share of words that have three letters or more and stand in the text."""
    return let(words, lambda ws: let(text, lambda t: F.size(F.filter(ws, lambda w: (F.length(w) > 2) & F.contains(t, w))) / F.size(ws)))


def contains_answer(text: Column, answer: Column) -> Column:
    """Whether seven tenths of an answer's words stand in the text."""
    flat = F.regexp_replace(F.lower(text), r"\s+", " ")
    return F.coalesce(_covered(flat, F.split(F.regexp_replace(F.lower(answer), r"\s+", " "), " ", -1)) >= 0.7, F.lit(False))


def relevancy(text: Column, question: Column, answer: Column) -> Column:
    """The mean share of the question's and of the answer's words that stand in the text."""
    low = F.lower(text)
    parts = [_covered(low, F.split(F.lower(x), r"\s+", -1)) for x in (question, answer)]
    return F.coalesce((parts[0] + parts[1]) / 2, F.lit(0.0))


def structure_score(titles: Column, texts: Column, tables: Column, images: Column) -> Column:
    parts = ((titles, 0.3), (texts, 0.4), (tables, 0.2), (images, 0.1))
    total = sum((F.when(n > 0, w).otherwise(0.0) for n, w in parts), F.lit(0.0))
    return F.least(F.lit(1.0), total)


def diversity_score(*counts: Column) -> Column:
    """The share of five kinds of elements that are there."""
    return sum((F.when(n > 0, 1).otherwise(0) for n in counts), F.lit(0)) / 5.0


def parsing_score(accuracy: Column, structure: Column, confidence: Column, ratio: Column, retention: Column, coverage: Column, relevance: Column) -> Column:
    """Weighted mean of what is known (not null) of accuracy 0.3, structure 0.2, compression 0.2, answers 0.3; 0 of nothing."""
    parts = ((accuracy, 0.3), ((structure + confidence) / 2, 0.2), (F.least(F.lit(1.0), ratio / 10) * retention, 0.2), ((coverage + relevance) / 2, 0.3))
    total = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in parts), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(0.0)


def recommendations(accuracy: Column, confidence: Column, tables: Column, elements: Column, ratio: Column, retention: Column) -> Column:
    """What to look at, as array<string>; ``good`` if nothing."""
    found = F.array_compact(
        F.array(
            F.when(accuracy < 0.9, "character accuracy"),
            F.when(confidence < 0.8, "confidence"),
            F.when((tables == 0) & (elements > 10), "tables"),
            F.when(ratio < 2.0, "compression"),
            F.when(retention < 0.8, "retention"),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("good"))).otherwise(found)

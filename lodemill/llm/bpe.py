"""Byte-level BPE by replaying the merges over all distinct words of a slice of the corpus at once.

Each map task takes the distinct words of its documents. An inverted index holds, for each rank (that is, for the pairs
that make this token), the positions in all these words where such a pair stands. Ranks are taken in order, least first,
and of a rank the positions from left to right; a merge unlinks one position and looks up anew only the two pairs at its
neighbours, which go into the index. So a word of n bytes costs O(n log n), also one of a million letters.

Words that a task has met are kept in a bounded table, so a corpus costs its distinct words, not its length. There is no
shuffle, and a lost task is simply run again. The index spans the slice that a task holds, not the corpus: a word encodes
alike everywhere, and one index for all would shuffle every word of every text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Words that a task keeps; beyond it the table starts anew.
KEPT_WORDS = 250_000
#: Bytes of text that are encoded at a time, and the largest vocabulary file that is broadcast.
SLICE, MAX_VOCABULARY = 3 << 20, 64 << 20
#: New words that are encoded side by side, and ids that are decoded at a time.
WORDS, IDS = 1 << 14, 1 << 18


class Replay:
    """Encodes words by ranks: a dict of a token's bytes to its rank, which is its id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        single = [ranks.get(bytes([b]), -1) for b in range(256)]
        if min(single) < 0:
            raise ValueError("the vocabulary lacks single bytes")
        self.single = np.array(single, np.int64)
        get = ranks.get
        #: The rank of the token that two tokens make, by both of them in one number.
        self.made = {x << 32 | y: r for b, r in ranks.items() for k in range(1, len(b)) if (x := get(b[:k])) is not None and (y := get(b[k:])) is not None}

    def index(self, symbols: np.ndarray, inner: np.ndarray) -> dict[int, list[int]]:
        """For each rank the ascending positions whose symbol makes it with the next; ``inner`` are those with a next in the word."""
        ranks = np.fromiter(map(self.made.get, (symbols[inner] << 32 | symbols[inner + 1]).tolist(), repeat(-1)), np.int64, len(inner))
        inner, ranks = inner[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        found, cuts = np.unique(ranks[order], return_index=True)
        positions = inner[order].tolist()
        return {r: positions[a:b] for r, a, b in zip(found.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(positions)], strict=False)}

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and where each word's begin; a word that is itself a token is that token."""
        n = len(words)
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, n)
        split = np.flatnonzero(whole < 0)
        data = np.frombuffer(b"".join([words[i] for i in split.tolist()]), np.uint8)
        word = np.repeat(split, np.fromiter((len(words[i]) for i in split.tolist()), np.int64, len(split)))
        start = self.single[data]
        index = self.index(start, np.flatnonzero(word[1:] == word[:-1]))
        symbols = np.frombuffer(_replayed(index, start, word, self.made), np.int32)
        left = symbols >= 0
        owner = np.concatenate([np.flatnonzero(whole >= 0), word[left]])
        ids = np.concatenate([whole[whole >= 0], symbols[left]])
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(owner, minlength=n), out=offsets[1:])
        return ids[np.argsort(owner, kind="stable")].astype(np.int32), offsets


def _replayed(index: dict[int, list[int]], start: np.ndarray, word: np.ndarray, made: dict[int, int]) -> array:
    """Symbols after all merges, -1 where a position was merged into one before it."""
    edge = word[1:] != word[:-1]
    symbols, places = array("i", start.astype(np.int32).tobytes()), np.arange(len(start), dtype=np.int32)
    after = array("i", np.where(np.r_[edge, True][: len(start)], -1, places + 1).astype(np.int32).tobytes())
    before = array("i", np.where(np.r_[True, edge][: len(start)], -1, places - 1).astype(np.int32).tobytes())
    ranks = list(index)
    heapify(ranks)
    get = made.get
    while ranks:
        rank = ranks[0]
        positions = index[rank]
        while positions:
            at = heappop(positions)
            right = after[at]
            if right < 0 or get(symbols[at] << 32 | symbols[right]) != rank:
                continue  # a merge has taken one of the two since
            after[at] = beyond = after[right]
            symbols[at], symbols[right], after[right] = rank, -1, -1
            if beyond >= 0:
                before[beyond] = at
                if (new := get(rank << 32 | symbols[beyond])) is not None:
                    if new in index:
                        heappush(index[new], at)
                    else:
                        index[new] = [at]
                        heappush(ranks, new)
            if (left := before[at]) >= 0 and (new := get(symbols[left] << 32 | rank)) is not None:
                if new in index:
                    heappush(index[new], left)
                else:
                    index[new] = [left]
                    heappush(ranks, new)
            if ranks[0] != rank:
                break  # a pair that goes first has come up
        else:
            heappop(ranks)
            del index[rank]
    return symbols


class Known(dict):
    """Words that were met, by number, and the ids of each; a new word gets the next number."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        number = self[word] = len(self)
        return number

    def take(self, replay: Replay) -> None:
        """Encode the words that came since the last call, ``WORDS`` at a time."""
        ids, starts = [self.ids], [self.starts]
        for at in range(0, len(self.fresh), WORDS):
            own, offsets = replay.encode([w.encode() for w in self.fresh[at : at + WORDS]])
            ids.append(own)
            starts.append(starts[-1][-1] + offsets[1:])
        self.ids, self.starts, self.fresh = np.concatenate(ids), np.concatenate(starts), []

    def ids_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by number, joined, and how many each has."""
        return spread(self.ids, self.starts[codes], self.starts[codes + 1] - self.starts[codes])


def spread(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``pool`` that begin at ``starts``, joined, and their sizes."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - ends + sizes, sizes) + np.arange(total)], sizes


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The content of a rank file: a token in base64 and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


_replays: dict[int, Replay] = {}


def _replay(content: bytes) -> Replay:
    key = hash(content)
    if key not in _replays:
        _replays.clear()
        _replays[key] = Replay(read_ranks(content))
    return _replays[key]


def _broadcast(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        content = f.read()
    if len(content) > MAX_VOCABULARY:
        raise ValueError(f"{path} is larger than what may be broadcast")
    return spark.sparkContext.broadcast(content)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, the token ids of ``text`` as array<int>, to every row; an input column of that name is replaced.

    ``vocabulary`` is a rank file that the driver can open; ``pattern`` splits a text into words, each of which is
    encoded separately, without special tokens. A null or empty text has no ids. A text of any length is encoded whole;
    a task holds 3 MB of texts or one longer text at a time. Repeated rows are kept and encoded alike.
    """
    content = _broadcast(docs.sparkSession, vocabulary)
    others = [c for c in docs.columns if c != ids]
    kept = docs.select(*[F.col(f"`{c}`") for c in others])
    at = others.index(text)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        replay, words_of = _replay(content.value), regex.compile(pattern).findall
        known, none = Known(), np.zeros(0, np.int32)
        for whole in rows:
            for batch in slices(whole, text, SLICE):
                if len(known) > KEPT_WORDS:
                    known = Known()
                found = [array("i", map(known.__getitem__, words_of(x))) if x else none for x in (v.as_py() for v in batch.column(at))]
                counts = np.fromiter(map(len, found), np.int64, len(found))
                codes = np.concatenate(found) if found else none
                known.take(replay)
                values, sizes = known.ids_of(codes)
                ends = np.zeros(len(codes) + 1, np.int64)
                np.cumsum(sizes, out=ends[1:])
                offsets = ends[np.r_[0, np.cumsum(counts)]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], [*others, ids])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Replace ``ids`` by ``out``'s bytes as binary beside it: the tokens of ``ids``, joined. Null ids are no bytes; unknown ids raise."""
    content = _broadcast(docs.sparkSession, vocabulary)
    others = [c for c in docs.columns if c != out]
    kept = docs.select(*[F.col(f"`{c}`") for c in others])
    at = others.index(ids)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _replay(content.value).tokens
        table = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        starts = np.zeros(len(table) + 1, np.int64)
        np.cumsum([len(x) for x in table], out=starts[1:])
        pool = np.frombuffer(b"".join(table), np.uint8)
        known = np.array([i in tokens for i in range(len(table))])
        for whole in rows:
            for batch in _by_ids(whole, at):
                lists = batch.column(at)
                offsets = list_offsets(lists)
                values = np.asarray(lists.flatten())
                if len(values) and (values.min() < 0 or values.max() >= len(table) or not known[values].all()):
                    raise ValueError("an id is not in the vocabulary")
                sizes = starts[values + 1] - starts[values]
                ends = np.zeros(len(values) + 1, np.int64)
                np.cumsum(sizes, out=ends[1:])
                data = pool[np.repeat(starts[values] - ends[:-1], sizes) + np.arange(ends[-1])]
                decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends[offsets].tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([*batch.columns, decoded.cast(pa.binary())], [*others, out])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())]))


def list_offsets(lists: pa.Array) -> np.ndarray:
    """Offsets of the rows into the flattened values; a null list is empty."""
    sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    out = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def _by_ids(batch: pa.RecordBatch, at: int, limit: int = IDS) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with at most ``limit`` ids, or one row."""
    off, start, n = list_offsets(batch.column(at)), 0, batch.num_rows
    while start < n:
        end = max(int(np.searchsorted(off, off[start] + limit, side="right")) - 1, start + 1)
        yield batch.slice(start, min(end, n) - start)
        start = end


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded and decoded again."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = encode(docs, vocabulary, public_tokenizers.PATTERN).select("doc_id", "ids")
    return decode(encoded, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

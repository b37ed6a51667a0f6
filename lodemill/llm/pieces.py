"""Encoding by a SentencePiece model of merge type, by backtracking, and decoding.

A text is cut wherever no piece of the vocabulary holds the two characters side by side, since no merge can cross there; what
lies between cuts is encoded once for each different string that a worker meets. An Aho-Corasick automaton gives the longest
piece at every position of these strings in one pass. From the left, the longest piece is tried that is compatible with the
piece before it: merging the characters of both anew has to give just these two. If none is, the position is marked in a
bitfield as failed, the piece before is given up, and the next shorter one takes its place. Each position fails at most
once, so the time grows with the length of a string, also of one of a million letters.

There is no shuffle; a lost task is run again.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Known, _broadcast, _by_ids, list_offsets
from .common import slices

#: The sign for a space, what an unknown id decodes to, and a code point that no text holds.
SPACE, UNKNOWN, APART = "▁", " ⁇ ", "\ud800"
#: Fixed values of the model file: fields, model type, kinds of pieces.
PIECES, TRAINER, NORMALIZER, MERGES = 1, 2, 3, 2
NORMAL, UNK, CONTROL, BYTE = 1, 2, 3, 6
#: Characters whose strings are encoded together; strings and answers about pairs of pieces that a worker keeps from task to task.
TOGETHER, KEPT_STRINGS, KEPT_PAIRS = 1 << 18, 250_000, 500_000
#: Bytes of text that are cut at a time.
SLICE = 1 << 20


def fields(content: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message: whole numbers, or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = content[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(content):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, content[at : at + size]
        at += size


class Pieces:
    """The pieces of a model: their names and kinds, all that decoding needs."""

    def __init__(self, content: bytes) -> None:
        messages = list(fields(content))
        trainer = dict(fields(b"".join(v for k, v in messages if k == TRAINER)))
        normalizer = dict(fields(b"".join(v for k, v in messages if k == NORMALIZER)))
        if trainer.get(3, 1) != MERGES or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("the model has to be of merge type, with bytes for unknown characters and spaces before words")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("the model must not change texts but for the signs of spaces")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.names, self.kinds, self.scores = [], [], []
        for message in (dict(fields(v)) for k, v in messages if k == PIECES):
            self.names.append(message[1].decode())
            self.scores.append(float(np.frombuffer(message.get(2, bytes(4)), np.float32)[0]))
            self.kinds.append(message.get(3, NORMAL))
        if set(self.kinds) - {NORMAL, UNK, CONTROL, BYTE}:
            raise ValueError("the model has pieces of its user, or unused ones")
        self.bytes = [i for i, kind in enumerate(self.kinds) if kind == BYTE]
        self.end = self.names.index("</s>")


class Merges(Pieces):
    """Encoding by the pieces of a model: merges of characters, with bytes for characters that have no piece."""

    def __init__(self, content: bytes) -> None:
        super().__init__(content)
        #: The order of merges: a piece's score, best first, as a whole number that ties share.
        place = {s: k for k, s in enumerate(sorted(set(self.scores), reverse=True))}
        self.order = {name: place[s] for name, s, kind in zip(self.names, self.scores, self.kinds, strict=True) if kind == NORMAL}
        self.ids = {name: i for i, (name, kind) in enumerate(zip(self.names, self.kinds, strict=True)) if kind == NORMAL}
        self._letters()
        self._reachable()
        self.pairs: dict[int, bool] = {}
        self.known = KnownStrings()

    def _letters(self) -> None:
        """Which two characters stand side by side in a piece; characters of pieces that are none themselves get ids past the end."""
        letters = sorted({c for name in self.ids for c in name})
        for c in letters:
            if c not in self.ids:
                self.ids[c] = len(self.names)
                self.names.append(c)
        number = {c: k + 1 for k, c in enumerate(letters)}
        self.letter = np.zeros(0x110000, np.uint16 if len(letters) < 65535 else np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        beside = {(number[a], number[b]) for name in self.order for a, b in zip(name, name[1:])}
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        if beside:
            self.beside[tuple(np.array(sorted(beside)).T)] = True

    def _reachable(self) -> None:
        """The automaton over the pieces that merging their own characters gives, and the next shorter piece at the front of each."""
        import ahocorasick

        reachable = []
        for name in self.ids:
            parts = self.merged(list(name), 2)
            if any(len(p) > 1 and self.order[p] > self.order[name] for p in parts if len(name) > 1 and len(parts) == 2):
                raise ValueError(f"{name!r} is merged before its parts")
            if self.merged(parts) == [name]:
                reachable.append(name)
        known = set(reachable)
        self.size, self.shorter = [0] * len(self.names), [-1] * len(self.names)
        self.automaton = ahocorasick.Automaton()
        for name in reachable:
            i = self.ids[name]
            self.size[i] = len(name)
            self.shorter[i] = next((self.ids[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in known), -1)
            self.automaton.add_word(name, i)
        self.automaton.make_automaton()

    def merged(self, parts: list[str], least: int = 1) -> list[str]:
        """Neighbours merged, the best pair first and the leftmost of equals, until no two make a piece or ``least`` are left."""
        order = self.order.get
        while len(parts) > least:
            best, at = min((order(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are when the characters of both are merged anew."""
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            a, b = self.names[left], self.names[right]
            known = self.pairs[pair] = self.merged(list(a + b)) == [a, b]
        return known

    def longest(self, text: str) -> array:
        """The longest piece that begins at each position, -1 where none does."""
        out, size = array("i", [-1]) * len(text), self.size
        for last, piece in self.automaton.iter(text):  # by ascending ends, so that longer ones come later
            out[last + 1 - size[piece]] = piece
        return out

    def tokens(self, longest: array, start: int, stop: int, failed: bytearray) -> list[int]:
        """The pieces of the string from ``start`` to ``stop``; ``failed`` has a bit for each position from which no end was reached."""
        size, shorter, out, at = self.size, self.shorter, [], start
        piece = longest[at]
        while at < stop:
            before = out[-1] if out else -1
            while piece >= 0:
                end = at + size[piece]
                if not failed[end >> 3] >> (end & 7) & 1 and (before < 0 or self.compatible(before, piece)):
                    break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at += size[piece]
                piece = longest[at] if at < stop else -1
            elif before >= 0:
                failed[at >> 3] |= 1 << (at & 7)
                piece = shorter[out.pop()]
                at -= size[before]
            else:
                raise ValueError("the order of the vocabulary's merges is not one that pieces can be checked by")
        return out

    def encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings, one after another, and where each string's begin. A string lies between two cuts."""
        values, counts, held, length = array("i"), [], [], 0
        for k, s in enumerate(strings):
            held.append(s)
            length += len(s) + 1
            if length >= TOGETHER or k + 1 == len(strings):
                text, at = APART.join(held), 0
                longest, failed = self.longest(text), bytearray(len(text) // 8 + 1)
                for x in held:
                    ids = self._whole(x) if len(x) < 2 else self.tokens(longest, at, at + len(x), failed)
                    if ids and max(ids) >= len(self.kinds):
                        ids = [i for t in ids for i in ([t] if t < len(self.kinds) else self._bytes(self.names[t]))]
                    values.extend(ids)
                    counts.append(len(ids))
                    at += len(x) + 1
                held, length = [], 0
        offsets = np.zeros(len(strings) + 1, np.int64)
        np.cumsum(counts, out=offsets[1:])
        return np.frombuffer(values, np.int32) if values else np.zeros(0, np.int32), offsets

    def _bytes(self, text: str) -> list[int]:
        return [self.bytes[b] for b in text.encode()]

    def _whole(self, text: str) -> list[int]:
        """Of a string of one character or none."""
        return [self.ids[text]] if text in self.ids else self._bytes(text)

    def cut(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """All texts, with the signs of spaces, cut where no merge can cross, and how many strings each gives: an empty text gives an empty string."""
        first = SPACE if self.dummy_prefix else ""
        held = [first + t.replace(" ", SPACE) if t else "" for t in texts]
        mark = chr(0x10FFFF)
        while any(mark in t for t in held):  # any that no text holds
            mark = chr(ord(mark) - 1)
        points = np.frombuffer(mark.join(held).encode("utf-32-le"), np.uint32)
        letters, apart = self.letter[points], points == ord(mark)
        cuts = np.flatnonzero(~(self.beside[letters[:-1], letters[1:]] | apart[:-1] | apart[1:])) + 1
        text_of = np.r_[0, np.cumsum(apart)]
        counts = 1 + np.bincount(text_of[cuts], minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        return np.insert(points, cuts, ord(mark)).tobytes().decode("utf-32-le").split(mark), counts


class KnownStrings(Known):
    """Strings between cuts that a worker has met. If a task is broken off between two lines, what it left half done is done again or thrown away with the worker."""

    def take(self, pieces: Merges) -> None:
        ids, offsets = pieces.encode(self.fresh)
        self.ids, self.starts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, self.starts[-1] + offsets[1:]])
        self.fresh = []


_models: dict[tuple[str, int], Pieces] = {}


def _model(content: bytes, kind: type[Pieces]) -> Pieces:
    """A model, read once by each worker."""
    key = kind.__name__, hash(content)
    if key not in _models:
        _models.clear()
        _models[key] = kind(content)
    return _models[key]


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", end: bool = True) -> DataFrame:
    """Add ``ids``, the piece ids of ``text`` as array<int>, to every row, with the end id last if ``end``; an input column of that name is replaced.

    ``model`` is a file that the driver can open: of merge type, with byte pieces and no normalisation but for spaces; other
    models raise. A null or empty text has the end id alone. A text of any length is encoded whole; a task holds 1 MB of
    texts or one longer text at a time, and 250 000 different strings. Repeated rows are kept and encoded alike.
    """
    content = _broadcast(docs.sparkSession, model)
    others = [c for c in docs.columns if c != ids]
    kept = docs.select(*[F.col(f"`{c}`") for c in others])
    at = others.index(text)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(content.value, Merges)
        for whole in rows:
            for batch in slices(whole, text, SLICE):
                if len(pieces.known) > KEPT_STRINGS:
                    pieces.known = KnownStrings()
                known = pieces.known
                strings, counts = pieces.cut(batch.column(at).to_pylist())
                codes = np.fromiter(map(known.__getitem__, strings), np.int64, len(strings))
                known.take(pieces)
                values, sizes = known.ids_of(codes)
                ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]]
                if end:
                    values, ends = np.insert(values, ends[1:], pieces.end), ends + np.arange(len(ends))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))], [*others, ids])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the text of ``ids``; an input column of that name is replaced.

    Signs of spaces become spaces, but for the one before the first word; byte pieces are read as UTF-8, a byte that is none
    as U+FFFD; control ids give nothing. Null ids are an empty text; ids that are not in the vocabulary raise.
    """
    content = _broadcast(docs.sparkSession, model)
    others = [c for c in docs.columns if c != out]
    kept = docs.select(*[F.col(f"`{c}`") for c in others])
    at = others.index(ids)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = Surface(_model(content.value, Pieces))
        for whole in rows:
            for batch in _by_ids(whole, at):
                yield pa.RecordBatch.from_arrays([*batch.columns, surface.texts(batch.column(at))], [*others, out])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())]))


class Surface:
    """What ids decode to."""

    def __init__(self, pieces: Pieces) -> None:
        n = len(pieces.kinds)
        self.kinds = np.array(pieces.kinds)
        table = [name.replace(SPACE, " ").encode() for name in pieces.names[:n]]
        for i in range(n):
            if self.kinds[i] == CONTROL:
                table[i] = b""
            elif self.kinds[i] == UNK:
                table[i] = UNKNOWN.encode()
        for byte, i in enumerate(pieces.bytes):
            table[i] = bytes([byte])
        self.table, self.sizes = table, np.array([len(x) for x in table])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(table), np.uint8)
        #: Pieces whose first space goes at the start of a text.
        self.spaced = np.array([pieces.dummy_prefix and kind == NORMAL and name.startswith(SPACE) for name, kind in zip(pieces.names[:n], pieces.kinds, strict=True)])

    def texts(self, lists: pa.Array) -> pa.Array:
        """The text of each list of ids."""
        offsets, values = list_offsets(lists), np.asarray(lists.flatten())
        if len(values) and (values.min() < 0 or values.max() >= len(self.table)):
            raise ValueError("an id is not in the vocabulary")
        rows = np.repeat(np.arange(len(lists)), np.diff(offsets))
        said = np.flatnonzero(self.kinds[values] != CONTROL)
        first = said[np.r_[True, rows[said][1:] != rows[said][:-1]][: len(said)]]  # of each row, the first that says something
        skip = np.zeros(len(values), np.int64)
        skip[first] = self.spaced[values[first]]
        sizes = self.sizes[values] - skip
        ends = np.r_[0, np.cumsum(sizes)]
        data = self.pool[np.repeat(self.starts[values] + skip - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        bounds = ends[offsets]
        try:
            data.decode()
            sure = not len(data) or not self._torn(values, rows) and not any(data[b] & 0xC0 == 0x80 for b in bounds[:-1].tolist() if b < len(data))
        except UnicodeDecodeError:
            sure = False
        if sure:
            return pa.StringArray.from_buffers(len(lists), pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data))
        return pa.array([self._by_runs(values[a:b], skip[a:b]) for a, b in zip(offsets, offsets[1:])], pa.string())

    def _torn(self, values: np.ndarray, rows: np.ndarray) -> bool:
        """Whether a control id stands before a byte piece, within a row: it ends the bytes before it."""
        kinds = self.kinds[values]
        return bool(((kinds[:-1] == CONTROL) & (kinds[1:] == BYTE) & (rows[:-1] == rows[1:])).any())

    def _by_runs(self, values: np.ndarray, skip: np.ndarray) -> str:
        """The text of one list, run of byte pieces by run."""
        out, run = [], b""
        for i, s in zip(values.tolist(), skip.tolist(), strict=True):
            if self.kinds[i] == BYTE:
                run += self.table[i]
                continue
            out += [_lenient(run), self.table[i][s:].decode()]
            run = b""
        return "".join([*out, _lenient(run)])


def _lenient(data: bytes) -> str:
    """UTF-8, with U+FFFD for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(data):
        for size in range(1, 5):
            try:
                out.append(data[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            size = 1
        at += size
    return "".join(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded with an end id and decoded again."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decode(encode(docs, model).select("doc_id", "ids"), model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests.

A sketch has three tables of cells; a digest is counted into one cell of each. Two sketches of equal size subtract cell
by cell, what both documents hold falls away, and peeling the cells that hold one digest recovers those in which the
documents differ. A fingerprint holds sketches of 12, 48, 192, ... cells, as far as the text's paragraphs ask for, and a
last one that is large enough to be peeled alone. Two fingerprints are compared by their smallest sketches; where peeling
gets stuck, the next larger ones are subtracted; where one of the two has none left, the last ones are peeled, each alone,
and the digests themselves are held against each other. So the likeness of two documents follows from their fingerprints.
All documents of an Arrow batch are sketched, subtracted and peeled together in numpy.
"""

from __future__ import annotations

import re
from binascii import a2b_base64, b2a_base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import identified, mix64, slices

#: Cells of a fingerprint's smallest sketch, in three tables, how many times as many the next one has, and the cells of
#: the last one for each paragraph.
CELLS, TABLES, MORE, OWN = 12, 3, 4, 1.5
#: Words after which a paragraph without sentence ends is cut, on average, by a word's hash.
LONG = 16
#: Bytes of a range of documents, and the documents from which the ranges are cut: so many at least, and so many for each range.
RANGE, SAMPLE, SAMPLE_OF_RANGE = 64 << 20, 50_000, 4
#: A cell: how many digests, the digests' sum and the checks' sum (by exclusive or); and the fourteen bytes that are written
#: of it: the count modulo 2**16, a digest of 64 bits, a check of 32.
CELL = np.dtype([("count", "<i4"), ("keys", "<u8"), ("checks", "<u4")])
WRITTEN = [0, 1, *range(4, 16)]
#: Bytes of text that a task sketches at a time.
SLICE = 4 << 20
#: Ends of a paragraph: a line's end, or a sentence's.
ENDS = re.compile(r"[^\n.!?。！？]*(?:\n+|[.!?。！？]+\s*|$)")


def paragraphs(text: str) -> list[str]:
    """The pieces of a text, which joined give the text: sentences and lines; long ones are cut after words by hash."""
    from xxhash import xxh32_intdigest

    out = []
    for piece in ENDS.findall(text):
        if not piece:
            continue
        if piece.count(" ") < 2 * LONG and len(piece) < 64 * LONG:
            out.append(piece)
            continue
        start = 0
        for m in re.finditer(r"\S+\s*|\s+", piece):
            for k in range(m.start() + 512, m.end(), 512):  # a word without end
                out.append(piece[start:k])
                start = k
            if xxh32_intdigest(m[0].encode()) % LONG == 0:
                out.append(piece[start : m.end()])
                start = m.end()
        if start < len(piece):
            out.append(piece[start:])
    return out


def digests(text: str) -> np.ndarray:
    """A digest of 64 bits of each paragraph and its number among equal ones, so that repeats count."""
    from xxhash import xxh64_intdigest

    x = np.array([xxh64_intdigest(p.encode()) for p in paragraphs(text)], np.uint64)
    if len(x) > 1:
        order = np.argsort(x, kind="stable")
        new = np.r_[True, x[order][1:] != x[order][:-1]]
        place = np.arange(len(x))
        number = np.empty(len(x), np.uint64)
        number[order] = place - np.maximum.accumulate(np.where(new, place, 0))
        with np.errstate(over="ignore"):
            x = mix64(x + number * np.uint64(0x9E3779B97F4A7C15))
    return x


def check_of(keys: np.ndarray) -> np.ndarray:
    return mix64(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)


class Sketches:
    """Sketches of several documents, document i with ``cells[i]`` cells (a multiple of TABLES)."""

    def __init__(self, cells: np.ndarray, sums: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
        self.cells, self.start = cells, np.cumsum(cells) - cells
        n = int(cells.sum())
        self.count, self.keys, self.checks = sums or (np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64))

    def places(self, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The cells of each digest, a row for each table."""
        width = (self.cells[owner] // TABLES).astype(np.uint64)
        with np.errstate(over="ignore"):
            return np.stack([self.start[owner] + k * width.astype(np.int64) + (mix64(keys + np.uint64(k + 1)) % width).astype(np.int64) for k in range(TABLES)])

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray | int) -> Sketches:
        check, sign = check_of(keys), np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        for at in self.places(keys, owner):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, check)
        return self

    def part(self, which: np.ndarray) -> Sketches:
        """The sketches of some documents."""
        n = self.cells[which]
        ends = np.cumsum(n)
        at = np.repeat(self.start[which] - ends + n, n) + np.arange(int(n.sum()))
        return Sketches(n, (self.count[at], self.keys[at], self.checks[at]))

    def minus(self, other: Sketches) -> Sketches:
        """Sketches of equal sizes, subtracted."""
        return Sketches(self.cells, (self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks))

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests that were recovered, their documents, and for each document whether its sketch came out empty. The sums are used up.

        A cell holds one digest if its count is one of either sign, the check is the digest's, and the cell is one of the
        digest's own: a sum of several passes for one with a chance of 3 in 2**32 times the cells of the sketch. A digest that
        is taken out and put back later was none; one that would have to be taken out twice breaks the sketch. A document is
        given up after four digests for each of its cells, whatever the others of the batch need.
        """
        n = len(self.cells)
        owner_of = np.repeat(np.arange(n), self.cells)
        found, owners, signs, left = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 4 * self.cells
        look = np.arange(len(self.count))
        while len(look):
            look = look[np.abs(self.count[look]) == 1]
            look = look[check_of(self.keys[look]) == self.checks[look]]
            look = look[left[owner_of[look]] > 0]
            look = look[(self.places(self.keys[look], owner_of[look]) == look).any(axis=0)]
            owner, keys = owner_of[look], self.keys[look]
            order = np.lexsort((keys, owner))
            look, owner, keys = look[order], owner[order], keys[order]
            new = np.ones(len(look), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
            look, owner, keys = look[new], owner[new], keys[new]
            sign = self.count[look]
            found.append(keys)
            owners.append(owner)
            signs.append(sign)
            left = left - np.bincount(owner, minlength=n)
            self.add(keys, owner, -sign)
            look = np.unique(self.places(keys, owner))
        keys, owner, sign = np.concatenate(found), np.concatenate(owners), np.concatenate(signs)
        order = np.lexsort((keys, owner))
        keys, owner, sign = keys[order], owner[order], sign[order]
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])][: len(keys)])
        times = np.add.reduceat(sign, first) if len(first) else sign
        keys, owner = keys[first], owner[first]
        whole = np.bincount(owner_of[(self.count != 0) | (self.keys != 0) | (self.checks != 0)], minlength=n) == 0
        whole[owner[np.abs(times) > 1]] = False
        return keys[times != 0], owner[times != 0], whole

    def written(self) -> np.ndarray:
        """The fourteen bytes of each cell."""
        cells = np.zeros(len(self.count), CELL)
        cells["count"], cells["keys"], cells["checks"] = self.count, self.keys, self.checks
        return np.ascontiguousarray(cells.view(np.uint8).reshape(-1, CELL.itemsize)[:, WRITTEN])

    @classmethod
    def read(cls, written: list[np.ndarray]) -> Sketches:
        cells = np.zeros((sum(map(len, written)), CELL.itemsize), np.uint8)
        cells[:, WRITTEN] = np.concatenate([*written, np.zeros((0, len(WRITTEN)), np.uint8)])
        cells = cells.view(CELL).ravel()
        sums = (cells["count"] & 0xFFFF).astype(np.uint16).astype(np.int16).astype(np.int64), cells["keys"].astype(np.uint64), cells["checks"].astype(np.uint64)
        return cls(np.array([len(x) for x in written], np.int64), sums)


class Fingerprints:
    """Fingerprints of several documents: the numbers of their paragraphs; their sketches of each size, with each document's
    place among them (-1 if it has none of that size); and the last ones."""

    def __init__(self, sizes: np.ndarray, levels: list[tuple[Sketches, np.ndarray]], last: Sketches) -> None:
        self.sizes, self.levels, self.last = sizes, levels, last

    @classmethod
    def of(cls, documents: list[np.ndarray]) -> Fingerprints:
        """From the digests of each document."""
        sizes = np.array([len(x) for x in documents], np.int64)
        keys = np.concatenate([*documents, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(documents)), sizes)
        levels, cells = [], CELLS
        while (has := sizes * OWN > cells).any():
            place = np.where(has, np.cumsum(has) - 1, -1)
            mine = has[owner]
            levels.append((Sketches(np.full(int(has.sum()), cells, np.int64)).add(keys[mine], place[owner[mine]], 1), place))
            cells *= MORE
        room = np.where(sizes > 0, -(-np.maximum(sizes * OWN, CELLS).astype(np.int64) // TABLES) * TABLES, 0)
        while True:  # until each can be peeled alone
            last = Sketches(room).add(keys, owner, 1)
            whole = Sketches(room, (last.count.copy(), last.keys.copy(), last.checks.copy())).peel()[2]
            if whole.all():
                return cls(sizes, levels, last)
            room = np.where(whole, room, 2 * room)

    def part(self, which: np.ndarray) -> Fingerprints:
        levels = []
        for sketches, place in self.levels:
            own = place[which]
            levels.append((sketches.part(own[own >= 0]), np.where(own >= 0, np.cumsum(own >= 0) - 1, -1)))
        return Fingerprints(self.sizes[which], levels, self.last.part(which))

    def written(self) -> list[str]:
        """Each as a string: the number of paragraphs, then each sketch's cells in base 64, smallest first."""
        out = [[f"{n:x}"] for n in self.sizes.tolist()]
        for sketches, place in [*self.levels, (self.last, np.arange(len(self.sizes)))]:
            data = sketches.written().tobytes()
            for i in np.flatnonzero(place >= 0).tolist():
                a, n = int(sketches.start[place[i]]), int(sketches.cells[place[i]])
                out[i].append(b2a_base64(data[a * len(WRITTEN) : (a + n) * len(WRITTEN)], newline=False).decode())
        return [":".join(x) for x in out]

    @classmethod
    def read(cls, written: list[str]) -> Fingerprints:
        """What ``written`` gave."""
        split = [x.split(":") for x in written]
        sizes = np.array([int(x[0], 16) for x in split], np.int64)

        def tables(parts: list[str]) -> Sketches:
            return Sketches.read([np.frombuffer(a2b_base64(x), np.uint8).reshape(-1, len(WRITTEN)) for x in parts])

        levels = []
        for k in range(1, max(map(len, split), default=2) - 1):
            has = np.array([len(x) > k + 1 for x in split])
            levels.append((tables([x[k] for x in split if len(x) > k + 1]), np.where(has, np.cumsum(has) - 1, -1)))
        return cls(sizes, levels, tables([x[-1] for x in split]))


def differences(a: Fingerprints, b: Fingerprints) -> np.ndarray:
    """How many digests are in one of a[i] and b[i] only."""
    out, todo = np.zeros(len(a.sizes), np.int64), np.arange(len(a.sizes))
    for (x, at), (y, to) in zip(a.levels, b.levels, strict=False):
        both = todo[(at[todo] >= 0) & (to[todo] >= 0)]
        _, owner, whole = x.part(at[both]).minus(y.part(to[both])).peel()
        out[both[whole]] = np.bincount(owner, minlength=len(both))[whole]
        todo = np.setdiff1d(todo, both[whole], assume_unique=True)
    sides = [f.last.part(todo).peel()[:2] for f in (a, b)]
    # every digest of a document once; those that are in both documents come up twice
    pairs = np.concatenate([np.stack([owner.astype(np.uint64), keys], axis=1) for keys, owner in sides])
    found, often = np.unique(pairs, axis=0, return_counts=True)
    out[todo] = np.bincount(found[often == 1, 0].astype(np.int64), minlength=len(todo))
    return out


def likeness(a: Fingerprints, b: Fingerprints) -> np.ndarray:
    """Shared paragraphs over all paragraphs of two documents; 1 for two without any."""
    apart, both = differences(a, b), a.sizes + b.sizes
    union = (both + apart) / 2
    return np.where(both == 0, 1.0, (union - apart) / np.maximum(union, 0.5))


def likeness_of(a: str, b: str) -> float:
    """The likeness of two documents, from their fingerprints as they are stored."""
    return float(likeness(Fingerprints.read([a]), Fingerprints.read([b]))[0])


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``part``, ``id``, ``key``, ``text``, ``own``: documents dealt by ranges in the order of their keys; every range also has
    the first document of the next (the last range that of the first), with ``own`` false.

    Ranges are of nearly equal bytes, cut by a sample of four documents for each ``RANGE`` bytes of text or 50 000. The
    sample, 16 bytes for each of its documents, is what reaches the driver; the ranges' bounds and first documents go out to
    the tasks.
    """
    spark = docs.sparkSession
    table = identified(docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")), "key", "text", "id")
    count, n_bytes = table.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (n_bytes or 0) // RANGE, 1)
    sampled = table.where(F.pmod(F.xxhash64("id"), F.lit(max(1, count // max(SAMPLE, SAMPLE_OF_RANGE * n)))) == 0).groupBy("id").agg(F.sum(F.octet_length("text") + 64).alias("size")).orderBy("id").toArrow()
    ids, size = sampled.column("id").to_numpy(), np.cumsum(sampled.column("size").to_numpy())
    bounds = np.unique(ids[np.searchsorted(size, size[-1] * np.arange(1, n) / n)]) if len(ids) else np.zeros(0, np.int64)

    def heads(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            own = np.sort(np.asarray(batch.column(0)))
            part = np.searchsorted(bounds, own, "right")
            first = np.r_[True, part[1:] != part[:-1]][: len(part)]
            yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(own[first])], ["part", "id"])

    found = table.select("id").mapInArrow(heads, "part long, id long").groupBy("part").agg(F.min("id").alias("id")).orderBy("part").toArrow()
    parts, first = found.column("part").to_numpy(), found.column("id").to_numpy()
    before = np.roll(parts, 1)
    at = table.columns.index("id")

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            own = np.asarray(batch.column(at))
            part = np.searchsorted(bounds, own, "right")
            place = np.searchsorted(parts, part)
            for to, which, mine in ((part, slice(None), True), (before[place], own == first[place], False)):
                x = batch if mine else batch.filter(pa.array(which))
                if x.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(to[which].astype(np.int32)), x.column("id"), x.column("key"), x.column("text"), pa.array(np.full(x.num_rows, mine))], ["part", "id", "key", "text", "own"])

    kept = table.schema["key"].dataType.simpleString()
    dealt = table.mapInArrow(deal, f"part int, id long, key {kept}, text string, own boolean")
    return dealt.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", F.col("own").desc(), "id")


SKETCHED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited text of a document has its last quarter of code points (rounded down) replaced by as many from the start
    of the next document's text, or all of it if it has fewer. Next is the next key in ascending order, after the last
    the first; rows of one key follow each other by a hash of the text, null keys come first. Keys may be of any type that
    can be ordered. A null text is empty. The only document is its own next. Likeness is shared over all paragraphs, from
    the two fingerprints alone, 1 for two empty texts. Texts are taken whole, 4 MB or one text at a time. Other columns are
    ignored. An empty table gives an empty result.
    """
    dealt = with_next(docs, key, text)
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    key_type = pa.schema(dealt.select("key").limit(0).toArrow().schema).field(0).type

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, texts = None, [], []  # the last document waits for its next

        def close(part_ends: bool, head: str | None) -> pa.RecordBatch | None:
            nonlocal keys, texts
            following = [*texts, head] if part_ends else texts
            n = len(following) - 1
            if n <= 0:
                return None
            out = pa.RecordBatch.from_arrays([pa.array(keys[:n], key_type), *_sketched(following)], names)
            keys, texts = keys[n:], texts[n:]
            return out

        for batch in rows:
            for piece in slices(batch, "text", SLICE):
                for p, _, k, x, own in zip(*(piece.column(i).to_pylist() for i in range(5)), strict=True):
                    if own:
                        part = p
                        keys.append(k)
                        texts.append(x)
                    elif part == p and (out := close(True, x)):
                        yield out
                if len(texts) > 1 and (out := close(False, None)):
                    yield out

    return dealt.mapInArrow(run, f"key {dealt.schema['key'].dataType.simpleString()}, {SKETCHED}").withColumnRenamed("key", key)


def _sketched(texts: list[str]) -> list[pa.Array]:
    """Columns for all texts but the last, each with the one after it."""
    from hashlib import sha256

    n = len(texts) - 1
    edited = [x[: len(x) - len(x) // 4] + y[: len(x) // 4] for x, y in zip(texts[:n], texts[1:], strict=True)]
    both = Fingerprints.of([digests(x) for x in texts])
    own, following, new = both.part(np.arange(n)), both.part(np.arange(1, n + 1)), Fingerprints.of([digests(x) for x in edited])
    return [
        pa.array([len(x) for x in texts[:n]], pa.int64()),
        pa.array([sha256(x.encode()).hexdigest() for x in edited]),
        pa.array(own.written()),
        pa.array(new.written()),
        pa.array(likeness(own, new)),
        pa.array(likeness(own, following)),
    ]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch, its edited text's, and how like they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return compare_versions(docs)

"""Removal of repeated byte strings, by a suffix sort that compares polynomial prefix hashes and verifies what they say.

Every window of ``LENGTH`` bytes is assigned to the least hash among the shorter strings that it holds (its anchor), so
equal windows anywhere in the corpus have equal anchors, and neighbouring windows mostly share one: a *run*. Runs, not
windows, are shuffled, by anchor. Where runs of different content meet at an anchor, the bytes of the earliest of each
content are fetched, and their windows are suffix-sorted: a merge sort whose comparisons find the common extension of two
suffixes by binary search over prefix hashes. Neighbours in the sorted order are then compared byte by byte, which proves
the order, whatever the hashes said; a group that is out of order is told apart by its bytes.

Runs whose contents have equal hashes are repeats of the earliest. No byte is removed on a hash's word: within a map task
they are compared there, across tasks each run is held against the one before it, byte by byte, and runs that follow
each other in both documents are fetched as one stretch. If any two differ, a hash has lied, and all is done again under
another random base, the third time without this shortcut.

Anchors that a large part of the corpus shares are thinned where they arise: each map task sends one run of each content.
What is left of an anchor with more than ``HOT`` contents is dealt over ``PARTS`` buckets by the windows' distance to the
anchor, since windows at different distances are never equal. Every shuffle is dealt by a hash of the anchor or of the
document, into as many buckets as the corpus' bytes ask for. Texts are shuffled as compressed blocks.
"""

from __future__ import annotations

import secrets
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE_A, BASE_B, identified, inverse, materialize, mix64, partitions_for, powers, prefix_hash, slices, string_bytes

#: Bytes of a window, and of the strings of which the least hash is its anchor; WINDOW of them start in a window.
LENGTH, WINDOW = 100, 64
GRAM = LENGTH - WINDOW + 1
#: Bytes of text that are hashed at a time, runs that are dealt at a time, bytes of text for each bucket.
SLICE, DEALT, BUCKET = 4 << 20, 600_000, 24 << 20
#: Contents of an anchor beyond which its windows are dealt over PARTS buckets; bytes that are gathered before they are sent.
HOT, PARTS, GATHERED = 2_000, 8, 16 << 20
#: A longer text is cut into overlapping segments, so that positions fit beside a hash.
SEGMENT = 8 << 20

RUN = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("key", "<i8"), ("lo", "<i4"), ("n", "u1"), ("at", "u1")])
SPAN = np.dtype([("key", "<i8"), ("lo", "<i4"), ("hi", "<i4")])
#: Two runs of equal hashes, by document and place; ``size`` counts windows, and bytes once the rows are stretches.
PAIR = np.dtype([("key", "<i8"), ("lo", "<i4"), ("other", "<i8"), ("at", "<i4"), ("size", "<i4")])
STRETCH = np.dtype([*PAIR.descr, ("side", "u1")])
#: Kinds of rows. Within a bucket what is asked for or covered comes before the texts.
RUNS, SPANS, ASKED, SPLIT, FIRST, SECOND, TEXTS, BODIES, STRETCHES, LIE = range(10)


def pack(rows: np.ndarray) -> bytes:
    """Rows column by column, differences of keys, compressed."""
    parts = []
    for name in rows.dtype.names:
        column = rows[name]
        if name == "key":
            column = np.diff(column, prepend=np.zeros(1, column.dtype))
        parts.append(np.ascontiguousarray(column).tobytes())
    return struct.pack("<q", len(rows)) + bytes(pa.compress(b"".join(parts), "zstd", asbytes=True))


def unpack(blob: bytes, dtype: np.dtype) -> np.ndarray:
    n = struct.unpack_from("<q", blob)[0]
    data = pa.decompress(blob[8:], n * dtype.itemsize, "zstd", asbytes=True)
    out, at = np.zeros(n, dtype), 0
    for name in dtype.names:
        kind = dtype[name]
        column = np.frombuffer(data, kind, n, at)
        out[name] = np.cumsum(column) if name == "key" else column
        at += n * kind.itemsize
    return out


def by_bucket(rows: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packed rows of each bucket, in the order they have."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(rows)] if len(rows) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[a]), pack(rows[a:b])


def bucket_of(values: np.ndarray, n: int, salt: int) -> np.ndarray:
    return (mix64(values.view(np.uint64) + np.uint64(salt)) % np.uint64(n)).astype(np.int64)


def runs_of(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, base: np.uint64 = BASE_B) -> tuple[np.ndarray, np.ndarray]:
    """The runs of texts that lie one after another in ``data``, and where in it each begins."""
    parts, places = [], []
    whole: list[tuple[int, int, int, int]] = []  # key, start of the document, segment

    def take() -> None:
        if whole:
            a, b = whole[0][2], whole[-1][3]
            runs, lo = _runs(data[a:b], [(k, d - a, s - a, e - a) for k, d, s, e in whole], base)
            parts.append(runs)
            places.append(lo + a)
            whole.clear()

    for k, a, b in zip(keys.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a > SEGMENT:
            take()
            for s in range(a, b - LENGTH + 1, SEGMENT - LENGTH + 1):
                whole.append((k, a, s, min(s + SEGMENT, b)))
                take()
        elif b - a >= LENGTH:
            if whole and b - whole[0][2] > SEGMENT:
                take()
            whole.append((k, a, a, b))
    take()
    return (np.concatenate(parts), np.concatenate(places)) if parts else (np.zeros(0, RUN), np.zeros(0, np.int64))


def _runs(data: np.ndarray, segments: list[tuple[int, int, int, int]], base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        n = len(data)
        ha, hb = prefix_hash(data, BASE_A), prefix_hash(data, base)
        gram = mix64((ha[GRAM:] - ha[: n + 1 - GRAM]) * powers(inverse(BASE_A), n + 1 - GRAM))
        least = (gram & ~np.uint64((1 << 24) - 1)) | np.arange(len(gram), dtype=np.uint64)
        for k in range(6):
            least = np.minimum(least[: -(1 << k)], least[1 << k :])
        keys, docs, starts, ends = (np.array(x, np.int64) for x in zip(*segments, strict=True))
        begins = np.ones(len(least), bool)
        begins[1:] = least[1:] != least[:-1]
        inside = np.zeros(len(least) + 1, np.int8)
        np.add.at(inside, starts, 1)
        np.add.at(inside, np.minimum(ends - LENGTH + 1, len(least)), -1)
        inside = np.cumsum(inside[:-1]).astype(bool)
        begins[starts] = True
        lo = np.flatnonzero(begins & inside)
        segment = np.searchsorted(starts, lo, side="right") - 1
        hi = np.minimum(np.r_[lo[1:], len(least)], ends[segment] - LENGTH + 1)
        out = np.zeros(len(lo), RUN)
        at = (least[lo] & np.uint64((1 << 24) - 1)).astype(np.int64)
        out["anchor"], out["key"], out["lo"], out["n"], out["at"] = gram[at], keys[segment], lo - docs[segment], hi - lo, at - lo
        span = (hb[hi + LENGTH - 1] - hb[lo]) * powers(inverse(base), n + 1)[lo]
        out["content"] = mix64(span + (hi - lo).astype(np.uint64))
        return out, lo


def sorted_runs(runs: np.ndarray, merge: bool) -> tuple[np.ndarray, np.ndarray]:
    """The order by anchor, content and place, and whether a row is the first of its content there; all are, unless ``merge``."""
    order = np.lexsort((runs["lo"], runs["key"], runs["content"], runs["anchor"]))
    runs = runs[order]
    first = np.ones(len(runs), bool)
    if merge:
        first[1:] = (runs["anchor"][1:] != runs["anchor"][:-1]) | (runs["content"][1:] != runs["content"][:-1])
    return order, first


def same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ``sizes`` bytes (8 or more) from x on equal those from y on; by words of eight bytes."""
    words = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    out = words[x + sizes - 8] == words[y + sizes - 8]
    for k in range(0, int(sizes.max(initial=0)) - 8, 8):
        more = np.flatnonzero(sizes > k + 8)
        out[more] &= words[x[more] + k] == words[y[more] + k]
    return out


def split_by_distance(runs: np.ndarray) -> np.ndarray:
    """Runs cut where the distance of their windows to the anchor passes from one of PARTS ranges to the next."""
    at, n, width = runs["at"].astype(np.int64), runs["n"].astype(np.int64), WINDOW // PARTS
    parts = []
    for k in range(PARTS):
        a, b = np.maximum(at - (k + 1) * width + 1, 0), np.minimum(at - k * width + 1, n)
        own = b > a
        part = runs[own].copy()
        part["lo"], part["n"], part["at"] = part["lo"] + a[own], (b - a)[own], (at - a)[own]
        parts.append(part)
    return np.concatenate(parts)


def stretches(pairs: np.ndarray, side: int) -> np.ndarray:
    """Pairs of runs that follow each other in both documents as one; ``size`` is then in bytes. Alike for either side."""
    out = np.zeros(len(pairs), STRETCH)
    for name in PAIR.names:
        out[name] = pairs[name]
    out["side"] = side
    shift = out["at"].astype(np.int64) - out["lo"]
    order = np.lexsort((out["lo"], shift, out["other"], out["key"]))
    out, shift = out[order], shift[order]
    ends = out["lo"] + out["size"]
    new = np.ones(len(out), bool)
    new[1:] = (out["key"][1:] != out["key"][:-1]) | (out["other"][1:] != out["other"][:-1]) | (shift[1:] != shift[:-1]) | (out["lo"][1:] > ends[:-1])
    if len(out):
        last = np.r_[np.flatnonzero(new)[1:] - 1, len(out) - 1]
        out = out[new].copy()
        out["size"] = ends[last] - out["lo"] + (LENGTH - 1)
    return out


def spans_of(runs: np.ndarray) -> np.ndarray:
    """What runs cover."""
    out = np.zeros(len(runs), SPAN)
    out["key"], out["lo"], out["hi"] = runs["key"], runs["lo"], runs["lo"] + runs["n"] + (LENGTH - 1)
    return out


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching spans of a document as one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["lo"], spans["key"]))]
    new = np.ones(len(spans), bool)
    document = np.cumsum(np.r_[True, spans["key"][1:] != spans["key"][:-1]])
    reach = np.maximum.accumulate(spans["hi"] + document * (1 << 32)) - document * (1 << 32)
    new[1:] = (document[1:] != document[:-1]) | (spans["lo"][1:] > reach[:-1])
    out = spans[new].copy()
    out["hi"] = reach[np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]]
    return out


class Suffixes:
    """Suffixes of a byte string, compared up to ``LENGTH`` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        self.hash = prefix_hash(data, BASE_A)
        self.back = powers(inverse(BASE_A), len(data) + 1)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many bytes two suffixes have in common, LENGTH at most, by binary search."""
        with np.errstate(over="ignore"):
            low, high = np.zeros(len(x), np.int64), np.full(len(x), LENGTH, np.int64)
            hx, hy, bx, by = self.hash[x], self.hash[y], self.back[x], self.back[y]
            for _ in range(LENGTH.bit_length()):
                middle = (low + high + 1) >> 1
                same = (self.hash[x + middle] - hx) * bx == (self.hash[y + middle] - hy) * by
                low = np.where(same, middle, low)
                high = np.where(same, high, middle - 1)
            return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before y; equal ones as ``or_equal`` says."""
        n = self.common(x, y)
        inside = np.minimum(n, LENGTH - 1)
        a, b = self.data[x + inside], self.data[y + inside]
        return np.where(n == LENGTH, or_equal, a < b)

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The order of suffixes within their groups (in ascending order): a merge sort of all groups at once.

        Two sorted halves are merged by finding each member's rank in the other half by binary search.
        """
        order = np.arange(len(at))
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[start, len(at)])
        first, count = np.repeat(start, size), np.repeat(size, size)
        width = 1
        while len(active := np.flatnonzero(count > width)):
            local = active - first[active]
            block = local // (2 * width) * (2 * width)
            right = local - block >= width
            low = np.minimum(block + np.where(right, 0, width), count[active])
            high = np.minimum(low + width, count[active])
            base, begin = first[active], low.copy()
            own = at[order[active]]
            while len(go := np.flatnonzero(low < high)):
                middle = (low[go] + high[go]) >> 1
                before = self.less(at[order[base[go] + middle]], own[go], right[go])
                low[go] = np.where(before, middle + 1, low[go])
                high[go] = np.where(before, high[go], middle)
            to = base + block + (local - block - np.where(right, width, 0)) + (low - begin)
            moved = order.copy()
            moved[to] = order[active]
            order = moved
            width *= 2
        return order

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the first LENGTH bytes of suffix x are less than, equal to or greater than those of y, by the bytes."""
        words = np.ndarray(len(self.data) - 7, ">u8", self.data, 0, (1,))
        out, left = np.zeros(len(x), np.int8), np.arange(len(x))
        for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
            a, b = words[x[left] + k], words[y[left] + k]
            out[left] = (a > b).astype(np.int8) - (a < b)
            left = left[a == b]
        return out


def repeats(runs: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Spans of windows that start earlier in another of these runs; ``data`` holds a run's bytes from ``starts`` on."""
    if not len(runs):
        return np.zeros(0, SPAN)
    n = runs["n"].astype(np.int64)
    run = np.repeat(np.arange(len(runs)), n)
    shift = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    _, anchor = np.unique(runs["anchor"], return_inverse=True)
    group = anchor[run] * 256 + (runs["at"].astype(np.int64)[run] - shift)
    order = np.argsort(group, kind="stable")
    run, shift, group = run[order], shift[order], group[order]
    edge = np.r_[True, group[1:] != group[:-1], True]
    several = ~(edge[:-1] & edge[1:])
    run, shift, group = run[several], shift[several], group[several]
    if not len(run):
        return np.zeros(0, SPAN)
    suffixes, at = Suffixes(data), starts[run] + shift
    order = suffixes.sort(at, group)
    run, shift, at = run[order], shift[order], at[order]
    near = np.flatnonzero(group[1:] == group[:-1])
    way = suffixes.compare(at[near], at[near + 1])
    same = np.zeros(len(run), bool)
    same[near[way == 0] + 1] = True
    classes = np.cumsum(~same)
    for g in np.unique(group[near[way > 0]]).tolist():  # a hash has lied: these windows are told apart by their bytes
        own = np.flatnonzero(group == g)
        found: dict[bytes, int] = {}
        classes[own] = [-1 - own[0] - found.setdefault(data[a : a + LENGTH].tobytes(), len(found)) for a in at[own].tolist()]
    place = runs["lo"].astype(np.int64)[run] + shift
    order = np.lexsort((place, runs["key"][run], classes))
    later = np.zeros(len(run), bool)
    later[order[1:]] = classes[order[1:]] == classes[order[:-1]]
    out = np.zeros(int(later.sum()), SPAN)
    out["key"], out["lo"], out["hi"] = runs["key"][run[later]], place[later], place[later] + LENGTH
    return merged(out)


BUCKETED = "bucket long, kind int, blob binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    buckets, kinds, blobs = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])


def _grouped(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """The rows of each bucket, where a partition is sorted by it."""
    from itertools import groupby

    each = (x for b in rows for x in zip(*(b.column(k) for k in range(3)), strict=True))
    for bucket, own in groupby(each, key=lambda x: x[0].as_py()):
        yield bucket, ((k.as_py(), blob.as_py()) for _, k, blob in own)


def _deal_runs(n_anchor: int, n_doc: int, base: np.uint64, merge: bool):
    """RUNS: one run of each content, by anchor. SPANS: what the others cover, compared byte by byte, by document."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for piece in chain((p for b in rows for p in slices(b, "text", SLICE)), [None]):
            if piece is not None:
                data, offsets = string_bytes(piece.column(1))
                held.append((*runs_of(data, offsets, np.asarray(piece.column(0)), base), data))
            if held and (piece is None or sum(len(x[0]) for x in held) >= DEALT):
                runs, data = np.concatenate([x[0] for x in held]), np.concatenate([*(x[2] for x in held), np.zeros(8, np.uint8)])
                before = np.cumsum([0, *(len(x[2]) for x in held[:-1])])
                place = np.concatenate([x[1] + b for x, b in zip(held, before.tolist(), strict=True)])
                held = []
                order, first = sorted_runs(runs, merge)
                runs, place = runs[order], place[order]
                again = np.flatnonzero(~first)
                true = (runs["n"][again] == runs["n"][again - 1]) & (runs["at"][again] == runs["at"][again - 1])
                check = again[true]
                true[true] = same_bytes(data, place[check - 1], place[check], runs["n"][check].astype(np.int64) + LENGTH - 1)
                if not true.all():
                    yield _batch([(0, LIE, b"")])
                    continue
                covered, runs = merged(spans_of(runs[~first])), runs[first]
                runs = runs[np.lexsort((runs["lo"], runs["key"]))]
                yield _batch([(b, RUNS, x) for b, x in by_bucket(runs, bucket_of(runs["anchor"], n_anchor, 1))])
                yield _batch([(b, SPANS, x) for b, x in by_bucket(covered, bucket_of(covered["key"], n_doc, 2) + n_anchor)])

    return run


def _compare_runs(n_doc: int, n_anchor: int, merge: bool):
    """By document, SPANS: as they come. FIRST, SECOND: runs of equal hashes, each with the one before it. ASKED, SPLIT:
    the first run of each content at anchors that have several, whole or by distance."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, own in _grouped(rows):
            held = []
            for kind, blob in own:
                if kind == LIE:
                    yield _batch([(0, LIE, b"")])
                elif bucket >= n_anchor:
                    yield _batch([(bucket - n_anchor, SPANS, blob)])
                else:
                    held.append(unpack(blob, RUN))
            if not held:
                continue
            runs = np.concatenate(held)
            order, first = sorted_runs(runs, merge)
            runs = runs[order]
            again = np.flatnonzero(~first)
            if (runs["n"][again] != runs["n"][again - 1]).any() or (runs["at"][again] != runs["at"][again - 1]).any():
                yield _batch([(0, LIE, b"")])
                continue
            pairs = np.zeros(len(again), PAIR)
            pairs["key"], pairs["lo"], pairs["other"], pairs["at"], pairs["size"] = runs["key"][again - 1], runs["lo"][again - 1], runs["key"][again], runs["lo"][again], runs["n"][again]
            pairs = pairs[np.lexsort((pairs["lo"], pairs["other"], pairs["key"]))]
            runs = runs[first]
            starts = np.flatnonzero(np.r_[True, runs["anchor"][1:] != runs["anchor"][:-1]])
            count = np.repeat(np.diff(np.r_[starts, len(runs)]), np.diff(np.r_[starts, len(runs)]))
            asked, split = runs[(count > 1) & (count <= HOT)], split_by_distance(runs[count > HOT])
            asked, split = (x[np.lexsort((x["lo"], x["key"]))] for x in (asked, split))
            for kind, x, name in ((ASKED, asked, "key"), (SPLIT, split, "key"), (FIRST, pairs, "key"), (SECOND, pairs, "other")):
                yield _batch([(b, kind, y) for b, y in by_bucket(x, bucket_of(x[name], n_doc, 2))])

    return run


def _pack_texts(n_doc: int):
    """TEXTS, by document."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            return _batch([(b, TEXTS, _text_block(x)) for b, x in held.items()])

        for batch in rows:
            for piece in slices(batch, "text", SLICE):
                data, off = string_bytes(piece.column(1))
                keys = np.asarray(piece.column(0))
                for k, b, a, z in zip(keys.tolist(), bucket_of(keys, n_doc, 2).tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                    held.setdefault(b, []).append((k, data[a:z].tobytes()))
                size += len(data)
                if size >= 4 * SLICE:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    return run


def _text_block(docs: list[tuple[int, bytes]]) -> bytes:
    body = b"".join(x for _, x in docs)
    head = np.array([(k, len(x)) for k, x in docs], np.int64).tobytes()
    return struct.pack("<qq", len(docs), len(body)) + bytes(pa.compress(head + body, "zstd", asbytes=True))


def _texts(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, offsets and bytes of a block."""
    n, size = struct.unpack_from("<qq", blob)
    data = pa.decompress(blob[16:], 16 * n + size, "zstd", asbytes=True)
    head = np.frombuffer(data, np.int64, 2 * n).reshape(n, 2)
    return head[:, 0], np.r_[0, np.cumsum(head[:, 1])], np.frombuffer(data, np.uint8, size, 16 * n)


class _Gathered:
    """Rows and their bytes, held until they are worth sending: one row for each bucket that they go to."""

    def __init__(self, kind: int) -> None:
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self.rows: list[np.ndarray] = []
        self.buckets: list[np.ndarray] = []
        self.bodies: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, rows: np.ndarray, bucket: np.ndarray, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> None:
        if len(rows):
            body = _cut(data, begin, sizes)
            for held, x in ((self.rows, rows), (self.buckets, bucket), (self.bodies, body), (self.sizes, sizes)):
                held.append(x)
            self.size += len(body)

    def send(self) -> pa.RecordBatch:
        out = []
        if self.rows:
            rows, bucket, data, sizes = (np.concatenate(x) for x in (self.rows, self.buckets, self.bodies, self.sizes))
            begin, order = np.cumsum(sizes) - sizes, np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0, True])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = order[a:b]
                head, body = pack(rows[own]), _cut(data, begin[own], sizes[own]).tobytes()
                out.append((int(bucket[own[0]]), self.kind, struct.pack("<qq", len(head), len(body)) + head + bytes(pa.compress(body, "zstd", asbytes=True))))
        self.clear()
        return _batch(out)


def _cut(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes from ``begin`` on, ``sizes`` of each, joined."""
    ends = np.cumsum(sizes)
    return data[np.repeat(begin - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _bodies(blobs: list[bytes], dtype: np.dtype) -> tuple[np.ndarray, bytes]:
    """The rows of several blobs, and their bytes, joined."""
    rows, bodies = [np.zeros(0, dtype)], []
    for blob in blobs:
        h, size = struct.unpack_from("<qq", blob)
        rows.append(unpack(blob[16 : 16 + h], dtype))
        bodies.append(pa.decompress(blob[16 + h :], size, "zstd", asbytes=True))
    return np.concatenate(rows), b"".join(bodies)


def _fetch(n_anchor: int):
    """BODIES: runs that are asked for, with their bytes, by anchor. STRETCHES: either side of pairs, with bytes, by the pair."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies, either = _Gathered(BODIES), _Gathered(STRETCHES)
        for _, own in _grouped(rows):
            asked: dict[int, list[np.ndarray]] = {ASKED: [], SPLIT: [], FIRST: [], SECOND: []}
            runs = None
            for kind, blob in own:
                if kind != TEXTS:
                    asked[kind].append(unpack(blob, RUN if kind in (ASKED, SPLIT) else PAIR))
                    continue
                if runs is None:
                    whole, split = (np.concatenate([np.zeros(0, RUN), *asked[k]]) for k in (ASKED, SPLIT))
                    part = split["at"].astype(np.uint64) // np.uint64(WINDOW // PARTS) + np.uint64(1)
                    bucket = np.r_[bucket_of(whole["anchor"], n_anchor, 3), bucket_of(mix64(split["anchor"] ^ mix64(part)), n_anchor, 3)]
                    runs = np.concatenate([whole, split])
                    order = np.lexsort((runs["lo"], runs["key"]))
                    runs, bucket = runs[order], bucket[order]
                    sides = [stretches(np.concatenate([np.zeros(0, PAIR), *asked[k]]), k - FIRST) for k in (FIRST, SECOND)]
                    sides[1] = sides[1][np.argsort(sides[1]["other"], kind="stable")]
                    asked.clear()
                if not len(runs) and not any(map(len, sides)):
                    break
                keys, off, data = _texts(blob)
                order = np.argsort(keys)
                keys, off = keys[order], off[order]

                def here(x: np.ndarray, keys: np.ndarray = keys, off: np.ndarray = off) -> tuple[np.ndarray, np.ndarray]:
                    """Which of these documents (ascending) lie in the block, and where."""
                    a, b = np.searchsorted(x, keys), np.searchsorted(x, keys, "right")
                    return _cut(np.arange(len(x)), a, b - a), np.repeat(off, b - a)

                which, begin = here(runs["key"])
                bodies.add(runs[which], bucket[which], data, begin + runs["lo"][which], runs["n"][which].astype(np.int64) + LENGTH - 1)
                for side, key, lo in ((sides[0], "key", "lo"), (sides[1], "other", "at")):
                    which, begin = here(side[key])
                    x = side[which]
                    to = bucket_of(mix64(x["key"].view(np.uint64)) ^ x["other"].view(np.uint64), n_anchor, 4)
                    either.add(x, to, data, begin + x[lo], x["size"].astype(np.int64))
                for g in (bodies, either):
                    if g.size >= GATHERED:
                        yield g.send()
        yield bodies.send()
        yield either.send()

    return run


def compared(rows: np.ndarray, body: bytes) -> np.ndarray | None:
    """What the later sides of stretches cover; nothing if two sides differ. Each stretch is there with either side."""
    sizes = rows["size"].astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    order = np.lexsort((rows["side"], rows["at"], rows["lo"], rows["other"], rows["key"]))
    for i, j in zip(order[::2].tolist(), order[1::2].tolist(), strict=True):
        if any(rows[name][i] != rows[name][j] for name in PAIR.names) or body[begin[i] : begin[i] + sizes[i]] != body[begin[j] : begin[j] + sizes[j]]:
            return None
    own = rows[order[1::2]]
    out = np.zeros(len(own), SPAN)
    out["key"], out["lo"], out["hi"] = own["other"], own["at"], own["at"] + own["size"]
    return out


def _sort_runs(n_doc: int):
    """By document, SPANS: what later windows cover, and the later sides of stretches that are equal."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _grouped(rows):
            blobs: dict[int, list[bytes]] = {BODIES: [], STRETCHES: []}
            for kind, blob in own:
                blobs[kind].append(blob)
            pairs = compared(*_bodies(blobs.pop(STRETCHES), STRETCH))
            if pairs is None:
                yield _batch([(0, LIE, b"")])
                pairs = np.zeros(0, SPAN)
            runs, body = _bodies(blobs.pop(BODIES), RUN)
            sizes = runs["n"].astype(np.int64) + LENGTH - 1
            spans = repeats(runs, np.frombuffer(body + bytes(LENGTH), np.uint8), np.cumsum(sizes) - sizes)
            spans = merged(np.concatenate([pairs, spans]))
            yield _batch([(b, SPANS, x) for b, x in by_bucket(spans, bucket_of(spans["key"], n_doc, 2))])

    return run


REMOVED = "key long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _remove(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without what is covered; in a bucket the spans come before the texts."""
    for _, own in _grouped(rows):
        held: list[np.ndarray] = []
        spans = None
        for kind, blob in own:
            if kind == SPANS:
                held.append(unpack(blob, SPAN))
                continue
            if spans is None:
                spans = merged(np.concatenate(held)) if held else np.zeros(0, SPAN)
            keys, off, data = _texts(blob)
            order = np.argsort(keys)
            at = np.searchsorted(keys[order], spans["key"])
            here = np.flatnonzero(keys[order][np.minimum(at, len(keys) - 1)] == spans["key"])
            row = order[at[here]]
            lo, hi = spans["lo"][here].astype(np.int64), spans["hi"][here].astype(np.int64)
            order = np.argsort(row, kind="stable")
            row, lo, hi = row[order], lo[order], hi[order]
            cover = np.zeros(len(data) + 1, np.int32)
            np.add.at(cover, off[row] + lo, 1)
            np.add.at(cover, off[row] + hi, -1)
            keep = np.cumsum(cover[:-1]) == 0
            ends = np.r_[0, np.cumsum(keep)][off]
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes())])
            counts = np.r_[0, np.cumsum(np.bincount(row, minlength=len(keys)))].astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(counts), pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], ["start", "end"]))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.diff(off)), found, kept.cast(pa.binary())], ["key", "n_bytes", "spans", "kept"])


def _dealt(df: DataFrame, n: int) -> DataFrame:
    """Bucket k in partition k, which a hash of so few numbers would not give."""
    return df.repartitionById(n, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "kind")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes``, ``spans`` (what was removed, as byte offsets) and ``kept`` (binary) for every row of ``docs``.

    A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of smaller key,
    or earlier in the same. Strings are taken from the input as it is. A null text is empty; a text under ``LENGTH``
    bytes is kept whole; texts of any length are taken whole, in overlapping segments. Rows that repeat key and text are
    one document and get equal results; rows of one key with different texts follow each other by a hash of the text; a
    null key comes before all others. Other columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{key}`").alias("name"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    marked = identified(rows, "name", "text", "key")
    count, distinct, n_bytes = marked.agg(F.count("*"), F.count_distinct("key"), F.sum(F.octet_length("text"))).first()
    if count == distinct:
        out = _remove_repeats(marked.select("key", "text"), docs.sparkSession, n_bytes or 0)
    else:
        out = _remove_repeats(marked.groupBy("key").agg(F.first("text").alias("text")), docs.sparkSession, n_bytes or 0)
    if rows.schema["name"].dataType == marked.schema["key"].dataType and count == distinct and not marked.where("not (name <=> key)").limit(1).count():
        return out.withColumnRenamed("key", key)
    return marked.select("name", "key").join(out, "key").select(F.col("name").alias(key), "n_bytes", "spans", "kept")


def _remove_repeats(table: DataFrame, spark: SparkSession, n_bytes: int, bases: tuple[int | None, ...] | None = None) -> DataFrame:
    """Under each base of the hash of contents in turn until none lies; None stands for no hash."""
    n = partitions_for(n_bytes, spark, BUCKET)
    texts = table.mapInArrow(_pack_texts(n), BUCKETED)
    for base in bases or (secrets.randbits(64) | 1, secrets.randbits(64) | 1, None):
        merge, odd = base is not None, np.uint64(BASE_B if base is None else base)
        dealt = table.mapInArrow(_deal_runs(n, n, odd, merge), BUCKETED)
        found = materialize(_dealt(dealt, 2 * n).mapInArrow(_compare_runs(n, n, merge), BUCKETED), "runs")
        fetched = _dealt(found.where(F.col("kind").between(ASKED, SECOND)).unionByName(texts), n).mapInArrow(_fetch(n), BUCKETED)
        later = materialize(_dealt(fetched, n).mapInArrow(_sort_runs(n), BUCKETED), "windows")
        if not found.unionByName(later).where(F.col("kind") == LIE).limit(1).count():
            break
    spans = found.unionByName(later).where(F.col("kind") == SPANS)
    return _dealt(spans.unionByName(texts), n).mapInArrow(_remove, REMOVED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings of 100 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

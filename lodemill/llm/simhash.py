"""SimHash near-duplicates, found by a vantage-point tree over the fingerprints.

Each node of the tree has a vantage point of its own and parts its fingerprints by their Hamming distance to it, on one
block of bits; the levels below a node measure other blocks. By the triangle inequality two fingerprints differ by at
least the sum, over the levels, of how far their distances to the vantage points lie apart, since the blocks are disjoint.
So a ball of radius r goes on only to branches where this sum is r at most. The upper tree is built from a bounded
sample, which says where a node is too full for a task; its leaves are the shards into which fingerprints are dealt. A
fingerprint goes as a query to all later shards that its ball overlaps. Within a shard a second tree, of smaller blocks
and built from what is there, prunes again, and what remains is compared bit by bit, so the pairs are exact.

The pipeline's stage (``keep_first``) takes the groups of this operator, and beside them asks for word shingles of
similarity 0.8, which lie up to some 12 of 64 bits apart. No ball of that size leaves a branch of bits out, so for these a
second tree measures sizes of sets of shingles from the empty set, wide fingerprints find candidates, and their sets are
compared exactly. What one of both ways links is one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE_A, BASE_B, identified, materialize, mix64, slices
from .components import components

#: Words of a shingle, seed of its hash, bits in which linked fingerprints may differ.
WORDS, SEED, RADIUS = 3, 42, 3
#: Of the pipeline's stage: words of a shingle; similarity of sets as a fraction; 64-bit words of a wide fingerprint; bits
#: in which candidates may differ in the first word and in all. Sets at the similarity differ in 10 of 64 bits on average
#: (12 for sets of four), with a deviation of 3: both radii lie more than three deviations beyond.
STAGE_WORDS, SIMILAR, WIDE, NEAR, WIDE_NEAR = 5, (4, 5), 4, 22, 72
#: Ratio of sizes that a level spans (over 5/4, so that similar sets are at most one level apart), sets of a block at most.
LEVEL, BLOCK = 1.3, 1 << 17
ROW = np.dtype([("fp", np.int64), ("n", np.int64), ("wide", np.uint64, (WIDE,))])
#: Bits that the levels of the tree over shards measure, and of the tree within a shard.
COARSE, FINE = (16, 16, 8, 8, 4, 4, 4, 4), (8, 8, 8, 8, *(4,) * 8)
#: Fingerprints from which the tree over shards is built, by a hash; how many a shard is to hold at most; candidates for a vantage point.
SAMPLE, LEAF, TRIED = 20_000, 1 << 16, 16
#: Bytes of text whose shingles are held at a time, fingerprints dealt at a time, comparisons made at a time.
SLICE, DEALT, COMPARED = 2 << 20, 100_000, 1 << 18
#: For each byte, its bits as eight bytes: sums of up to 255 of them do not run over.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprints(texts: list[str | None], words: int) -> np.ndarray:
    """A SimHash for each text, as uint64."""
    from xxhash import xxh64_intdigest

    shingles = []
    for text in texts:
        w = text.encode().lower().split() if text else []
        shingles.append([b" ".join(w)] if 0 < len(w) < words else list(map(b" ".join, zip(*[w[k:] for k in range(words)], strict=False))))
    counts = np.fromiter(map(len, shingles), np.int64, len(shingles))
    out = np.zeros(len(texts), np.uint64)
    if not counts.sum():
        return out
    hashes = np.fromiter(map(xxh64_intdigest, chain.from_iterable(shingles), repeat(SEED)), np.uint64, int(counts.sum()))
    full = np.flatnonzero(counts)
    n = counts[full]
    starts = np.cumsum(n) - n
    pieces = -(-n // 255)
    first = np.cumsum(pieces) - pieces
    cuts = np.repeat(starts - first * 255, pieces) + np.arange(int(pieces.sum())) * 255
    lanes = np.add.reduceat(LANES[hashes.view(np.uint8).reshape(-1, 8)], cuts, axis=0)
    sums = np.add.reduceat(lanes.view(np.uint8).reshape(len(cuts), 64).astype(np.int64), first, axis=0)
    out[full] = np.packbits(sums * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS, out: str = "fp") -> DataFrame:
    """Replace ``text`` by ``out``, a SimHash as long: A-Z lower-cased, words between ASCII spaces, each shingle of
    ``words`` words with repeats hashed by XXH64; a bit is set if it is in over half of the hashes. A text of fewer
    words is one shingle, a null or empty text has fingerprint zero. Texts are taken whole, 2 MB or one text at a time.
    """
    others = [c for c in docs.columns if c not in (text, out)]
    kept = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in slices(whole, text, SLICE):
                fps = _fingerprints(batch.column(batch.num_columns - 1).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], [*others, out])

    return kept.mapInArrow(run, kept.drop(text).withColumn(out, F.lit(0).cast("long")).schema)


def blocks(widths: tuple[int, ...]) -> list[np.uint64]:
    """Masks of disjoint blocks of bits, from the lowest up."""
    cuts = np.cumsum([0, *widths]).tolist()
    return [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def distances(fps: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((fps ^ vantage) & mask).astype(np.int64)


def vantage_of(fps: np.ndarray, mask: np.uint64) -> np.uint64:
    """Of some fingerprints, evenly taken from ``fps``, the one whose distances to all spread most."""
    tried, held = fps[:: max(1, len(fps) // TRIED)], fps[:: max(1, len(fps) // 1024)]
    return tried[int(np.argmax([distances(held, v, mask).var() for v in tried]))]


@dataclass
class Node:
    """A vantage point, the block that it looks at, and children by ranges of distance; a leaf has a number and ``parts`` instead."""

    leaf: int = -1
    parts: int = 1
    vantage: np.uint64 = np.uint64(0)
    mask: np.uint64 = np.uint64(0)
    children: list[tuple[int, int, Node]] = field(default_factory=list)


class Tree:
    """A tree over shards, from a sample in which each fingerprint stands for ``weight`` of them.

    A node that stands for more than ``leaf`` is parted on, until all blocks are used; a leaf that is still too full is
    cut into parts by a hash, and each pair of its parts is a shard.
    """

    def __init__(self, sample: np.ndarray, weight: float, leaf: int, widths: tuple[int, ...] = COARSE) -> None:
        self.leaves: list[Node] = []
        self.root = self._grown(sample, weight, leaf, blocks(widths))

    def _grown(self, fps: np.ndarray, weight: float, leaf: int, masks: list[np.uint64]) -> Node:
        if len(fps) * weight <= leaf or not masks or len(fps) < 2:
            node = Node(len(self.leaves), max(1, -(-int(len(fps) * weight) // leaf)))
            self.leaves.append(node)
            return node
        node = Node(vantage=vantage_of(fps, masks[0]), mask=masks[0])
        d = distances(fps, node.vantage, masks[0])
        counts, a = np.bincount(d, minlength=65), 0
        for b in range(65):  # an eighth of the fingerprints or more to each range, so that no shard is tiny
            if counts[a : b + 1].sum() * 8 >= len(fps) and counts[b + 1 :].sum() * 8 >= len(fps) or b == 64:
                node.children.append((a, b, self._grown(fps[(d >= a) & (d <= b)], weight, leaf, masks[1:])))
                a = b + 1
        return node

    def overlaps(self, fps: np.ndarray, radius: int) -> list[tuple[Node, np.ndarray, np.ndarray]]:
        """The leaves that the balls of ``fps`` overlap, which these are, and whether each one is at home there."""
        out = []

        def go(node: Node, own: np.ndarray, left: np.ndarray, home: np.ndarray) -> None:
            if not len(own):
                return
            if node.leaf >= 0:
                out.append((node, own, home))
                return
            d = distances(fps[own], node.vantage, node.mask)
            for a, b, child in node.children:
                rest = left - np.maximum(np.maximum(a - d, d - b), 0)
                near = rest >= 0
                go(child, own[near], rest[near], home[near] & (d[near] >= a) & (d[near] <= b))

        go(self.root, np.arange(len(fps)), np.full(len(fps), radius), np.ones(len(fps), bool))
        return out


def _union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a[i] and b[i]; labels hold the least member that is known for each."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (short := labels[labels]).tobytes() != labels.tobytes():
            labels[:] = short


def _search(fps: np.ndarray, home: np.ndarray, asked: np.ndarray, left: np.ndarray, masks: list[np.uint64], radius: int, labels: np.ndarray) -> int:
    """Join every pair of a member of ``home`` and one of ``asked`` within the radius, of which the nodes above leave ``left``.

    Returns how many pairs were compared bit by bit.
    """
    if not len(home) or not len(asked):
        return 0
    if masks and len(home) * len(asked) > COMPARED:
        vantage = vantage_of(fps[home], masks[0])
        h, q = distances(fps[home], vantage, masks[0]), distances(fps[asked], vantage, masks[0])
        compared = 0
        for value in np.unique(h):
            rest = left - np.abs(q - value)
            near = rest >= 0
            compared += _search(fps, home[h == value], asked[near], rest[near], masks[1:], radius, labels)
        return compared
    step = max(1, COMPARED // len(asked))
    for k in range(0, len(home), step):
        part = home[k : k + step]
        i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[asked][None, :]) <= radius)
        _union(labels, part[i], asked[j])
    return len(home) * len(asked)


def _groups(fps: np.ndarray, at_home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of one shard: members of groups, each one's first member, and how many pairs were compared. fps may repeat, as a query beside itself."""
    labels = np.arange(len(fps))
    everything = np.arange(len(fps))
    compared = _search(fps, np.flatnonzero(at_home), everything, np.full(len(fps), radius), blocks(FINE), radius, labels)
    tied = np.flatnonzero(labels != everything)
    return fps[tied], fps[labels[tied]], compared


def shards_of(tree: Tree, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, fingerprint, and whether it is at home there: in its own leaf and, as a query, in every later one that its ball overlaps."""
    begin = np.cumsum([0, *(x.parts * (x.parts + 1) // 2 for x in tree.leaves)])
    found = tree.overlaps(fps, radius)
    homes = np.full(len(fps), -1)
    for node, own, home in found:
        homes[own[home]] = node.leaf
    shards, values, kinds = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]

    def add(shard: np.ndarray | int, x: np.ndarray, home: np.ndarray | bool) -> None:
        shards.append(np.broadcast_to(np.asarray(shard, np.int64), x.shape))
        values.append(x)
        kinds.append(np.broadcast_to(home, x.shape))

    for node, own, home in found:
        first, n = int(begin[node.leaf]), node.parts
        keep = home | (homes[own] < node.leaf)
        x, home = fps[own[keep]], home[keep]
        if n == 1:
            add(first, x, home)
            continue
        part = (mix64(x) % np.uint64(n)).astype(np.int64)
        for b in range(n):  # shard (b, b): a part and all queries; (b, c): a part, and another one as queries
            for c in range(b, n):
                add(first + b * n - b * (b - 1) // 2 + c - b, x[home & (part == b)], True)
                add(first + b * n - b * (b - 1) // 2 + c - b, x[~home if b == c else home & (part == c)], False)
    return np.concatenate(shards), np.concatenate(values), np.concatenate(kinds)


def links(fps: DataFrame, radius: int = RADIUS, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """Links ``a``, ``b`` that connect all values of ``fps.fp`` within ``radius`` bits of each other.

    Of each group that a shard holds, only ties to one of its members are returned: as many as it has members, so no
    table grows with the square of a group. ``fp`` is to be distinct; nulls are ignored. The tree over shards is built on
    the driver from some ``sample`` fingerprints, whichever those are; they decide how even the shards are, not what is found.
    """
    fps = fps.where("fp is not null").select("fp")
    n = fps.count()
    every = max(1, n // sample)
    taken = fps.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).orderBy("fp").toArrow().column(0).to_numpy()
    tree = Tree(np.ascontiguousarray(taken).view(np.uint64), every, leaf)

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in chain(rows, [None]):
            if batch is not None:
                held.append(np.asarray(batch.column(0)).view(np.uint64))
            if held and (batch is None or sum(map(len, held)) >= DEALT):
                cell, value, kind = shards_of(tree, np.concatenate(held), radius)
                held = []
                order = np.argsort(cell * 2 + kind, kind="stable")
                cell, value, kind = cell[order], value[order], kind[order]
                cuts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])][: len(cell)])
                off = pa.py_buffer((np.r_[cuts, len(cell)] * 8).astype(np.int32).tobytes())
                blobs = pa.BinaryArray.from_buffers(pa.binary(), len(cuts), [None, off, pa.py_buffer(value.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(cell[cuts]), pa.array(kind[cuts]), blobs], ["cell", "home", "fps"])

    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, homes = None, [], []

        def close() -> pa.RecordBatch:
            a, b, _ = _groups(np.concatenate(held), np.concatenate(homes), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in rows:
            for c, home, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if c != cell:
                    if held:
                        yield close()
                    cell, held, homes = c, [], []
                held.append(np.frombuffer(blob, np.uint64))
                homes.append(np.full(len(held[-1]), home))
        if held:
            yield close()

    dealt = fps.mapInArrow(deal, "cell long, home boolean, fps binary").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(search, "a long, b long").where("a != b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``key``, ``fp`` and ``component_id`` for every row of ``docs``: the least key that links of at most ``radius``
    differing bits lead to, the row's own included.

    Rows with null or empty texts share fingerprint zero and are linked like any other. Repeated rows and keys are
    kept; a null key counts for nothing in a minimum. An empty table gives an empty result. Other columns are ignored.
    """
    marked = materialize(fingerprints(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")), "_text", words), "fingerprints")
    firsts = materialize(marked.groupBy("fp").agg(F.min("_key").alias("first")), "firsts")
    groups = components(links(firsts, radius))
    rooted = firsts.join(groups, F.col("fp") == F.col("node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    moved = rooted.join(least, "root").select("fp", "least")
    # written out, so that the join below is a plain one whose hot fingerprints AQE can split
    final = materialize(firsts.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "components")
    return marked.join(final, "fp", "left").select(F.col("_key").alias(key), "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text the hashes of its distinct shingles; words and short texts as in ``fingerprints``."""
    from xxhash import xxh64_intdigest

    out = []
    for text in texts:
        w = text.encode().lower().split() if text else []
        shingles = {b" ".join(w)} if 0 < len(w) < words else set(map(b" ".join, zip(*[w[k:] for k in range(words)], strict=False)))
        out.append(np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))))
    return out


def _wide(hashes: np.ndarray) -> bytes:
    """A SimHash of ``WIDE`` words of 64 bits of a set of hashes: a bit is set if it is in over half of them."""
    more = np.ascontiguousarray(mix64(hashes[:, None] + np.arange(WIDE, dtype=np.uint64) * BASE_A)).view(np.uint8)
    sums = np.zeros(64 * WIDE, np.int64)
    for k in range(0, len(more), 255):
        sums += LANES[more[k : k + 255]].sum(axis=0).view(np.uint8)
    return np.packbits(sums * 2 > len(hashes), bitorder="little").tobytes()


def wide_fingerprints(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``__id``, ``key``, ``fp`` (a hash of the whole set of shingles), ``n`` (its size) and ``wide`` for every row."""
    kept = docs.select("__id", F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in slices(whole, "text", SLICE):
                sets = _shingle_sets(batch.column(2).to_pylist(), words)
                fps = np.array([mix64(s ^ BASE_B).sum() for s in sets], np.uint64)
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64)), sizes, pa.array(map(_wide, sets), pa.binary())], ["__id", "key", "fp", "n", "wide"])

    return kept.mapInArrow(run, kept.drop("text").withColumns({"fp": F.lit(0).cast("long"), "n": F.lit(0).cast("long"), "wide": F.lit(b"")}).schema)


def _within(rows: np.ndarray, at_home: np.ndarray, alone: bool, labels: np.ndarray) -> None:
    """Join rows (``ROW``) that are at home and others, or, if ``alone``, all rows, whose sizes and wide fingerprints lie near."""
    order = np.argsort(rows["n"], kind="stable")
    home = order if alone else order[at_home[order]]
    asked = order if alone else order[~at_home[order]]
    sizes, first = rows["n"][asked], np.ascontiguousarray(rows["wide"][asked, 0])
    k, held = 0, []
    while k < len(home):
        lo = k if alone else int(np.searchsorted(sizes * 5, rows["n"][home[k]] * 4))
        part = home[k : k + 1024]
        step = max(1, COMPARED // len(part))
        hi = int(np.searchsorted(sizes * 4, rows["n"][part[-1]] * 5, "right"))
        for a in range(lo, hi, step):
            i, j = np.nonzero(np.bitwise_count(rows["wide"][part, 0][:, None] ^ first[None, a : min(a + step, hi)]) <= NEAR)
            i, j = part[i], asked[a + j]
            x, y = rows["n"][i], rows["n"][j]
            ok = (i != j) & (np.minimum(x, y) * 5 >= np.maximum(x, y) * 4)
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(rows["wide"][i] ^ rows["wide"][j]).sum(axis=1) <= WIDE_NEAR
            held.append((i[ok], j[ok]))
        k += len(part)
        if held and (sum(len(i) for i, _ in held) > COMPARED or k >= len(home)):
            _union(labels, *map(np.concatenate, zip(*held, strict=True)))
            held = []


def candidates(sets: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that connect all ``sets.fp`` that may be similar by ``SIMILAR``; as few as in ``links``.

    The vantage point is the empty set: a set lies as far from it as it has shingles, and similar ones differ by a
    quarter at most, so a level of the tree is a range of sizes and a set is held against its own level and the next.
    Levels of more than ``BLOCK`` sets are cut into blocks, and each pair of blocks is a shard. Within a shard sizes
    prune again, and then ``NEAR`` bits of the first word and ``WIDE_NEAR`` of all words.
    """
    sets = sets.where("n > 0").select("fp", "n", "wide", F.floor(F.log(LEVEL, F.col("n"))).alias("level"))
    parts = {r["level"]: -(-r["count"] // BLOCK) for r in sets.groupBy("level").count().collect()}

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fp, n, level = (np.asarray(batch.column(k)) for k in (0, 1, 3))
            x = np.zeros(len(fp), ROW)
            x["fp"], x["n"] = fp, n
            x["wide"] = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, WIDE)
            out = []
            for v in np.unique(level).tolist():
                block = (mix64(x["fp"].view(np.uint64)) % np.uint64(parts[v])).astype(np.int64)
                for b in range(parts[v]):
                    part = x[(level == v) & (block == b)].tobytes()
                    if not part:
                        continue
                    out += [(f"{v}.{b} {v}.{c}" if b <= c else f"{v}.{c} {v}.{b}", b <= c, b == c, part) for c in range(parts[v])]
                    out += [(f"{v}.{b} {v + 1}.{c}", True, False, part) for c in range(parts.get(v + 1, 0))]
                    out += [(f"{v - 1}.{c} {v}.{b}", False, False, part) for c in range(parts.get(v - 1, 0))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["shard", "home", "alone", "rows"])

    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, alone, held in _runs(rows, 1):
            x = np.concatenate([np.frombuffer(b, ROW) for _, _, b in held])
            labels = np.arange(len(x))
            _within(x, np.concatenate([np.full(len(b) // ROW.itemsize, h) for h, _, b in held]), alone, labels)
            tied = np.flatnonzero(labels != np.arange(len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(x["fp"][tied]), pa.array(x["fp"][labels[tied]])], ["a", "b"])

    dealt = sets.mapInArrow(deal, "shard string, home boolean, alone boolean, rows binary").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(search, "a long, b long").where("a != b").distinct()


def _runs(batches: Iterator[pa.RecordBatch], flag: int) -> Iterator[tuple]:
    """Rows that follow each other with one first value: that value, column ``flag`` + 1 of the first, the other columns of all."""
    at, held = None, []
    for batch in batches:
        for first, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and first != at:
                yield at, held[0][flag], held
                held = []
            at = first
            held.append(tuple(rest))
    if held:
        yield at, held[0][flag], held


def _similar(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first one that steps of similarity ``SIMILAR`` or more lead to, by exact counts."""
    labels, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    seen, left = np.zeros(len(names), bool), np.arange(len(sets))
    while len(left):
        root, flat, left = left[0], flat[sizes[left[0]] :], left[1:]
        queue = [root]
        while queue and len(left):
            q = queue.pop()
            seen[own[q]] = True
            common = np.add.reduceat(seen[flat], np.cumsum(sizes[left]) - sizes[left], dtype=np.int64)
            seen[own[q]] = False
            hit = common * SIMILAR[1] >= (sizes[q] + sizes[left] - common) * SIMILAR[0]
            if hit.any():
                labels[left[hit]] = root
                queue += left[hit].tolist()
                flat, left = flat[np.repeat(~hit, sizes[left])], left[~hit]
    return labels


def confirmed(groups: DataFrame, words: int) -> DataFrame:
    """``fp`` and ``to`` (its group's first) of ``groups(root, fp, text)``, the groups of candidates cut by exact similarity."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fps, sets = None, [], []

        def close() -> pa.RecordBatch:
            to = np.array(fps, np.int64)[_similar(sets)]
            return pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(to)], ["fp", "to"])

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                for root, fp, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _shingle_sets(batch.column(2).to_pylist(), words), strict=True):
                    if fps and root != at:
                        yield close()
                        fps, sets = [], []
                    if not fps or fp != fps[-1]:
                        fps.append(fp)
                        sets.append(s)
                    at = root
        if fps:
            yield close()

    return groups.select("root", "fp", "text").repartition("root").sortWithinPartitions("root", "fp").mapInArrow(sets_of, "fp long, to long")


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = STAGE_WORDS) -> DataFrame:
    """``key`` and ``component_id`` for every row: the least key that steps between texts of equal or similar sets of
    shingles (Jaccard ``SIMILAR`` or more) lead to, the row's own included. Nulls, empty texts, repeats and null keys
    are as in ``near_duplicates``."""
    docs = identified(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")), "_key", "_text")
    marked = materialize(wide_fingerprints(docs, "_key", "_text", words), "wide")
    firsts = materialize(marked.groupBy("fp").agg(F.min("key").alias("first"), F.min("__id").alias("__id"), F.min("n").alias("n"), F.min("wide").alias("wide")), "sets")
    groups = components(candidates(firsts))
    members = materialize(firsts.join(groups, F.col("fp") == F.col("node")).select("__id", "fp", "root"), "members")
    rooted = materialize(confirmed(docs.join(members, "__id").withColumnRenamed("_text", "text"), words), "confirmed")
    rooted = firsts.select("fp", "first").join(rooted, "fp")
    least = rooted.groupBy("to").agg(F.min("first").alias("least"))
    moved = rooted.join(least, "to").select("fp", "least")
    final = materialize(firsts.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "components")
    return marked.join(final, "fp", "left").select(F.col("key").alias(key), "component_id")


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``component_id`` for every row: the least key that links of ``near_duplicates`` and of ``similar_documents``,
    in any order, lead to, the row's own included; a null key counts for nothing in a minimum."""
    docs = materialize(identified(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")), "_key", "_text").select("__id", "_key", "_text"), "documents")
    pairs = near_duplicates(docs, "__id", "_text").select("__id", "component_id").unionByName(similar_documents(docs, "__id", "_text"))
    groups = components(pairs.select(F.col("__id").alias("a"), F.col("component_id").alias("b")))
    rows = docs.select("__id", "_key").join(groups, F.col("__id") == F.col("node"), "left").select("_key", F.coalesce("root", "__id").alias("root"))
    rows = materialize(rows, "groups")
    least = rows.groupBy("root").agg(F.min("_key").alias("component_id"))
    return rows.join(least, "root").select(F.col("_key").alias(key), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is the least of its ``duplicates``; repeated rows of that key stay. A row with a null key stays."""
    least = duplicates(docs, key, text).where(F.col("component_id") != F.col(key)).select(F.col(key)).distinct()
    return docs.join(least, key, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the least document that links lead to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")

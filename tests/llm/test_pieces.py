"""Encoding by pieces against the library, and by plain merging."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lodemill.llm import pieces

from .test_operators import DOCS, odd_rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    with open(MODEL, "rb") as f:
        return pieces.Merges(f.read())


def encoded(own, texts: list[str]) -> list[list[int]]:
    strings, counts = own.cut(texts)
    ids, offsets = own.encode(strings)
    ends = offsets[np.r_[0, np.cumsum(counts)]]
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def texts_of(kind: str, own) -> list[str]:
    rng, names = random.Random(kind), list(own.ids)
    letters = {
        "spaces": lambda: rng.choice(" ▁  a"), "pieces": lambda: rng.choice(names), "letters": lambda: rng.choice("etaoinshrdlu "), "repeats": lambda: rng.choice("aab"),
        "scripts": lambda: chr(rng.choice([rng.randint(0, 127), rng.randint(128, 0x24F), rng.randint(0x400, 0x4FF), rng.randint(0x4E00, 0x9FFF), rng.randint(0x1F300, 0x1F6FF), 0x10FFFF])),
    }
    return ["".join(letters[kind]() for _ in range(rng.randint(0, 80))) for _ in range(1500)]


@pytest.mark.parametrize("kind", ["spaces", "pieces", "letters", "repeats", "scripts"])
def test_as_the_library(own, library, kind):
    texts = texts_of(kind, own)
    expected = library.encode(texts, num_threads=1)
    assert encoded(own, texts) == expected
    assert pieces.Surface(own).texts(pa.array(expected, pa.list_(pa.int32()))).to_pylist() == [library.decode(x) for x in expected]


def test_any_ids_decode_as_by_the_library(own, library):
    rng = random.Random(1)
    lists = [[rng.choice([rng.randint(0, 2), rng.randint(3, 258), rng.randint(3, 258), rng.randint(259, 31999), 28705, 259]) for _ in range(rng.randint(0, 9))] for _ in range(4000)]
    surface = pieces.Surface(own)
    for k in range(0, len(lists), 7):  # few at a time: most lists hold bytes that are no text
        some = lists[k : k + 7]
        assert surface.texts(pa.array(some, pa.list_(pa.int32()))).to_pylist() == [library.decode(x) for x in some], some
    assert surface.texts(pa.array([[3 + 0xC3], [3 + 0xA9]], pa.list_(pa.int32()))).to_pylist() == ["�", "�"]
    with pytest.raises(ValueError):
        surface.texts(pa.array([[32000]], pa.list_(pa.int32())))


def test_backtracking_is_needed_and_each_position_fails_once(own):
    """Longest first alone would be wrong for many texts, and a failed position is never tried again."""
    rng, greedy = random.Random(3), 0
    for _ in range(300):
        text = "".join(rng.choice("etaoinshrdlu") for _ in range(40))
        longest, failed = own.longest(text), bytearray(len(text) // 8 + 1)
        ids = own.tokens(longest, 0, len(text), failed)
        assert [own.names[i] for i in ids] == own.merged(list(text))
        at, first = 0, []
        while at < len(text):
            first.append(longest[at])
            at += own.size[longest[at]]
        greedy += first != ids
    assert greedy > 100


def test_long_strings(own, library):
    rng = random.Random(5)
    for text in ("a" * 60_000, "ab" * 30_000, " " * 5_000, "".join(rng.choice("abcdefgh") for _ in range(60_000))):
        assert encoded(own, [text]) == [library.encode(text)]


def test_other_models_are_refused(own):
    def message(*parts: tuple[int, bytes | int]) -> bytes:
        out = b""
        for number, value in parts:
            out += bytes([number << 3, value]) if isinstance(value, int) else bytes([number << 3 | 2, len(value)]) + value
        return out

    piece = lambda name, score, kind: (1, message((1, name.encode())) + b"\x15" + np.float32(score).tobytes() + message((3, kind)))
    trainer, plain = (2, message((3, 2)) + bytes([35 << 3 & 127 | 128, 2, 1])), (3, message((3, 1), (4, 0)))
    base = [piece("<unk>", 0, 2), piece("</s>", 0, 3), *[piece(f"<0x{b:02X}>", 0, 6) for b in range(256)]]
    wrap = lambda *parts: b"".join(bytes([n << 3 | 2, len(v)]) + v for n, v in parts)
    small = pieces.Merges(wrap(*base, piece("▁a", -1, 1), piece("ab", -2, 1), piece("▁ab", -3, 1), piece("▁", -4, 1), piece("a", -5, 1), trainer, plain))
    assert [[small.names[i] for i in x] for x in encoded(small, ["ab", "aab", "b"])] == [["▁ab"], ["▁a", "ab"], ["▁", "<0x62>"]]  # b is no piece, but merges
    for bad in ([piece("x", 0, 4)], [piece("x", 0, 5)], [piece("abc", -1, 1), piece("ab", -2, 1), piece("a", -3, 1), piece("b", -4, 1), piece("c", -5, 1)]):
        with pytest.raises(ValueError):
            pieces.Merges(wrap(*base, *bad, trainer, plain))
    for heads in ([(2, message((3, 1))), plain], [(2, message((3, 2))), plain], [trainer, (3, message((4, 1)))]):
        with pytest.raises(ValueError):
            pieces.Merges(wrap(*base, *heads))


def test_rows(spark, sf, library):
    odd, none = spark.createDataFrame(odd_rows(), DOCS).withColumn("ids", F.lit("x")), spark.createDataFrame([], DOCS)
    got = pieces.decode(pieces.encode(odd, MODEL), MODEL)
    assert got.count() == len(odd_rows()) and pieces.decode(pieces.encode(none, MODEL), MODEL).count() == 0
    for r in got.collect():
        assert r["ids"] == library.encode(r["text"] or "", add_eos=True) and r["decoded"] == library.decode(r["ids"]) and r["host"] == "h"
    assert pieces.encode(odd, MODEL, end=False).where("text is null").first()["ids"] == []
    nothing = spark.createDataFrame([(1, None)], "k int, ids array<int>")
    assert pieces.decode(nothing, MODEL).first()["decoded"] == ""


def test_query(spark, sf, library):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pieces.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert tuple(r) == (r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))

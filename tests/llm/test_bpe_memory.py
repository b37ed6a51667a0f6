"""What byte-level BPE holds at a time: new words and ids in pieces, with the same ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from lodemill.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_words_are_encoded_in_pieces(monkeypatch):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        replay = bpe.Replay(bpe.read_ranks(f.read()))
    words = [f"w{k}ord{k * 7919}" for k in range(1000)] + ["é" * 40, "x", " hello"]
    want, offsets = replay.encode([w.encode() for w in words])
    asked, encode = [], bpe.Replay.encode
    monkeypatch.setattr(bpe, "WORDS", 64)
    monkeypatch.setattr(bpe.Replay, "encode", lambda self, w: (asked.append(len(w)), encode(self, w))[1])
    known = bpe.Known()
    for part in (words[:500], words[300:], []):
        codes = np.array([known[w] for w in part], np.int32)
        known.take(replay)
    assert max(asked) == 64 and (known.ids == want).all() and (known.starts == offsets).all() and (codes == []).all()


def test_ids_are_decoded_in_pieces():
    lists = pa.array([[1] * 100_000, None, [2] * 200_000, [], [3] * 500_000, [4] * 10], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([lists], ["ids"])
    pieces = list(bpe._by_ids(batch, 0))
    assert pa.Table.from_batches(pieces).column(0).to_pylist() == lists.to_pylist()
    assert [len(x.column(0).flatten()) for x in pieces] == [100_000, 200_000, 500_000, 10]

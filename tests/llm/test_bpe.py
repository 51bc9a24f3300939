from __future__ import annotations

import base64
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import EDGE, prose
from tidewater.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load()


@pytest.fixture(scope="module")
def other():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("other", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [prose(70, 300), "a" * 3000, " \n\n  x\t\ty  ", "été 漢字 🙂🙂 don't I'll", "0123456789" * 50, "=" * 200 + "\r\n" * 9, "x" + "ab" * 5000, ""]


def test_against_another_encoder(vocabulary, other):
    ids, cut = bpe.Encoder(vocabulary).encode(TEXTS)
    for k, t in enumerate(TEXTS):
        assert ids[cut[k] : cut[k + 1]].tolist() == other.encode_ordinary(t)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    v = test_any_text.v = getattr(test_any_text, "v", None) or bpe.Vocabulary.load()
    ids, cut = bpe.Encoder(v).encode([text])
    raw, _ = bpe.decode(v, ids, cut)
    assert raw.tobytes().decode() == text


def test_leftmost_of_equal_ranks_and_both_trees(vocabulary):
    """One tree by itself and trees in lockstep agree, with a naive merge loop too."""

    def naive(piece: bytes) -> list[int]:
        t = vocabulary.byte[np.frombuffer(piece, np.uint8)].tolist()
        while len(t) > 1:
            r = vocabulary.rank(np.array(t[:-1]), np.array(t[1:]))
            k = int(r.argmin())
            if r[k] == bpe.NONE:
                break
            t[k : k + 2] = [int(r[k])]
        return t

    rng = np.random.default_rng(2)
    pieces = [bytes(rng.choice(list(b"aabeinrst "), int(n)).tolist()) for n in rng.integers(1, 64, 200)] + [b"a" * 63, b"\xff\x00"]
    ids, size = bpe.encode_together(vocabulary, pieces, 64)
    cut = np.r_[0, np.cumsum(size)]
    for k, p in enumerate(pieces):
        assert naive(p) == bpe.encode_one(vocabulary, p).tolist() == ids[cut[k] : cut[k + 1]].tolist()


def test_round_trip_of_edges(edge, empty):
    encoded = bpe.encode_documents(edge)
    got = encoded.collect()
    assert sorted(str((r.doc_id, None if r.ids is None else r.n_tokens)) for r in got if not r.ids) == sorted(map(str, [(None, None), (1, None), (2, 0)]))
    back = [tuple(r) for r in bpe.decode_documents(encoded).collect()]
    assert sorted(map(str, back)) == sorted(str((a, b)) for a, b in EDGE)
    assert bpe.encode_documents(empty).count() == 0


def test_unknown_id_fails(vocabulary):
    with pytest.raises(ValueError, match="not in the vocabulary"):
        bpe.decode(vocabulary, np.array([vocabulary.size]), np.array([0, 1]))


def _decoded(vocabulary, rows: list) -> list:
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])
    shared = SimpleNamespace(value=vocabulary)
    return [t for b in bpe._decode(shared)(iter([batch.slice(1), batch.slice(0, 1)])) for t in b.column(1).to_pylist()]


@pytest.mark.parametrize("together", [1, 7, 1 << 18])
def test_decoding_in_slices(vocabulary, monkeypatch, together):
    """Nulls, empty rows, rows that aren't UTF-8, and characters that rows share."""
    monkeypatch.setattr(bpe, "DECODED", together, raising=False)
    byte = vocabulary.byte.tolist()
    cut = [byte[b] for b in "é".encode()]
    rows = [cut, None, [], [byte[97]] * 9, cut[:1], cut[1:], None, [byte[255], byte[98]], []]
    want = ["é", None, "", "a" * 9, "�", "�", None, "�b", ""]
    assert _decoded(vocabulary, rows) == want[1:] + want[:1]


def test_decoding_takes_the_memory_of_a_slice(vocabulary):
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.ListArray.from_arrays(pa.array(range(0, 2_000_001, 1000), pa.int32()), pa.array(np.full(2_000_000, vocabulary.byte[97] + 1000, np.int32)))], ["doc_id", "ids"])
    shared = SimpleNamespace(value=vocabulary)
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in bpe._decode(shared)(iter([batch]))) == 2000
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30e6

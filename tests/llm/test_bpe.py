from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from larkspur.llm import bpe
from larkspur.llm.bpe import SHORT, Codec, decode, encode, round_trip

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return Codec(f.read(), PATTERN)


@pytest.fixture(scope="module")
def other(own):
    return tiktoken.Encoding("other", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def plain(ranks, word):
    """The leftmost pair of least rank, one after the other."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@pytest.mark.parametrize("all_at_once", [True, False])
def test_recursions(own, monkeypatch, all_at_once):
    """Of short words and, from 8 bytes on, of longer ones, both with all pairs of the least rank at a step and with one."""
    monkeypatch.setattr(bpe, "SHORT", 8)
    assert own.reaches_all()
    monkeypatch.setattr(own, "whole", all_at_once)
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdethinsor", k=rng.randrange(2, 40))).encode() for _ in range(300)] + [b"a" * k for k in range(2, 60)]
    for some in bpe.together(sorted(words, key=len)):
        for w, tokens in zip(some, own.by_recursion(some), strict=True):
            assert tokens.tolist() == plain(own.ranks, w)


def test_a_vocabulary_with_words_out_of_reach():
    """abc is made of ab and c only, but bc goes first: longer words take one pair at a step, and agree with the plain rule."""
    import base64

    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"ab": 257, b"abcd": 258, b"aa": 259, b"aab": 260, b"baa": 261}
    odd_one = Codec(b"\n".join(base64.b64encode(w) + b" " + str(r).encode() for w, r in ranks.items()), PATTERN)
    assert not odd_one.reaches_all()
    rng = random.Random(2)
    words = ["".join(rng.choices("abcd", k=300)).encode() for _ in range(20)]
    assert [t.tolist() for t in odd_one.by_recursion(words)] == [plain(ranks, w) for w in words]


def test_long_words(own, other):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3000)), "x" * 100_000, "\u6f22\u5b57" * 2000, "".join(rng.choices("ACGT", k=5000))]
    for t, raw in zip(words, own.encode(words), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == other.encode_ordinary(t)


def test_clashing_names(odd):
    docs = odd.withColumnRenamed("size", "n_tokens").withColumnRenamed("n_chars", "n_tokens_").withColumnRenamed("kept", "ids")
    coded = encode(docs, PATH, PATTERN)
    assert set(coded.columns) == {*docs.columns, "n_tokens__", "ids_"} - {"text"}
    assert {r["n_tokens__"] for r in coded.collect()} == {r["size"] for r in odd.select("size").collect()}


def test_texts(own, other, odd_texts):
    texts = [t or "" for t in odd_texts] + ["a" * (SHORT + 50), " " * 700 + "x\n\n\ny", "it's 12345 we'll<|endoftext|>", "\u0928\u092e\u0938\u094d\u0924\u0947 \U0001f600"]
    ids = own.encode(texts)
    for t, raw in zip(texts, ids, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == other.encode_ordinary(t)
    assert own.decode(ids) == [t.encode() for t in texts]


def test_unknown_ids(own):
    with pytest.raises(ValueError):
        own.decode([np.array([60_000], "<u4").tobytes()])


def test_rows(odd, empty, other):
    got = sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(odd, PATH, PATTERN).collect())))
    want = []
    for r in odd.select("doc_id", "text").collect():
        ids = other.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(map(str, want))
    coded = encode(odd, PATH, PATTERN)
    assert set(coded.columns) == {*odd.columns, "ids", "n_tokens"} - {"text"}
    back = decode(coded, PATH, PATTERN).collect()
    assert sorted(str((r.doc_id, bytes(r.decoded))) for r in back) == sorted(str((r.doc_id, (r.text or "").encode())) for r in odd.select("doc_id", "text").collect())
    assert round_trip(empty, PATH, PATTERN).collect() == [] and encode(empty, PATH, PATTERN).collect() == []

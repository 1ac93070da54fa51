from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import hmm


def model(seed, states=3, classes=7):
    rng = np.random.default_rng(seed)
    part = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(rng.gamma(1.0, 1.0, shape))
    return hmm.Model(part(states), part(states, states), part(states, classes))


def test_forward_is_the_sum_over_paths():
    m, rng = model(1), np.random.default_rng(2)
    for n in (1, 2, 5, 7):
        s = rng.integers(0, 7, n)
        total = 0.0
        for path in itertools.product(range(3), repeat=n):
            p = m.start[path[0]] * m.emit[path[0], s[0]]
            for t in range(1, n):
                p *= m.move[path[t - 1], path[t]] * m.emit[path[t], s[t]]
            total += p
        assert abs(m.log10(s) - math.log10(total)) < 1e-9


def test_many_at_a_time_and_long():
    m, rng = model(3), np.random.default_rng(4)
    some = [rng.integers(0, 7, n) for n in (5, 1, 9, 3, 9, 20_000)]
    assert np.allclose(m.log10s(some), [m.log10(s) for s in some], rtol=0, atol=1e-6) and np.isfinite(m.log10s(some)).all()


def test_baum_welch_counts_and_ascent():
    m, rng = model(5), np.random.default_rng(6)
    some = [rng.integers(0, 7, n) for n in (4, 6, 1, 30, 12)]
    start, move, emit, log10 = m.expected(some)
    assert abs(start.sum() - 5) < 1e-9 and abs(move.sum() - sum(len(s) - 1 for s in some)) < 1e-9
    assert np.allclose(emit.sum(0), np.bincount(np.concatenate(some), minlength=7))
    # The counts of parts add up to those of the whole.
    a, b = m.expected(some[:2]), m.expected(some[2:])
    assert all(np.allclose(x + y, z) for x, y, z in zip(a, b, (start, move, emit, log10), strict=True))
    assert abs(log10[0] - m.log10s(some).sum()) < 1e-9
    again = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
    assert again.log10s(some).sum() >= m.log10s(some).sum()


def plain_counts(m, s):
    """Forward-backward with a whole list of messages."""
    alphas, scales = [], []
    for t, c in enumerate(s):
        a = (m.start if t == 0 else alphas[-1] @ m.move) * m.emit[:, c]
        scales.append(a.sum())
        alphas.append(a / a.sum())
    beta, move, emit = np.ones(len(m.start)), np.zeros_like(m.move), np.zeros_like(m.emit)
    for t in range(len(s) - 1, -1, -1):
        gamma = alphas[t] * beta
        emit[:, s[t]] += gamma / gamma.sum()
        if t:
            ahead = m.emit[:, s[t]] * beta / scales[t]
            move += m.move * np.outer(alphas[t - 1], ahead)
            beta = m.move @ ahead
    return gamma / gamma.sum(), move, emit, np.log10(scales).sum(keepdims=True)


@pytest.mark.parametrize("kept", [hmm.KEPT, 1])
def test_long_texts_train_whole(monkeypatch, kept):
    """As by a plain forward-backward, whether all messages are kept or made anew by segments."""
    monkeypatch.setattr(hmm, "KEPT", kept)
    m, rng = model(7), np.random.default_rng(8)
    some = [rng.integers(0, 7, n) for n in (20_000, 3, 256, 257, 1, 700)]
    want = [sum(x) for x in zip(*(plain_counts(m, s) for s in some), strict=True)]
    assert all(np.allclose(x, y, rtol=1e-9) for x, y in zip(m.expected(some), want, strict=True))


def test_counts_of_64_bits():
    some = np.array([0, 1, 254, 255, 256, 2**32, 2**53, 255, 3])
    assert (hmm.unpacked(hmm.packed(some)) == some).all() and len(hmm.unpacked(hmm.packed(some[:0]))) == 0


def whole_score(rows, passes):
    """The model and the scores made anew, in one process and from plain words."""
    import xxhash

    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    low = [[w.encode("utf-8", "surrogatepass") for w in words(r.text)] for r in rows]
    c = Counter(w for r, ws in zip(rows, low, strict=True) if not out(r.doc_id) for w in ws)
    classes, of = hmm.CLASSES[0], lambda w: xxhash.xxh64_intdigest(w) % hmm.CLASSES[0] + 1
    tokens, distinct = np.zeros(classes + 1), np.zeros(classes + 1)
    for w, n in c.items():
        tokens[of(w)] += n
        distinct[of(w)] += 1
    every = tokens.copy()
    every[0] = sum(not out(r.doc_id) for r in rows)
    m, seqs = hmm.Model.first(hmm.STATES, every), [np.array([*map(of, ws), 0]) for ws in low]
    for _ in range(passes):
        start, move, emit, _ = (sum(x) for x in zip(*(plain_counts(m, s) for r, s in zip(rows, seqs, strict=True) if not out(r.doc_id)), strict=True))
        m = m.maximised(start, move, emit, every)
    return [plain_counts(m, s)[3][0] + sum(math.log10((c[w] + 1) / (tokens[of(w)] + distinct[of(w)] + 1)) for w in ws) for s, ws in zip(seqs, low, strict=True)]


def test_score_end_to_end(odd):
    rows = odd.select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), s) for r, s in zip(rows, whole_score(rows, 2), strict=True))
    got = sorted((str(r.doc_id), r.score) for r in hmm.score(odd, passes=2).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-4)


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


@pytest.mark.parametrize("small", [False, True])
def test_base_and_counts(odd, monkeypatch, small):
    """Also with many blocks and ranges of words."""
    if small:
        monkeypatch.setattr(hmm, "BLOCK_WORDS", 10)
        monkeypatch.setattr(hmm, "PER_BUCKET", 40)
    rows = odd.select("doc_id", "text").collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for r in rows if not out(r.doc_id) for w in [*words(r.text), None])
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        ts = [*words(r.text), None]
        want.append((str(r.doc_id), out(r.doc_id), len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 4)))
    got = hmm.score(odd, passes=2).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_beats_the_base_on_held_out_texts(spark):
    rows = hmm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.97 * sum(r.base_score for r in rows)


def test_no_training_text(spark, empty):
    docs = spark.createDataFrame([(i, "a b c") for i in range(30) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    got = hmm.score(docs).collect()
    assert got and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert hmm.score(empty).collect() == []

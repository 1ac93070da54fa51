from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm.exact_dedup import PRIMES, Polynomial, drop_copies, exact_dedup


def low(t):
    return (t or "").encode().lower()


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    return {k: (max((x for x in v if x is not None), default=None), len(v)) for k, v in groups.items()}


@given(st.binary(max_size=60), st.binary(max_size=60))
@settings(max_examples=60, deadline=None)
def test_fingerprints_compose(a, b):
    for p in (*PRIMES, 101):
        h = Polynomial(p, 37, 16)
        of = lambda x: h.of(np.frombuffer(x, np.uint8).astype(np.uint64) + np.uint64(1))  # noqa: B023, E731
        assert h.joined(of(a), of(b), len(b)) == of(a + b)
        assert (h.shifted(of(a), len(b)) + of(b)) % p == of(a + b)


@pytest.mark.parametrize("options", [{}, {"huge": 64, "chunk": 16}, {"primes": (2, 3)}, {"primes": (5, 1)}])
def test_against_brute_force(odd, options):
    """Also with documents hashed in parallel, and with fingerprints that collide."""
    source = odd.select("doc_id", "text").collect()
    want = brute(source)
    got = exact_dedup(odd, **options).collect()
    assert len(got) == len(source)
    texts = {hashlib.sha256(k).hexdigest(): v for k, v in want.items()}
    kept = defaultdict(int)
    for r in got:
        assert (r.keep_id, r.group_size) == texts[r.text_sha256]
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and set(kept) == set(texts)


def test_dropped_rows(odd):
    out = drop_copies(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert len(rows) == len(brute(odd.select("doc_id", "text").collect())) == len({low(r.text) for r in rows})


def test_empty(empty):
    assert exact_dedup(empty).collect() == [] and drop_copies(empty).columns == empty.columns

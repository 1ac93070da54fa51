from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from larkspur.llm import jaccard_join as j


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < width else zip(*(w[k:] for k in range(width)), strict=False)) if w else frozenset()


def brute(texts, percent=75):
    """Component (least index) of each text."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        meet = Counter(k for x in s for k in where[x])
        for k, o in meet.items():
            if 100 * o >= percent * (len(s) + len(sets[k]) - o):
                a, b = find(i), find(k)
                root[max(a, b)] = min(a, b)
        for x in s:
            where[x].append(i)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(rng, words, share):
    out = list(words)
    for k in rng.sample(range(len(out)), max(1, int(len(out) * share))):
        out[k] = f"e{rng.randrange(10**6)}"
    return out


def corpus(seed):
    """Chains, groups of near copies, copies, a passage that many share, short texts."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for n in (12, 30, 80, 200):
        base = rng.choices(vocabulary, k=n)
        chain = base
        for _ in range(6):
            texts.append(" ".join(edited(rng, base, rng.choice((0.01, 0.03, 0.05)))))
            chain = edited(rng, chain, 0.02)
            texts.append(" ".join(chain))
        texts += [" ".join(base), " ".join(base).upper(), "\n".join(base)]
    for n in (5, 10, 20, 60, 100):
        texts += [" ".join([*rng.choices(vocabulary, k=n), *passage, *rng.choices(vocabulary, k=n // 2)]) for _ in range(8)]
    texts += ["a b", "a b", "A  b", "a b c", "", None, "  ", "one two three four five", "one two three four five six"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(j, "BLOCK", 1500)
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.jaccard_components(docs).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_all_links(spark, monkeypatch):
    """Every link is counted and given, within components and over the parts of a large one."""
    monkeypatch.setattr(j, "CELL", 6000)
    monkeypatch.setattr(j, "TILE", 7)
    rng = random.Random(4)
    base = rng.choices([f"v{i}" for i in range(3000)], k=90)
    texts = corpus(3) + [" ".join(edited(rng, base, rng.choice((0.01, 0.03)))) for _ in range(60)]
    sets = [shingles(t) for t in texts]
    link = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    want = [sum(bool(a) and link(a, b) for k, b in enumerate(sets) if k != i) for i, a in enumerate(sets)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in j.jaccard_join(docs).collect()}
    assert [got[i].n_links for i in range(len(texts))] == want and max(want) > 20
    of = {got[i].set_id: s for i, s in enumerate(sets)}
    distinct = sorted(of)
    pairs = {frozenset((a, b)) for k, a in enumerate(distinct) for b in distinct[:k] if of[a] and of[b] and link(of[a], of[b])}
    found = [frozenset(r) for r in j.jaccard_pairs(docs).collect()]
    assert len(found) == len(pairs) and set(found) == pairs


def test_hot_group_without_all_pairs(spark):
    """A third of the rows are near copies: the pairs that are counted stay near the number of rows."""
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(5000)]
    base = rng.choices(vocabulary, k=120)
    texts = [" ".join(edited(rng, base, 0.01)) for _ in range(150)] + [" ".join(rng.choices(vocabulary, k=100)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted, real = [], j.linked

    def linked(pairs, nodes, percent):
        counted.append(pairs.count())
        return real(pairs, nodes, percent)

    j.linked = linked
    try:
        got = {r.doc_id: r.component_id for r in j.jaccard_components(docs).collect()}
    finally:
        j.linked = real
    assert all(got[i] == 0 for i in range(150)) and all(got[i] == i for i in range(150, 450))
    assert sum(counted) < 600


def test_odd(odd, empty):
    source = odd.select("doc_id", "text").collect()
    got = j.jaccard_components(odd).collect()
    assert len(got) == len(source)
    want = brute([r.text for r in source])
    classes = defaultdict(list)
    for (n, c), r in zip(want, source, strict=True):
        classes[c].append((r.doc_id, n))
    least = {c: min((i for i, _ in v if i is not None), default=None) for c, v in classes.items()}
    expected = Counter((r.doc_id, n, least[c]) for (n, c), r in zip(want, source, strict=True))
    # Texts without shingles stay alone: repeated rows of them keep their own id.
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected
    out = j.one_of_each(odd)
    assert out.columns == odd.columns and out.count() == len(classes)
    assert j.jaccard_components(empty).collect() == [] and j.one_of_each(empty).collect() == []


def test_prefix_bound():
    """Two sets that link share one of their first shingles in any common order."""
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randrange(4, 60)
        a = set(rng.sample(range(200), n))
        b = set(rng.sample(sorted(a), max(1, int(n * rng.uniform(0.7, 1))))) | set(rng.sample(range(200, 300), rng.randrange(0, n // 3 + 1)))
        o = len(a & b)
        if 100 * o >= 75 * (len(a) + len(b) - o):
            need = -(-75 * (len(a) + len(b)) // 175)
            assert set(sorted(a)[: len(a) - need + 1]) & set(sorted(b)[: len(b) - need + 1])


def test_shingles():
    s = j.Shingler()
    assert len(s.of("a b c d e f a b c d e f")) == len(shingles("a b c d e f a b c d e f"))
    assert np.array_equal(s.of("A b\tc d e"), s.of("a B c\x0bD e")) and not np.array_equal(s.of("a b"), s.of("b a")) and len(s.of("a")) == 1


def test_components_go_on_from_stars(spark):
    """Components of some edges and then of more are those of all, as brute force gives them."""
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(k, k + 1) for k in range(300, 340)] + [(400, k) for k in range(401, 440)]
    rng.shuffle(edges)
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: r for x, r in root.items() if x != r}
    frame = lambda rows: spark.createDataFrame(rows, "_a long, _b long")
    some = j.components(frame(edges[:90]))
    assert {r._node: r._comp for r in j.components(frame(edges[90:]), some).collect()} == want
    assert {r._node: r._comp for r in j.components(frame(edges)).collect()} == want


def test_rounds_end_with_the_work(spark, monkeypatch):
    """Links that are stars already take no round, and no links add no components."""
    written, real = [], j.checkpointed
    monkeypatch.setattr(j, "checkpointed", lambda df: written.append(df.columns) or real(df))
    stars = spark.createDataFrame([(k, 0) for k in range(1, 30)] + [(50, 40)], "_a long, _b long")
    assert {r._node: r._comp for r in j.components(stars).collect()} == {**{k: 0 for k in range(1, 30)}, 50: 40}
    assert len(written) == 1
    nodes = spark.createDataFrame([], "_node long, _n long, _list binary")
    assert j.linked(spark.createDataFrame([], "_a long, _b long"), nodes, 75).collect() == [] and len(written) == 2


def test_shuffles_are_let_go_between_rounds(spark, monkeypatch):
    """Each round lets go what the one before has shuffled, as what it found is written by then."""
    did, written, tidied = [], j.checkpointed, j.tidy
    monkeypatch.setattr(j, "checkpointed", lambda df: did.append("written") or written(df))
    monkeypatch.setattr(j, "tidy", lambda spark: did.append("tidied") or tidied(spark))
    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "_a long, _b long")
    assert {r._node: r._comp for r in j.components(path).collect()} == dict.fromkeys(range(1, 41), 0)
    assert len(did) > 4 and did == ["written", "tidied"] * (len(did) // 2)


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_partners_in_several_cells(spark, monkeypatch, broadcast):
    """A node with more partners than a cell takes meets them all, whether the pairs are broadcast or shuffled."""
    monkeypatch.setattr(j, "MEMBERS", 3)
    monkeypatch.setattr(j, "BROADCAST_PAIRS", broadcast)
    texts = corpus(1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in j.jaccard_components(docs).collect()} == dict(enumerate(brute(texts)))

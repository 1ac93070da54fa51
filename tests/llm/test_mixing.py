from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import mixing
from larkspur.llm.mixing import mix, mixed_rows, rounded, targets


def water_fill(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        if not rest:
            return {s: most * sizes[s] for s in order}
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in rest)
        over = {s for s in rest if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets(spark):
    for words in ([10, 1000, 5, 70, 3000], [1, 1, 1], [0, 0], [100], [5, 0, 900, 900]):
        names = [None if i == 1 else f"s{9 - i}" for i in range(len(words))]
        got = {r["_source"]: r["_target"] for r in targets(spark.createDataFrame(list(zip(names, words, strict=True)), "_source string, _words long")).collect()}
        want = water_fill(dict(zip(names, words, strict=True)))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)


def test_odd(odd):
    source = odd.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in source:
        sizes[r.source] += size(r.text)
    want = water_fill(sizes)
    got = mix(odd).collect()
    assert sorted(str((r.doc_id, r.size)) for r in got) == sorted(str((r.doc_id, size(r.text))) for r in source)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by_target = {round(v, 3) for v in want.values()}
    assert {round(r.target, 3) for r in got} <= by_target
    assert sorted(map(str, got)) == sorted(map(str, mix(odd).collect()))


def test_sources_come_near_their_targets(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.sum(F.col("rate") * F.col("size")).alias("e")).collect()
    for r in rows:
        assert abs(r.t - r.g) <= max(5, 0.005 * r.g) and abs(r.e - r.g) <= 1e-5 * r.g


def test_rates_are_tilted(spark):
    """Above 1 longer documents weigh more, below 1 less; all meet the target."""
    docs = spark.createDataFrame([(i, "w " * (i % 50 + 1), "a" if i < 500 else "b") for i in range(1000)], "doc_id long, text string, source string")
    rows = mix(docs, weights=(4.0, 1.0), share=1.0).collect()
    for s, ids in (("a", range(500)), ("b", range(500, 1000))):
        by = sorted({(r["size"], round(r.rate, 9)) for r in rows if r.doc_id in ids})
        rates = [x for _, x in by]
        assert rates == sorted(rates, reverse=s == "b") and len(set(rates)) > 10


def test_rounding_hands_on():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 1000, 400))[::-1]
    rates = rng.uniform(0.2, 1.8, 400)
    copies = rounded(sizes, rates, 2)
    assert set(copies) <= {0, 1, 2} and abs((copies * sizes).sum() - (rates * sizes).sum()) <= 5


def test_rows_and_empty(odd, empty):
    taken = {}
    n = sum(r.copies for r in mix(odd).collect())
    out = mixed_rows(odd)
    assert out.columns == odd.columns and out.count() == n and not taken
    assert mix(empty).collect() == [] and mixed_rows(empty).collect() == []


def test_reruns_agree_over_other_partitions(spark, monkeypatch):
    """Ids that repeat, ids that are missing and sources of many blocks too."""
    monkeypatch.setattr(mixing, "BLOCK", 20)
    rows = [(None if i % 50 == 0 else i // 2 if i % 7 == 0 else i, " ".join(["w"] * (i * 37 % 60) + [str(i % 90)]), ("a", "b", None, "d")[i * i % 11 % 4]) for i in range(1500)]
    docs = spark.createDataFrame([*rows, *rows[:100]], "doc_id long, text string, source string")
    taken = lambda n, by: sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.source_size, r.target, r.taken) for r in mix(docs.repartition(n, by)).collect())
    assert taken(3, "text") == taken(7, "doc_id")

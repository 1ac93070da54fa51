from __future__ import annotations

import zlib

import numpy as np

from larkspur.llm import quality_classifier as q


def test_ftrl_is_the_closed_form():
    """One update from rest: w = -(g - sign(g) l1) / ((beta + |g|) / alpha + l2)."""
    m = q.Ftrl(4, alpha=0.5, beta=1.0, l1=0.01, l2=0.1)
    m.learn(np.array([3]), np.array([0.8]), 1.0)
    g = -0.5 * 0.8
    w = -(g + 0.01) / ((1 + abs(g)) / 0.5 + 0.1)
    assert abs(m.weights(np.array([3]))[0] - w) < 1e-12 and (m.weights(np.array([0, 1, 2])) == 0).all()


def test_features():
    slots, values = q.Hasher(20).features("The cat the CAT")
    again, _ = q.Hasher(20).features("the cat THE cat")
    assert np.array_equal(slots, again) and abs((values**2).sum() - 1) < 1e-12 and (np.diff(slots) > 0).all()
    assert len(q.Hasher(20).features("  \n")[0]) == 0


def test_held_out_accuracy(spark, sf):
    d = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = q.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    for label in (0, 1):
        some = [r for r in rows if r.quality == label]
        assert sum(r.predicted == label for r in some) >= 0.97 * len(some)


def test_folds_and_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(25)] + [(3, 1, "x"), (None, 1, "x"), (900, None, "x")], "doc_id long, quality int, text string")
    got = q.classify(odd, labels).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    # Labels of the held-out fold change nothing.
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert sorted(map(str, got)) == sorted(map(str, q.classify(odd, flipped).collect()))
    assert q.classify(empty, labels).collect() == []
    assert {r.score for r in q.classify(odd, labels.limit(0)).collect()} == {0.5}

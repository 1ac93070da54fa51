from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import tiktoken

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from larkspur.llm.queries import oracle_sql  # noqa: E402
from tests.llm.test_jaccard_join import brute as components  # noqa: E402
from tests.llm.test_mixing import size, water_fill  # noqa: E402


def staged(spark, docs):
    """The rows after each stage."""
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
        rows = docs.collect()
        out.append(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, second, third, fourth, last = staged(spark, docs)
    columns = docs.columns
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    kept = {i for (i,) in base.execute(f"SELECT doc_id FROM ({oracle_sql()['op9_quality_rules']}) WHERE kept").fetchall()}
    assert {r.doc_id for r in first} == kept and len(first) == len(kept) and 0.8 * docs.count() < len(kept) + docs.count() * 0.2
    assert all(list(r.asDict()) == columns for stage in (first, second, third, fourth) for r in stage)
    best = {}
    for r in first:
        k = (r.text or "").encode().lower()
        best[k] = max(best.get(k, -1), r.doc_id)
    assert {r.doc_id for r in second} == set(best.values())
    ordered = sorted(second, key=lambda r: r.doc_id)
    roots = {c for _, c in components([r.text for r in ordered])}
    assert {r.doc_id for r in third} == {ordered[c].doc_id for c in roots}
    words = defaultdict(int)
    for r in third:
        words[r.source] += size(r.text)
    goals, taken, copies = water_fill(words), defaultdict(int), Counter(r.doc_id for r in fourth)
    for r in fourth:
        taken[r.source] += size(r.text)
    assert max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in third}
    small = {s: min(size(r.text) for r in third if r.source == s) for s in goals}
    assert all(abs(taken[s] - goals[s]) <= max(small[s], 0.02 * goals[s]) for s in goals)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        from larkspur.llm.bpe import read_ranks

        enc = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})
    text = {r.doc_id: r.text for r in fourth}
    assert Counter(r.doc_id for r in last) == copies
    assert all(r.ids == enc.encode_ordinary(text[r.doc_id] or "") and r.n_tokens == len(r.ids) for r in last)


def test_run(spark, sf):
    """run() reads and writes between stages; reruns agree."""
    rows = [sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens").collect()) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


def test_odd(spark, odd, empty):
    for docs in (odd, empty):
        stages = staged(spark, docs)
        assert bool(stages[-1]) == bool(docs.count())


def test_clean_documents_stay(spark):
    """Of labelled clean documents of ten words or more nearly all pass the rules; near copies keep one of each group."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").where("quality = 1")
    clean = {r.doc_id for r in docs.join(labels, "doc_id").collect() if size(r.text) >= 10}
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, d).collect()}
    assert len(clean - kept) <= 0.02 * len(clean)


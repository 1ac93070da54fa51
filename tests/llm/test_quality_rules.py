from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from larkspur.llm import quality_rules as q


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(repeated), failed


def test_counts(odd):
    source = odd.select("doc_id", "text").collect()
    got = q.quality_rules(odd).collect()
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    want = sorted(((i, *brute(t)) for i, t in source), key=key)
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key)
    assert have == want
    assert all(not r.kept for r in got if r.base_failed)


def test_sketch_quantiles_and_merge(spark):
    """Quartiles within the sketch's error; merging is adding."""
    values = [(i % 97 + 1) / 10 for i in range(5000)]
    rows = spark.createDataFrame([("en" if i % 2 else "de", "s", v) for i, v in enumerate(values)], "_lang string, _source string, v double")
    sketch = rows.select("_lang", "_source", F.lit("r").alias("_ratio"), q.bucket(F.col("v")).alias("_bucket")).groupBy("_lang", "_source", "_ratio", "_bucket").agg(F.count(F.lit(1)).alias("_count"))
    got = q.quartiles(q.merged(sketch)).first()
    ordered = sorted(values)
    assert got["_n"] == 5000
    for x, share in ((got["_q1"], 0.25), (got["_q3"], 0.75)):
        exact = ordered[int(5000 * share) - 1]
        assert abs(x - exact) <= 1.01 * q.ALPHA * exact


def test_adaptive(spark):
    """The same document passes where its like is common, and fails where it stands out."""
    plain = lambda i: " ".join(f"w{(i * 7 + k * k) % 997}x{k}" for k in range(40))
    symbols = lambda i: " ".join(f"#{(i * 5 + k * k) % 991}#y{k}" for k in range(40))
    rows = [(i, plain(i), "en", "prose") for i in range(100)] + [(200 + i, symbols(i), "en", "code") for i in range(100)] + [(400, symbols(7), "en", "prose"), (401, symbols(8), "en", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in q.quality_rules(docs).collect()}
    assert all(kept[i] for i in range(100)) and all(kept[200 + i] for i in range(100)) and not kept[400]
    assert {r.doc_id for r in q.keep_good(docs).collect()} == {i for i, k in kept.items() if k}


def test_kept_rows_keep_columns(odd, empty):
    assert q.keep_good(odd).columns == odd.columns
    assert q.quality_rules(empty).collect() == [] and q.keep_good(empty).collect() == []


def test_clean_and_junk(spark):
    """Labelled documents of the test data: nearly all clean ones of ten words or more stay, nearly all junk goes."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = q.quality_rules(spark.read.parquet(f"{d}/documents.parquet")).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import scores, text, trigram, vectors


def grams(s):
    words = "".join(c if c.isalnum() else " " for c in s.lower()).split()
    return [{f"  {w} "[i : i + 3] for i in range(len(w) + 1)} for w in words]


def jaccard(a, b):
    return float(__import__("numpy").float32(len(a & b) / len(a | b))) if a | b else 0.0


def strict(q, v):
    g, words = set().union(*grams(q)), grams(v)
    return max((jaccard(g, set().union(*words[i : j + 1])) for i in range(len(words)) for j in range(i, len(words))), default=0.0)


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


@pytest.mark.parametrize(("a", "b", "sim"), [("word", "two words", 0.363636), ("lptop", "laptop", 0.444444), ("botle", "bottle", 0.625), ("lptop", "Lenovo Gaming Laptop High Performance Elite", 0.088889), ("", "", 0.0)])
def test_similarity(spark, a, b, sim):
    got = one(spark, s=trigram.similarity(F.lit(a), F.lit(b)), t=trigram.similarity(F.lit(b), F.lit(a)), w=trigram.strict_word_similarity(F.lit(a), F.lit(b)))
    assert abs(got.s - sim) < 1e-6 and got.s == got.t and got.w >= got.s
    assert abs(got.w - strict(a, b)) < 1e-9


def test_strict_golden(spark):
    assert abs(one(spark, s=trigram.strict_word_similarity(F.lit("word"), F.lit("two words"))).s - 0.571429) < 1e-6
    assert not one(spark, s=F.lit(7 / 20).cast("float").cast("double") >= 0.35).s


@given(st.lists(st.tuples(st.text("ab c-", max_size=8), st.text("ab c-", max_size=12)), min_size=1, max_size=25))
@settings(max_examples=8, deadline=None)
def test_similarity_properties(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", trigram.similarity(F.col("a"), F.col("b")).alias("s"), trigram.strict_word_similarity(F.col("a"), F.col("b")).alias("w")).collect()
    for r in rows:
        assert 0 <= r.s <= 1 and r.s <= r.w <= 1
        assert r.s == jaccard(set().union(*grams(r.a)), set().union(*grams(r.b))) and r.w == strict(r.a, r.b)


def test_text(spark):
    got = one(spark, s=text.strip(F.lit("\t a b\n")), t=text.tokens(F.lit(" Nik\tSHOSE \n")), g=text.tag_list(F.lit("a, B c ,,")), k=text.name_key(F.lit("  ALPHA \t mug ")), n=text.tokens(F.lit(None).cast("string")))
    assert (got.s, got.t, got.g, got.k, got.n) == ("a b", ["nik", "shose"], ["a", "b c"], "alpha mug", [])


@pytest.mark.parametrize(("value", "part", "want"), [("Cold Widget", "WID", True), ("a100%b", "100%", True), ("axb", "a_b", True), ("a\\b", "a\\b", True), ("ab", "a\\b", False), ("a%b", "a\\%b", True), ("axxb", "a%b", True), ("x\\", "\\", True), ("", "a", False)])
def test_has(spark, value, part, want):
    rows = spark.createDataFrame([(value, part)], "v string, p string")
    assert rows.select(text.has(F.col("v"), part).alias("x")).first().x is want
    assert rows.select(text.has(F.col("v"), F.col("p")).alias("x")).first().x is want


def test_scores(spark):
    field = lambda *v: [F.lit(x) for x in v]
    case = lambda q, *v: one(spark, x=scores.exact_score(F.lit(q), *field(*v))).x
    row = ("Wireless Headphones", "Sony", "Audio", "headphones,wireless,audio")
    assert [case(q, *row) for q in ("wireless headphones", " SONY ", "audio", "headphones", "headphones wireless", "x", "")] == [1.0, 0.85, 0.75, 0.70, 0.90, 0.0, 0.0]
    assert case("nike shoes", "Nike Running Shoes", "B", "C", "t") == 0.80
    part = lambda q, *v: one(spark, x=scores.partial_score(F.lit(q), *field(*v))).x
    assert abs(part("samsng phone", "Samsung Phone Case Magnetic", "Samsung", "Phone Accessories", "phone case,magnetic,samsung") - 0.35475) < 1e-9
    assert part("", *row) == 0.0 and part("a", "", "", "", "") == 0.0


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    got = one(spark, d=vectors.dot(v(1.0, 2.0), v(3.0, 4.0)), u=vectors.unit(v(3.0, 4.0)), z=vectors.unit(v(0.0, 0.0)))
    assert got.d == 11 and all(math.isclose(a, b) for a, b in zip(got.u, (0.6, 0.8), strict=True)) and got.z == [0.0, 0.0]

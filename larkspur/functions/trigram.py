"""Trigrams: similarity, and strict word similarity by word-aligned extents.

A word is a run of letters and digits, padded with two blanks before and one after. Ratios are narrowed to single precision and
widened again, so thresholds see the values that single-precision results have.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_grams(c: Column) -> Column:
    """The trigrams of each word."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))


def grams(c: Column) -> Column:
    return F.array_distinct(F.flatten(word_grams(c)))


def ratio(shared: Column, a: Column, b: Column) -> Column:
    return F.when(a + b - shared > 0, shared / (a + b - shared)).otherwise(0.0).cast("float").cast("double")


def gram_similarity(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def similarity(a: Column, b: Column) -> Column:
    return gram_similarity(grams(a), grams(b))


def strict_over(query_grams: Column, by_word: Column) -> Column:
    """The best similarity of the query with a run of neighbouring words."""
    n = F.size(by_word)
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_max(F.transform(F.sequence(i, n), lambda j: gram_similarity(query_grams, F.array_distinct(F.flatten(F.slice(by_word, i, j - i + 1)))))))
    return F.when(n > 0, F.coalesce(F.array_max(runs), F.lit(0.0))).otherwise(0.0)


def strict_word_similarity(query: Column, c: Column) -> Column:
    return strict_over(grams(query), word_grams(c))

"""Scores of a product for a query. All are in [0, 1]; operations keep one order so that results can be compared bit by bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import folded, tag_list, tokens

#: Weights of the signals.
EXACT, PARTIAL, FUZZY, SEMANTIC = 0.20, 0.15, 0.30, 0.35
#: The gate for results without a strong lexical signal, and the fuzzy score that is one.
RELAXED_GATE, STRONG_FUZZY = 0.15, 0.30


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def exact_score(query: Column, name: Column, brand: Column, category: Column, tags: Column) -> Column:
    """The first rule that holds, in this order; a tag hit stands before the token-set rules."""
    q, q_set, n_set = folded(query), tokens(query), tokens(name)
    return (
        F.when(q == "", 0.0)
        .when(q == folded(name), 1.0)
        .when(q == folded(brand), 0.85)
        .when(q == folded(category), 0.75)
        .when(F.array_contains(tag_list(tags), q), 0.70)
        .when(subset(q_set, n_set) & subset(n_set, q_set), 0.90)
        .when(subset(q_set, n_set), 0.80)
        .otherwise(0.0)
    )


def token_field_score(query_tokens: Column, words: Column) -> Column:
    """The mean over query tokens of the best match among words: whole, prefix, or part."""

    def match(t: Column, w: Column) -> Column:
        share = F.length(t) / F.length(w)
        return F.when(t == w, 1.0).when(w.startswith(t) & (F.length(t) >= 2), 0.85 * F.greatest(F.lit(0.70), share)).when(w.contains(t) & (F.length(t) >= 3), 0.50 * F.greatest(F.lit(0.60), share)).otherwise(0.0)

    best = F.transform(query_tokens, lambda t: F.coalesce(F.array_max(F.transform(words, lambda w: match(t, w))), F.lit(0.0)))
    return F.when((F.size(query_tokens) > 0) & (F.size(words) > 0), F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(query_tokens)).otherwise(0.0)


def partial_score(query: Column, name: Column, brand: Column, category: Column, tags: Column) -> Column:
    q = tokens(query)
    total = token_field_score(q, tokens(name)) * 0.50 + token_field_score(q, tokens(brand)) * 0.25 + token_field_score(q, tokens(category)) * 0.15 + token_field_score(q, tag_list(tags)) * 0.10
    return clamp(total)


def fuzzy_score(token_scores: Column, full: Column) -> Column:
    """From the scores of the query's tokens and of the whole query against the name."""
    n = F.size(token_scores)
    mean = F.aggregate(token_scores, F.lit(0.0), lambda a, x: a + x) / n
    coverage = F.size(F.filter(token_scores, lambda x: x >= 0.15)) / n
    return F.when(n == 1, token_scores[0] * 0.75 + full * 0.25).otherwise(mean * 0.60 + mean * coverage * 0.25 + full * 0.15)


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def final_score(exact: Column, partial: Column, fuzzy: Column, semantic: Column) -> Column:
    return EXACT * exact + PARTIAL * partial + FUZZY * fuzzy + SEMANTIC * semantic


def gate(exact: Column, partial: Column, fuzzy: Column, least: float) -> Column:
    """The least final score that is shown."""
    return F.when((exact > 0) | (partial > 0) | (fuzzy >= STRONG_FUZZY), least).otherwise(RELAXED_GATE)

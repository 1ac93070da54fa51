"""Candidate sources: exact, partial, fuzzy (a ladder of three rungs) and semantic. Every limit has a total order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import scores
from larkspur.functions.text import has, like_pattern
from larkspur.functions.trigram import grams, ratio, strict_over, word_grams
from larkspur.functions.vectors import dot, unit
from larkspur.operators.batch import Batch, any_of

#: Candidates of a source, of a lower rung, and the rungs' thresholds.
CANDIDATES, FALLBACK = 50, 200
RUNG_1, RUNG_2, RUNG_3, LEAST_FUZZY = 0.3, 0.1, 0.35, 0.01
#: Rows of values by query that are broadcast at most (some 150 bytes each).
BROADCAST_VALUES = 200_000
FIELDS = ("product_name", "brand", "category", "tags")


def by_shuffle(side: DataFrame) -> DataFrame:
    """A side of a join with all products. Their size is estimated from files in which values that repeat take next to nothing, so that, left
    to the estimate, a catalogue of any number of rows is gathered in the driver and broadcast.
    """
    return side.hint("merge")


def asked_parts(texts: DataFrame, c: str) -> DataFrame:
    """texts with what a search for column c as a part needs: _part and _pattern (both lower-cased, as values are) and _wild."""
    pattern = F.lower(F.concat(F.lit("%"), like_pattern(F.col(c)), F.lit("%")))
    return texts.withColumns({"_part": F.lower(c), "_wild": F.col(c).rlike(r"[%_\\]"), "_pattern": pattern})


def distinct_values(products: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """field and value (lower-cased): what products have in common is looked at once."""
    return products.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lower(f).alias("value")) for f in fields))).alias("v")).select("v.*").where("value is not null").distinct()


def pieces(c: Column, n: Column) -> Column:
    """The distinct runs of n characters; of a shorter text none."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)))).otherwise(F.array().cast("array<string>"))


def values_with(values: DataFrame, asked: DataFrame) -> DataFrame:
    """values: of distinct_values; asked: of asked_parts. The columns of both where the part is in the value, without comparing all with all.

    A value that holds a part holds the first three characters of it (of a shorter part, all): these are joined on, then the part is looked
    for. Only parts with wildcards, few in any batch, are compared with all distinct values.
    """
    probe = F.substring("_part", 1, 3)
    plain = asked.where(~F.col("_wild") & (F.length("_part") > 0)).withColumn("_piece", probe).withColumn("_length", F.length("_piece"))
    every = F.flatten(F.array(*(pieces(F.col("value"), F.lit(n)) for n in (1, 2, 3))))
    # The pieces asked for are bounded by the batch, so the others go before the join.
    cut = values.withColumn("_piece", F.explode(every)).join(F.broadcast(plain.drop("_length")), "_piece").drop("_piece").where(F.col("value").contains(F.col("_part")))
    wild = values.join(F.broadcast(asked.where("_wild")), F.like("value", "_pattern"))
    return cut.unionByName(wild)


def rows_with(products: DataFrame, met: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """met: field, value and others. The others with the id of each product that has a value in its field."""
    pairs = products.select("id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lower(f).alias("value")) for f in fields))).alias("v")).select("id", "v.*")
    return pairs.join(by_shuffle(met), ["field", "value"]).drop("field", "value")


def exact_candidates(products: DataFrame, batch: Batch, limit: int = CANDIDATES) -> DataFrame:
    """query_id, id: the query is the name, brand or category, or a part of the tags."""
    if batch.text is not None:
        q = batch.text.lower()
        found = batch.matching(products, any_of([F.lower(f) == q for f in FIELDS[:3]]) | has(F.col("tags"), q))
        return batch.top(found, limit, F.col("id").asc()).select("query_id", "id")
    asked = asked_parts(batch.frame.select("query_id", "q"), "q")
    whole = distinct_values(products, FIELDS[:3]).join(F.broadcast(asked.select("query_id", F.col("_part").alias("value"))), "value")
    part = values_with(distinct_values(products, ("tags",)), asked)
    met = whole.select("query_id", "field", "value").unionByName(part.select("query_id", "field", "value"))
    return batch.top(rows_with(products, met, FIELDS).distinct(), limit, F.col("id").asc()).select("query_id", "id")


def partial_candidates(products: DataFrame, batch: Batch, limit: int = CANDIDATES) -> DataFrame:
    """query_id, id: a token of two characters or more is part of a field. (A prefix is a part.)"""
    fields = (*FIELDS, "description")
    if batch.text is not None:
        tokens = [t for t in dict.fromkeys(batch.text.lower().split()) if len(t) >= 2]
        few = any_of([has(F.col(f), t) for t in tokens for f in fields]) if len(tokens) <= 8 else F.exists("tokens", lambda t: (F.length(t) >= 2) & any_of([has(F.col(f), t) for f in fields]))
        return batch.top(batch.matching(products, few), limit, F.col("id").asc()).select("query_id", "id")
    # Each distinct token is looked for once. The first rows of a query are among the first of its tokens.
    asked = batch.frame.select("query_id", F.explode(F.array_distinct("tokens")).alias("token")).where(F.length("token") >= 2)
    met = values_with(distinct_values(products, fields), asked_parts(asked.select("token").distinct(), "token")).select("token", "field", "value")
    nth = F.row_number().over(Window.partitionBy("token").orderBy("id"))
    first = rows_with(products, met, fields).distinct().withColumn("_nth", nth).where(F.col("_nth") <= limit).drop("_nth")
    return batch.top(first.join(F.broadcast(asked), "token").select("query_id", "id").distinct(), limit, F.col("id").asc())


def trigram_index(products: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """field, value, gram: an inverted index of the distinct values, on which every product with that value hangs."""
    values = products.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("value")) for f in fields))).alias("v")).select("v.*").distinct()
    return values.select("field", "value", F.explode(grams(F.col("value"))).alias("gram"))


def value_similarities(index: DataFrame, texts: DataFrame) -> DataFrame:
    """index: of trigram_index; texts: text. field, value, text, sim and strict of all that share a trigram; others have 0 of both.

    The texts are those of a batch, whose size is bounded, so their trigrams are broadcast and the index stays where it is.
    """
    wanted = texts.select("text", F.explode(grams(F.col("text"))).alias("gram"))
    shared = index.join(F.broadcast(wanted), "gram").groupBy("field", "value", "text").agg(F.count(F.lit(1)).cast("int").alias("shared"))
    own, other = grams(F.col("value")), grams(F.col("text"))
    return shared.select("field", "value", "text", ratio(F.col("shared"), F.size(own), F.size(other)).alias("sim"), strict_over(other, word_grams(F.col("value"))).alias("strict"))


def query_values(index: DataFrame, batch: Batch) -> DataFrame:
    """query_id, field, value, parts (its score by token), full (of the whole query), and the rungs it reaches."""
    asked = batch.frame.select("query_id", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "text")).unionByName(batch.frame.select("query_id", F.size("tokens").alias("n"), F.lit(-1).alias("at"), F.col("q").alias("text")))
    met = value_similarities(index, asked.select("text").distinct()).join(F.broadcast(asked), "text").withColumn("best", F.greatest("sim", "strict"))
    token = F.col("at") >= 0
    long = token & (F.length("text") >= 3)
    part = F.when(token, F.struct("at", F.when(F.col("field") == "tags", F.col("strict")).otherwise(F.col("best")).alias("x")))
    found = met.groupBy("query_id", "field", "value").agg(
        F.first("n").alias("n"),
        F.map_from_entries(F.collect_list(part)).alias("parts"),
        F.max(F.when(~token, F.col("best"))).alias("full"),
        F.max(long & F.col("field").isin("product_name", "brand") & (F.col("sim") >= RUNG_1)).alias("rung_1"),
        F.max(long & F.col("field").isin("product_name", "brand") & (F.col("sim") >= RUNG_2)).alias("rung_2"),
        F.max(long & (F.col("field") != "tags") & (F.col("strict") >= RUNG_3)).alias("rung_3"),
    )
    return found.withColumn("parts", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("parts", i), F.lit(0.0))))


def fuzzy_scored(products: DataFrame, batch: Batch, index: DataFrame | None = None, n_values: int | None = None, fallback: int | None = FALLBACK) -> DataFrame:
    """query_id, id, rung and fuzzy_score of the candidates of every rung; those of lower rungs are limited to `fallback` before scoring, without one all are scored.

    Products are found by their values that reach a rung. Only candidates then meet the scores of all their values, by one join a field with
    the same table; it is broadcast if the number of distinct values (n_values) says that it is small enough.
    """
    small = n_values is not None and batch.n is not None and batch.n * n_values <= BROADCAST_VALUES
    hint = F.broadcast if small else lambda x: x
    values = query_values(trigram_index(products) if index is None else index, batch)
    values = values.withColumn("value", F.concat_ws(":", "field", "value")).drop("field")
    rungs = ("rung_1", "rung_2", "rung_3")
    reached = values.where(F.col("rung_1") | F.col("rung_2") | F.col("rung_3")).select("query_id", "value", *rungs)
    keyed = lambda f: F.concat(F.lit(f"{f}:"), F.coalesce(F.col(f), F.lit("")))
    pairs = products.select("id", F.explode(F.array(*map(keyed, FIELDS[:3]))).alias("value"))
    met = pairs.join(F.broadcast(reached) if small else by_shuffle(reached), "value").groupBy("query_id", "id").agg(*(F.max(r).alias(r) for r in rungs))
    each = met.select("query_id", "id", F.filter(F.array(*(F.when(F.col(r), F.lit(i + 1)) for i, r in enumerate(rungs))), lambda r: r.isNotNull()).alias("rungs"))
    if fallback is not None:
        each = each.select("query_id", "id", F.explode("rungs").alias("rung"))
        nth = F.row_number().over(Window.partitionBy("query_id", "rung").orderBy("id"))
        each = each.where("rung = 1").unionByName(each.where("rung > 1").withColumn("_nth", nth).where(F.col("_nth") <= fallback).drop("_nth")).select("query_id", "id", F.array("rung").alias("rungs"))
    found = products.select("id", *(keyed(f).alias(f"_{f}") for f in FIELDS)).join(by_shuffle(each), "id")
    known = values.select("query_id", "value", F.struct("parts", "full").alias("_own"))
    for f in FIELDS:
        found = found.join(hint(known.select("query_id", F.col("value").alias(f"_{f}"), F.col("_own").alias(f"_own_{f}"))), ["query_id", f"_{f}"], "left")
    found = found.join(F.broadcast(batch.frame.select("query_id", F.size("tokens").alias("n"))), "query_id")
    at = lambda f, i: F.coalesce(F.get(F.col(f"_own_{f}.parts"), i), F.lit(0.0))
    token_scores = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: at("product_name", i) * 0.50 + at("brand", i) * 0.20 + at("category", i) * 0.15 + at("tags", i) * 0.15)
    scored = found.select("query_id", "id", "rungs", scores.fuzzy_score(token_scores, F.coalesce("_own_product_name.full", F.lit(0.0))).alias("fuzzy_score"))
    return scored.select("query_id", "id", F.explode("rungs").alias("rung"), "fuzzy_score")


def fuzzy_candidates(products: DataFrame, batch: Batch, limit: int = CANDIDATES, min_similarity: float = LEAST_FUZZY, index: DataFrame | None = None, n_values: int | None = None, fallback: int | None = FALLBACK) -> DataFrame:
    """query_id, id, fuzzy_score and rung: the first rung with a row at or above min_similarity."""
    scored = fuzzy_scored(products, batch, index, n_values, fallback).where(F.col("fuzzy_score") >= min_similarity)
    # Each rung is cut to the limit where its rows lie, before the first rung is looked for among the few that are left.
    nth = F.row_number().over(Window.partitionBy("query_id", "rung").orderBy(F.col("fuzzy_score").desc(), F.col("id").asc()))
    few = scored.withColumn("_nth", nth).where(F.col("_nth") <= limit).drop("_nth")
    return few.withColumn("_first", F.min("rung").over(Window.partitionBy("query_id"))).where("rung = _first").drop("_first")


def similarities(embeddings: DataFrame, batch: Batch) -> DataFrame:
    """query_id, id and semantic_score (not clamped) of every vector; the queries' vectors are brought to unit length."""
    vectors = batch.frame.where("vector is not null").select("query_id", unit(F.col("vector")).alias("_vector"))
    return embeddings.join(F.broadcast(vectors), F.size("embedding") == F.size("_vector")).select("query_id", "id", dot(F.col("embedding"), F.col("_vector")).alias("semantic_score"))


#: Scores of a blocked product that differ by less may stand in another order.
ROUNDING = 1e-9


def nearest(embeddings: DataFrame, batch: Batch, limit: int) -> DataFrame:
    """query_id, id, embedding: of each Arrow batch the `limit` vectors that are nearest to a query, and all as near as the last but for rounding.

    A batch has a bounded number of queries; their vectors go to the tasks.
    """
    by_size: dict[int, tuple[list, list]] = {}
    for query, vector in batch.frame.where("vector is not null").select("query_id", "vector").toLocalIterator():
        ids, rows = by_size.setdefault(len(vector), ([], []))
        ids.append(query)
        norm = np.linalg.norm(vector)
        rows.append(np.array(vector) / norm if norm > 0 else np.array(vector))
    asked = {size: (np.array(ids), np.array(rows).reshape(len(ids), size)) for size, (ids, rows) in by_size.items()}

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(x) if x.is_valid else -1 for x in b.column(1)], np.int64)
            for size, (ids, rows) in asked.items():
                here = np.flatnonzero(sizes == size)
                if not len(here):
                    continue
                own = np.array([b.column(1)[int(i)].as_py() for i in here], np.float64).reshape(len(here), size)
                product = rows @ np.nan_to_num(own).T
                k = min(limit, len(here))
                least = np.partition(product, len(here) - k, axis=1)[:, len(here) - k] - ROUNDING
                q, at = np.nonzero(product >= least[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), b.column(0).take(pa.array(here[at])), b.column(1).take(pa.array(here[at]))], names=["query_id", "id", "embedding"])

    kinds = dict(embeddings.dtypes)
    return embeddings.select("id", "embedding").mapInArrow(best, f"query_id long, id {kinds['id']}, embedding {kinds['embedding']}")


def semantic_candidates(embeddings: DataFrame, batch: Batch, limit: int = CANDIDATES, min_similarity: float = 0.0) -> DataFrame:
    """query_id, id, semantic_score. Without a positive min_similarity negative scores stay."""
    if batch.text is not None:
        found = similarities(embeddings, batch)
    else:
        vectors = batch.frame.where("vector is not null").select("query_id", unit(F.col("vector")).alias("_vector"))
        found = nearest(embeddings, batch, limit).join(F.broadcast(vectors), "query_id").select("query_id", "id", dot(F.col("embedding"), F.col("_vector")).alias("semantic_score"))
    if min_similarity > 0:
        found = found.where(F.col("semantic_score") >= min_similarity)
    return batch.top(found, limit, F.col("semantic_score").desc(), F.col("id").asc())

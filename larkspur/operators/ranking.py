"""Fusion: candidates of four sources by id, four scores, a gate, a total order and a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import scores
from larkspur.functions.vectors import dot, unit
from larkspur.operators.batch import Batch
from larkspur.operators.candidates import CANDIDATES, by_shuffle, exact_candidates, fuzzy_candidates, partial_candidates, semantic_candidates

SCORES = ("exact_score", "partial_score", "fuzzy_score", "semantic_score", "final_score")


def candidate_union(products: DataFrame, embeddings: DataFrame | None, batch: Batch, limit: int = CANDIDATES, index: DataFrame | None = None, n_values: int | None = None) -> DataFrame:
    """query_id, id, fuzzy_score: 0 for candidates that the fuzzy source has not."""
    none = F.lit(0.0).alias("fuzzy_score")
    found = exact_candidates(products, batch, limit).select("query_id", "id", none)
    found = found.unionByName(partial_candidates(products, batch, limit).select("query_id", "id", none))
    found = found.unionByName(fuzzy_candidates(products, batch, limit, index=index, n_values=n_values).select("query_id", "id", F.greatest("fuzzy_score", F.lit(0.0)).alias("fuzzy_score")))
    if embeddings is not None:
        found = found.unionByName(semantic_candidates(embeddings, batch, limit).select("query_id", "id", none))
    return found.groupBy("query_id", "id").agg(F.max("fuzzy_score").alias("fuzzy_score"))


def ranked(products: DataFrame, embeddings: DataFrame | None, batch: Batch, limit: int = 20, candidate_limit: int = CANDIDATES, min_final_score: float = 0.10, index: DataFrame | None = None, n_values: int | None = None) -> DataFrame:
    """query_id, the product's columns and SCORES. A product without a vector has the semantic score 0."""
    # A source gives at most candidate_limit rows a query and a batch has a bounded number of queries: candidates are small enough to broadcast.
    found = candidate_union(products, embeddings, batch, candidate_limit, index, n_values)
    found = products.join(F.broadcast(found), "id").join(F.broadcast(batch.frame.select("query_id", "q", "vector")), "query_id")
    if embeddings is not None:
        found = found.join(by_shuffle(embeddings.select("id", "embedding")), "id", "left").withColumn("semantic_score", F.when(F.size("embedding") == F.size("vector"), dot(F.col("embedding"), unit(F.col("vector")))))
    else:
        found = found.withColumn("semantic_score", F.lit(0.0))
    fields = [F.col(c) for c in ("q", "product_name", "brand", "category", "tags")]
    found = found.withColumns({"exact_score": scores.exact_score(*fields), "partial_score": scores.partial_score(*fields), "fuzzy_score": scores.clamp(F.col("fuzzy_score")), "semantic_score": scores.clamp(F.coalesce("semantic_score", F.lit(0.0)))})
    found = found.withColumn("final_score", scores.final_score(*(F.col(c) for c in SCORES[:4])))
    kept = found.where(F.col("final_score") >= scores.gate(*(F.col(c) for c in SCORES[:3]), min_final_score))
    order = (F.col("final_score").desc(), F.col("semantic_score").desc(), F.col("fuzzy_score").desc(), F.col("id").asc())
    return batch.top(kept, limit, *order).select("query_id", *products.columns, *SCORES)

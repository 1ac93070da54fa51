"""Entry points: search by one query or many, its parts, and the response."""

from __future__ import annotations

import warnings
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import strip
from larkspur.operators.batch import Batch
from larkspur.operators.candidates import CANDIDATES, LEAST_FUZZY, fuzzy_candidates, semantic_candidates, similarities, trigram_index
from larkspur.operators.embedding import Embedder, text_vectors
from larkspur.operators.ranking import SCORES, ranked


class Catalogue:
    """Products, their vectors and the trigram index of their distinct values; an embedder turns query texts into vectors."""

    def __init__(self, products: DataFrame, embeddings: DataFrame | None = None, embedder: Embedder | None = None):
        self.products, self.embeddings, self.embedder, self.n_values = products, embeddings, embedder, None
        self.spark, self.index = products.sparkSession, trigram_index(products)
        self.vector = lru_cache(128)(lambda q: embedder([q])[0].tolist()) if embedder else None

    def cached(self) -> Catalogue:
        """Kept in memory between searches, products over all cores."""
        self.products, self.index = self.products.repartition("id").cache(), self.index.cache()
        self.embeddings = self.embeddings.cache() if self.embeddings is not None else None
        self.n_values = self.index.select("field", "value").distinct().count()
        return self

    def batch(self, query: str, vector: list[float] | None) -> Batch:
        return Batch.one(self.spark, query, vector if vector is not None else self.vector(query.strip()) if self.vector and query.strip() else None)

    def warmup(self) -> Catalogue:
        self.cached()
        self.search("warmup", limit=1).count()
        return self

    def _vector(self, query: str) -> list[float] | None:
        """Of an embedder that fails there is none: the search goes on, with semantic scores of 0."""
        try:
            return self.vector(query.strip()) if self.vector and self.embeddings is not None and query.strip() else None
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"no vector for the query: {e}", RuntimeWarning, stacklevel=3)
            return None

    def with_vectors(self, queries: DataFrame) -> DataFrame:
        """queries with a vector for each that has none: distinct texts go to the embedder in Arrow batches."""
        if self.embedder is None or self.embeddings is None:
            return queries
        own = F.col("vector") if "vector" in queries.columns else F.lit(None)
        asked = queries.select("query_id", "q", own.cast("array<double>").alias("_own"))
        texts = asked.where("_own is null").select(strip(F.coalesce("q", F.lit(""))).alias("_text")).where("_text <> ''").distinct()
        made = texts.select("_text", text_vectors(self.embedder)(F.col("_text")).alias("_made"))
        found = asked.withColumn("_text", F.when(F.col("_own").isNull(), strip(F.coalesce("q", F.lit(""))))).join(made, "_text", "left")
        return found.select("query_id", "q", F.coalesce("_own", F.col("_made").cast("array<double>")).alias("vector"))

    def search(self, query: str, limit: int = 20, candidate_limit: int = CANDIDATES, min_final_score: float = 0.10, vector: list[float] | None = None) -> DataFrame:
        """Ranked results of one query; none for a blank one."""
        batch = Batch.one(self.spark, query, vector if vector is not None else self._vector(query))
        return ranked(self.products, self.embeddings, batch, limit, candidate_limit, min_final_score, self.index, self.n_values).drop("query_id")

    def search_many(self, queries: DataFrame, limit: int = 20, candidate_limit: int = CANDIDATES, min_final_score: float = 0.10) -> DataFrame:
        """queries: query_id, q and optionally vector; the embedder, if there is one, makes those that are not given. As search, with query_id."""
        found = [ranked(self.products, self.embeddings, b, limit, candidate_limit, min_final_score, self.index, self.n_values) for b in Batch.many(self.with_vectors(queries))]
        return reduce(DataFrame.unionByName, found)

    def fuzzy_search(self, query: str, limit: int = 50, min_similarity: float = LEAST_FUZZY) -> DataFrame:
        batch = Batch.one(self.spark, query)
        found = fuzzy_candidates(self.products, batch, limit, min_similarity, self.index, self.n_values)
        return found.drop("query_id").join(self.products, "id").orderBy(F.col("fuzzy_score").desc(), "id")

    def semantic_search(self, query: str = "", limit: int = 20, min_similarity: float = 0.0, vector: list[float] | None = None) -> DataFrame:
        found = semantic_candidates(self._vectors(), self.batch(query or "vector" if vector is not None else query, vector), limit, min_similarity)
        return found.drop("query_id").join(self.products, "id").orderBy(F.col("semantic_score").desc(), "id")

    def similarities(self, query: str, vector: list[float] | None = None) -> DataFrame:
        return similarities(self._vectors(), self.batch(query, vector)).drop("query_id")

    def _vectors(self) -> DataFrame:
        if self.embeddings is None:
            raise FileNotFoundError("the catalogue has no embeddings")
        return self.embeddings

    def response(self, query: str = "", limit: int = 10, vector: list[float] | None = None) -> DataFrame:
        """One row: query as given, count, and results in order, with scores rounded to four places."""
        if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= 100:
            raise ValueError("limit must be a whole number from 1 to 100")
        return envelope(self.search(query, limit, vector=vector), query)

    def health(self) -> dict[str, object]:
        return {"status": "ok", "spark": self.spark.version, "products": self.products.count()}


def envelope(results: DataFrame, query: str) -> DataFrame:
    """results: of one query; at most 100 rows, so they fit in a row."""
    order = Window.orderBy(*(F.col(c).desc() for c in ("final_score", "semantic_score", "fuzzy_score")), F.col("id").asc())
    rounded = [F.round(c, 4).alias(c) for c in SCORES]
    row = F.struct("nth", "id", "product_name", "brand", "category", F.col("price").cast("double").alias("price"), "image", *rounded)
    rows = results.withColumn("nth", F.row_number().over(order)).select(row.alias("r"))
    listed = F.transform(F.array_sort(F.collect_list("r")), lambda r: r.dropFields("nth"))
    return rows.agg(F.lit(query).alias("query"), F.count(F.lit(1)).alias("count"), listed.alias("results"))

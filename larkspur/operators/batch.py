"""The queries of a search: one (literals in the plan) or many (a table, taken in blocks of bounded size)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.text import strip, tokens

#: Queries of a block, and about the characters of one; a block is what gets broadcast. A longer query has a block to itself.
BLOCK, CHARACTERS = 2_000, 2_000_000


class Batch:
    """frame: query_id, q (stripped), tokens and optionally vector; blank queries are left out."""

    def __init__(self, frame: DataFrame, text: str | None = None, n: int | None = None):
        """text: of the only query; n: queries at most."""
        self.frame, self.text, self.n = frame, text, n

    @staticmethod
    def one(spark: SparkSession, query: str, vector: list[float] | None = None) -> Batch:
        q = query.strip()
        frame = spark.range(1).select(F.lit(0).cast("long").alias("query_id"), F.lit(q).alias("q"), (F.array(*map(F.lit, q.lower().split())) if q else F.array()).cast("array<string>").alias("tokens"), (F.from_json(F.lit(json.dumps([float(x) for x in vector])), "array<double>") if vector is not None else F.lit(None).cast("array<double>")).alias("vector"))
        return Batch(frame.where("q <> ''"), q, 1)

    @staticmethod
    def many(queries: DataFrame, block: int = BLOCK, characters: int = CHARACTERS) -> Iterator[Batch]:
        """queries: query_id, q and optionally vector. As many blocks as their number and their characters ask for."""
        vector = F.col("vector") if "vector" in queries.columns else F.lit(None)
        frame = queries.select(F.col("query_id").cast("long").alias("query_id"), strip(F.coalesce("q", F.lit(""))).alias("q"), vector.cast("array<double>").alias("vector")).where("q <> ''").withColumn("tokens", tokens(F.col("q")))
        long = F.length("q") > characters
        n, size, alone = frame.agg(F.count_if(~long), F.sum(F.when(~long, F.length("q"))), F.collect_list(F.when(long, F.col("query_id")))).first()
        blocks = max(1, -(-n // block), -(-(size or 0) // characters))
        short = frame.where(~long) if alone else frame
        for k in range(blocks):
            yield Batch(short if blocks == 1 else short.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k), n=n)
        for query in sorted(set(alone)):
            yield Batch(frame.where(long & (F.col("query_id") == query)))

    def matching(self, products: DataFrame, condition: Column) -> DataFrame:
        """Of one query: products, with the query, for which the condition, over columns of both, holds."""
        tokens_ = self.text.lower().split()
        row = products.withColumns({"query_id": F.lit(0).cast("long"), "q": F.lit(self.text), "tokens": (F.array(*map(F.lit, tokens_)) if tokens_ else F.array()).cast("array<string>")})
        return row.where((F.col("q") != "") & condition)

    def top(self, rows: DataFrame, k: int, *order: Column) -> DataFrame:
        """The first k rows of each query."""
        if self.text is not None:
            return rows.orderBy(*order).limit(k)
        return rows.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("_nth") <= k).drop("_nth")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))

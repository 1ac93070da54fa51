"""Embeddings: the text of a product, a pluggable embedder, the build job, and loading with checks."""

from __future__ import annotations

import json
import sys
import time
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import strip

Embedder = Callable[[list[str]], np.ndarray]


def product_text(name: Column, description: Column, brand: Column, category: Column, tags: Column) -> Column:
    """name | Brand: b | Category: c | Tags: t | description; empty parts are left out."""
    labelled = lambda label, c: F.when(strip(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(label), strip(c)))
    return F.concat_ws(" | ", labelled("", name), labelled("Brand: ", brand), labelled("Category: ", category), labelled("Tags: ", F.coalesce(tags, F.lit(""))), labelled("", description))


def hashed_trigrams(dimension: int = 384) -> Embedder:
    """A deterministic embedder without a model: unit vectors of hashed trigram counts."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for i, t in enumerate(texts):
            for w in "".join(c if c.isalnum() else " " for c in t.lower()).split():
                padded = f"  {w} "
                for k in range(len(padded) - 2):
                    h = zlib.crc32(padded[k : k + 3].encode())
                    out[i, h % dimension] += 1 if h >> 31 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)

    return embed


def text_vectors(embedder: Embedder, batch: int = 256):
    """A function of a text column. Texts of a call that fails have no vector."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            rows = []
            for i in range(0, len(texts), batch):
                some = texts.iloc[i : i + batch].tolist()
                try:
                    rows += list(np.asarray(embedder(some), np.float32))
                except Exception as e:  # noqa: BLE001
                    print(f"no vectors for {len(some)} texts: {e}", file=sys.stderr)
                    rows += [None] * len(some)
            yield pd.Series(rows)

    return embed


def embedded(products: DataFrame, embedder: Embedder, batch: int = 256) -> DataFrame:
    """id, embedding. Texts reach the embedder in Arrow batches, at most `batch` at a time; a worker loads it once."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            rows = [v for i in range(0, len(texts), batch) for v in np.asarray(embedder(texts.iloc[i : i + batch].tolist()), np.float32)]
            yield pd.Series(rows)

    text = product_text(*(F.col(c) for c in ("product_name", "description", "brand", "category", "tags")))
    return products.select("id", embed(text).alias("embedding"))


def build_embeddings(products: DataFrame, embedder: Embedder, path: str) -> dict[str, object]:
    """Writes id and embedding as Parquet, and beside it a row of what was made."""
    spark, began = products.sparkSession, time.time()
    embedded(products, embedder).write.mode("overwrite").parquet(path)
    info = {"count": spark.read.parquet(path).count(), "seconds": round(time.time() - began, 3), "timestamp": datetime.now(UTC).isoformat()}
    spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}_info")
    return info


def load_embeddings(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """Raises ValueError for an empty table, for vectors of other dimensions, and for null or repeated ids."""
    rows = spark.read.parquet(path).select("id", "embedding")
    n, distinct, least, most = rows.agg(F.count(F.lit(1)), F.countDistinct("id"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if not n:
        raise ValueError(f"{path} has no embeddings")
    if least != most or (dimension is not None and least != dimension):
        raise ValueError(f"{path} has vectors of {least} to {most} dimensions")
    if distinct != n:
        raise ValueError(f"{path} has {n} rows for {distinct} ids")
    return rows



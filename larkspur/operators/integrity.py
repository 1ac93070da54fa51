"""Integrity checks of a catalogue."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.trigram import similarity
from larkspur.operators.candidates import trigram_index
from larkspur.sources.schema import PRODUCT_COLUMNS


def alignment(products: DataFrame, embeddings: DataFrame) -> DataFrame:
    """n_products, n_embeddings, products without a vector, vectors without a product: one row, from a full outer join by id."""
    left = products.select("id", F.lit(1).alias("p"))
    right = embeddings.select("id", F.lit(1).alias("e"))
    both = left.join(right, "id", "full_outer")
    return both.agg(F.count("p").alias("n_products"), F.count("e").alias("n_embeddings"), F.count_if(F.col("e").isNull()).alias("without_vector"), F.count_if(F.col("p").isNull()).alias("without_product"))


def verify_catalogue(products: DataFrame, embeddings: DataFrame | None = None) -> dict[str, object]:
    """Seven checks, as {timestamp, checks, product_count, columns, overall}."""
    spark = products.sparkSession
    checks: list[dict[str, object]] = []

    def check(name: str, ok: bool, detail: object) -> None:
        checks.append({"check": name, "status": "PASS" if ok else "FAIL", "detail": str(detail)})

    check("connection", spark.sql("SELECT 1").first()[0] == 1, spark.version)
    n = products.count()
    check("product_count", n > 0, n)
    check("table", bool(products.columns), f"{len(products.columns)} columns")
    grams = trigram_index(products).limit(1).count()
    check("index", grams > 0 or n == 0, "trigram index")
    missing = sorted(set(PRODUCT_COLUMNS) - set(products.columns))
    check("columns", not missing, f"missing: {missing}")
    if embeddings is None:
        check("embeddings", False, "no embeddings")
    else:
        row = alignment(products, embeddings).first()
        check("embeddings", row["n_products"] == row["n_embeddings"] and not row["without_vector"] and not row["without_product"], row.asDict())
    golden = spark.range(1).select(similarity(F.lit("word"), F.lit("two words")).alias("s")).first()["s"]
    check("trigrams", abs(golden - 4 / 11) < 1e-6, golden)
    return {"timestamp": datetime.now(UTC).isoformat(), "checks": checks, "product_count": n, "columns": products.columns, "overall": "PASS" if all(c["status"] == "PASS" for c in checks) else "FAIL"}

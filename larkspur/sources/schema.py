"""Schemas and the driver tables' product view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The header of a CSV and the names of a product's columns.
CSV_COLUMNS = {"Product Name": "product_name", "Description": "description", "Brand": "brand", "Category": "category", "Tags": "tags", "Price": "price", "Image": "image"}
PRODUCT_COLUMNS = ("id", "product_name", "description", "brand", "category", "tags", "price", "image")
PRODUCTS = T.StructType([T.StructField("id", T.LongType(), False), *(T.StructField(c, T.StringType(), False) for c in PRODUCT_COLUMNS[1:6]), T.StructField("price", T.DecimalType(10, 2), False), T.StructField("image", T.StringType(), False)])
#: The longest that the catalogue takes.
MOST_CHARACTERS = {"product_name": 255, "brand": 100, "category": 100}


def product_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table `part` as a catalogue."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    word = lambda i: F.split("p_name", " ")[i]
    kind = F.lower("p_type")
    return part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("product_name"),
        F.concat("p_name", F.lit(" size "), F.col("p_size").cast("string"), F.lit(" "), kind).alias("description"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.concat(word(0), F.lit(","), word(1), F.lit(","), kind).alias("tags"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
        F.concat(F.lit("images/part_"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("image"),
    )


def embedding_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")

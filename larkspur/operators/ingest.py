"""CSV ingest: path, header and row checks, de-duplication inside the file and against the catalogue, an all-or-nothing append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.text import name_key, strip
from larkspur.sources.schema import CSV_COLUMNS, MOST_CHARACTERS, PRODUCT_COLUMNS

#: Rows that are numbered together.
BLOCK = 1 << 16
STATUSES = ("new", "duplicate", "existing", "invalid")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def has_data(spark: SparkSession, folder: str) -> bool:
    """Whether the folder has a file that Spark would read as data."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.exists(p) and any(not f.getPath().getName().startswith(("_", ".")) for f in store.listStatus(p))


def resolve_path(spark: SparkSession, *paths: str) -> str:
    """The first path that exists."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {', '.join(paths)} exists")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """row_num (the first data row of the first file is 2) and the columns as text, renamed. A padded header name counts as the bare one.

    A file is read by one task, as its values may span lines; the files of a folder are read side by side, and numbered on from one to the
    next. The order of rows, on which "the first of duplicates stays" rests, is that of their numbers.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    named = {c.strip().lstrip("﻿"): c for c in raw.columns}
    missing = [c for c in CSV_COLUMNS if c not in named]
    if missing:
        raise ValueError(f"the CSV lacks the columns {', '.join(missing)}")
    rows = raw.select(*(F.col(f"`{named[c]}`").alias(to) for c, to in CSV_COLUMNS.items()))
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    starts, start = [], 2
    for part, n in dealt.groupBy("_part").count().orderBy("_part").collect():  # a row for each task
        starts.append((part, start))
        start += n
    offsets = spark.createDataFrame(starts, "_part long, _start long")
    return dealt.join(F.broadcast(offsets), "_part").withColumn("row_num", F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_start")).drop("_at", "_part", "_start")


def classified(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """rows: row_num and text columns; existing: product_name. Adds name_key, price (decimal), status and reason.

    Checks stand in this order: required fields, lengths, price; then duplicates in the file (the first stays), then the catalogue.
    """
    text = [c for c in PRODUCT_COLUMNS if c != "id"]
    rows = rows.select("row_num", *(strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in text))
    empty = F.array_compact(F.array(*(F.when(F.col(to) == "", F.lit(c)) for c, to in CSV_COLUMNS.items())))
    long = F.array_compact(F.array(*(F.when(F.length(c) > n, F.lit(c)) for c, n in MOST_CHARACTERS.items())))
    money = F.expr("try_cast(price AS DECIMAL(10,2))")
    reason = F.when(F.size(empty) > 0, F.concat(F.lit("missing: "), F.array_join(empty, ", "))).when(F.size(long) > 0, F.concat(F.lit("too long: "), F.array_join(long, ", "))).when(money.isNull(), "price is no number")
    rows = rows.withColumn("reason", reason).withColumn("name_key", name_key(F.col("product_name"))).withColumn("price", money)
    valid = F.col("reason").isNull()
    firsts = rows.where(valid).groupBy("name_key").agg(F.min("row_num").alias("_first_row"))
    rows = rows.join(firsts, "name_key", "left").withColumn("_first", F.col("row_num") == F.col("_first_row")).drop("_first_row")
    if existing is None:
        rows = rows.withColumn("_known", F.lit(False))
    else:
        known = existing.select(name_key(F.col("product_name")).alias("name_key")).distinct().withColumn("_known", F.lit(True))
        rows = rows.join(known, "name_key", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    status = F.when(~valid, "invalid").when(~F.col("_first"), "duplicate").when(F.col("_known"), "existing").otherwise("new")
    return rows.withColumn("status", status).drop("_first", "_known")


def report(rows: DataFrame) -> DataFrame:
    """One row of counters of classified rows."""
    count = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") != "invalid").alias("valid"), *(count(s).alias(s) for s in STATUSES))


def new_products(rows: DataFrame, first_id: int = 1) -> DataFrame:
    """The new rows as products, with ids in the order of the file: counted on from block to block of row numbers."""
    new = rows.where("status = 'new'").withColumn("_block", F.floor(F.col("row_num") / BLOCK))
    blocks = new.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = blocks.withColumn("_before", F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).drop("_n")  # a row for each block
    nth = F.row_number().over(Window.partitionBy("_block").orderBy("row_num")) + F.col("_before") + (first_id - 1)
    return new.join(offsets, "_block").withColumn("id", nth.cast("long")).select(*PRODUCT_COLUMNS)


def ingest_csv(spark: SparkSession, path: str, catalogue: str) -> dict[str, int]:
    """Appends the new products of a CSV to the Parquet catalogue in one job, and gives the counters. A second run adds nothing."""
    existing, first_id = None, 1
    if has_data(spark, catalogue):
        existing = spark.read.parquet(catalogue)
        if missing := [c for c in PRODUCT_COLUMNS if c not in existing.columns]:
            raise ValueError(f"the catalogue lacks the columns {', '.join(missing)}")
        first_id = (existing.agg(F.max("id")).first()[0] or 0) + 1
    rows = classified(read_csv(spark, path), existing).cache()
    counters = report(rows).first().asDict()
    if counters["new"]:
        new_products(rows, first_id).write.mode("append").parquet(catalogue)
    rows.unpersist()
    return counters

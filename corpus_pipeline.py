"""From documents to token ids: quality rules, exact dedup, n-gram Jaccard join, mixing to target weights, byte-level BPE.

Each stage takes all that its predecessor kept. Defined results, for the stages as for the whole:
- a null or empty text fails the rules, so it goes in the first stage; a stage that is given one keeps it in exact dedup (one of all), keeps
  it in the Jaccard join (no shingle links it), takes it once in mixing (size 0), and encodes it to no ids;
- a null id is less than any other in exact dedup and in the Jaccard join; rows with null ids are told apart by their place;
- null languages and sources are groups of their own in the rules, and a null source is the last one in mixing;
- of repeated rows, and of rows with equal texts and ids, exact dedup keeps one; mixing may take a row twice;
- very long texts are judged, compared, counted and encoded whole;
- an empty table gives an empty result in every stage;
- other columns stay, whatever their names; where the last stage adds ids and n_tokens, columns of these names get _ behind theirs.
What run() writes between stages lies in a folder of its own in the shared folder, and goes when the session's JVM ends.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.bpe import encode
from larkspur.llm.common import run_folder
from larkspur.llm.exact_dedup import drop_copies
from larkspur.llm.jaccard_join import one_of_each
from larkspur.llm.mixing import mixed_rows
from larkspur.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest doc_id stays."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.75 of their five-word shingles, the one with the least doc_id stays."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens and ids."""
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("jaccard_join", near), ("mixing", mixing), ("byte_bpe", tokens)]
#: Sketches, entropy balancing and BPE are beyond SQL; tests/llm/test_pipeline.py holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared folder and read again as the next one's documents."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), run_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs

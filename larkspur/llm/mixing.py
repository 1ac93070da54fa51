"""Mixing sources to target weights by entropy balancing.

Targets: sources in order of code points (null last) weigh WEIGHTS, repeating, and share `share` of all words; a
target stops at `most` times its source's words, the excess is dealt anew by weight until none is above.
Rates: of all document rates w in [0, most] that meet each source's target, those of least relative entropy to 1
are w = min(most, exp(l * size / mean size)); l solves the convex dual, found by Newton steps over counts of equal sizes, aggregated
before the first step, so a step costs the same for hot sources. Steps that leave the interval of the solution halve it, and from the
NEWTON-th on all do, so the interval is down to rounding within some 60 more; a source that is not solved then raises RuntimeError.
Copies: rates are rounded within blocks of a source of about BLOCK documents, the largest first, each rounding
error handed on to the next document; a block's error is at most half of one of its small documents. Blocks and their order go by id and text,
not by where a row lies, so a rerun over other partitions takes the same; rows of the same id and text share a block.

Defined results: null and empty texts have size 0 and take 0 words; a source of size 0 has target 0; repeated rows
are documents of their own; nulls in the id are kept; very long texts count whole, and are rounded like others; an empty table gives an
empty result; other columns are not read by mix() and kept by mixed_rows(), whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import WORD, checkpointed, joined_hot, settled, with_rid

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 4096
TOLERANCE = 1e-9
NEWTON, STEPS = 40, 140


def ranked(sources: DataFrame) -> DataFrame:
    """sources: a row each, with _source. Adds _rank from 0 by code point, null last, without gathering them in one task."""
    spark = sources.sparkSession
    dealt = checkpointed(sources.repartitionByRange(F.col("_source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_part").orderBy(F.col("_source").asc_nulls_last())
    counts, start, starts = dealt.groupBy("_part").count().orderBy("_part").collect(), 0, []  # a row for each partition
    for part, n in counts:
        starts.append((part, start))
        start += n
    offsets = spark.createDataFrame(starts, "_part int, _start long")
    return dealt.join(F.broadcast(offsets), "_part").withColumn("_rank", F.row_number().over(before) - 1 + F.col("_start")).drop("_part", "_start")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources: _source, _words. Adds _target."""
    kinds = F.array(*(F.lit(float(w)) for w in weights))
    rows = checkpointed(ranked(sources).withColumn("_weight", F.element_at(kinds, (F.col("_rank") % len(weights) + 1).cast("int"))).withColumn("_most", most * F.col("_words")))
    total = share * (rows.agg(F.sum("_words")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:  # a source that is full at a level is full at any higher one, and the level only rises
        full = F.col("_most") <= F.col("_weight") * level
        n, held, free = rows.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("_most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0))).first()
        if n == capped:
            break
        if free == 0:
            level = float("inf")
            break
        level, capped = max(0.0, (total - held) / free), n
    return rows.withColumn("_target", F.least(F.col("_most"), F.col("_weight") * F.lit(level)) if level != float("inf") else F.col("_most"))


def solved(sizes: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """sizes: _source, _size, _count; goals: _source, _key, _words, _docs, _target. Gives _key and _tilt of each source."""
    x = sizes.select("_source", "_size", "_count").where("_size > 0")
    goal = goals.where("_words > 0").select("_source", "_key", "_target", (F.col("_words") / F.col("_docs")).alias("_mean"))
    counts = checkpointed(x.join(goal.select("_source", "_key", "_mean"), x["_source"].eqNullSafe(goal["_source"])).select("_key", (F.col("_size") / F.col("_mean")).alias("_x"), "_size", "_count"))
    state = goal.select("_key", "_target", F.lit(0.0).alias("_tilt"), F.lit(-745.0).alias("_lo"), F.lit(745.0 * 64).alias("_hi"), F.lit(False).alias("_done"))
    for step in range(STEPS):
        tilt = F.col("_tilt") * F.col("_x")
        free = tilt < F.log(F.lit(most))
        rate = F.when(free, F.exp(tilt)).otherwise(F.lit(float(most)))
        words = F.col("_count") * F.col("_size")
        got = counts.join(state.where("not _done"), "_key").groupBy("_key").agg(F.sum(words * rate).alias("_got"), F.sum(F.when(free, words * F.col("_x") * rate).otherwise(0.0)).alias("_slope"))
        off = F.col("_got") - F.col("_target")
        lo, hi = F.when(off < 0, F.col("_tilt")).otherwise(F.col("_lo")), F.when(off > 0, F.col("_tilt")).otherwise(F.col("_hi"))
        newton = F.col("_tilt") - F.try_divide(off, F.col("_slope"))
        moved = state.join(got, "_key", "left").withColumns({"_lo": F.when(F.col("_got").isNull(), F.col("_lo")).otherwise(lo), "_hi": F.when(F.col("_got").isNull(), F.col("_hi")).otherwise(hi), "_near": F.abs(off) <= TOLERANCE * F.greatest("_target", F.lit(1.0)), "_newton": newton})
        inside = F.col("_newton").isNotNull() & (F.col("_newton") > F.col("_lo")) & (F.col("_newton") < F.col("_hi"))
        then = F.when(F.col("_done") | F.col("_near"), F.col("_tilt")).when(inside & F.lit(step < NEWTON), F.col("_newton")).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        state = checkpointed(moved.select("_key", "_target", then.alias("_tilt"), "_lo", "_hi", (F.col("_done") | F.coalesce("_near", F.lit(False)) | (F.col("_hi") - F.col("_lo") <= 1e-12 * F.greatest(F.lit(1.0), F.abs(then)))).alias("_done")))
        if state.where("not _done").isEmpty():
            return state.select("_key", "_tilt")
    raise RuntimeError(f"no rates meet the targets after {STEPS} steps")


def rounded(sizes: np.ndarray, rates: np.ndarray, most: int) -> np.ndarray:
    """Copies of each document; sizes descend, and what one document takes too much or too little the next makes good."""
    out, owed = np.zeros(len(sizes), np.int64), 0.0
    for i, (size, rate) in enumerate(zip(sizes.tolist(), rates.tolist(), strict=True)):
        owed += rate * size
        n = min(most, max(0, round(owed / size))) if size else min(most, max(0, round(rate)))
        out[i] = n
        owed -= n * size
    return out


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """A row for each row of docs: _rid, _id, _size, _source_size, _target, _rate, _copies."""
    rows = with_rid(settled(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).cast("string").alias("_source")))
    sized = checkpointed(rows.select("_rid", "_id", "_source", F.xxhash64("_text").alias("_mark"), F.coalesce(F.regexp_count("_text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size")))
    sizes = checkpointed(sized.groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("_count")))
    sources = sizes.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_count")).alias("_words"), F.sum(F.when(F.col("_size") > 0, F.col("_count")).otherwise(0)).alias("_docs"), F.sum("_count").alias("_all"))
    goals = checkpointed(targets(sources, weights, share, most).withColumn("_key", F.col("_rank")))
    goals = checkpointed(goals.join(solved(sizes, goals, most), "_key", "left"))
    tilt = F.coalesce("_tilt", F.lit(0.0)) * F.try_divide(F.col("_size") * F.col("_docs"), F.col("_words"))
    rate = F.least(F.lit(float(most)), F.exp(F.least(F.coalesce(tilt, F.lit(0.0)), F.lit(700.0))))
    total = goals.agg(F.sum("_all")).first()[0] or 0
    each = joined_hot(sized, goals.select("_source", "_key", "_words", "_docs", "_all", "_target", "_tilt"), ["_source"], "_all", total)
    blocks = F.pmod(F.xxhash64("_id", "_mark"), F.ceil(F.col("_all") / BLOCK))
    each = each.select("_rid", "_id", "_mark", "_size", F.col("_words").alias("_source_size"), "_target", rate.alias("_rate"), "_key", blocks.alias("_block"))
    kinds = dict(each.dtypes)

    def block(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_size", "descending"), ("_id", "ascending"), ("_mark", "ascending"), ("_rid", "ascending")])
        copies = rounded(t["_size"].to_numpy(), t["_rate"].to_numpy(), most)
        return t.drop_columns(["_key", "_block", "_mark"]).append_column("_copies", pa.array(copies, pa.int64()))

    names = ("_rid", "_id", "_size", "_source_size", "_target", "_rate")
    return each.groupBy("_key", "_block").applyInArrow(block, ", ".join(f"{c} {kinds[c]}" for c in names) + ", _copies long")


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """id, size, source_size, target, rate (before rounding), copies and taken (words, repeats counted) for each row."""
    return mixed(docs, id_col, **options).select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_rate").alias("rate"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns of docs may have any names."""
    docs = settled(docs)
    copies = mixed(docs, id_col, **options).where("_copies > 0").select("_rid", "_copies")
    packed = with_rid(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")))
    return packed.join(copies, "_rid").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")

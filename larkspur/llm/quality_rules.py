"""Quality rules with adaptive thresholds.

Each document's ratios (symbols, repeated lines, repeated words, word length) go into mergeable quantile sketches: counts of logarithmic
buckets, whose quantiles have a relative error of at most ALPHA and whose merge is addition. The quartiles of the sketch of a language
and source replace fixed cutoffs; they are drawn towards those of the language's merged sketch, which weigh as much in a group of PRIOR
documents and less with the square of its size, and the language's likewise towards those of all: no size has a switch. A document goes if a ratio lies beyond the far fence of its group, i.e.
WIDTH times the spread of the quartiles (at least the ratio's floor) beyond a quartile, or if it fails the base rules.

Defined results: null and empty texts have no words and fail the base; null languages and sources are groups of
their own; repeated rows are judged alike; very long texts are measured whole; an empty table gives an empty result; other columns are left alone,
whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import BLANKS, checkpointed, joined_hot, record_batch, rows_by_rid, settled, with_rid

SYMBOLS = "#*$%&|<>"
WINDOW = 5
ALPHA = 0.01
PRIOR = 50
WIDTH = 3.0
#: Ratio: the least spread that counts, and whether low values are judged too.
RATIOS = {"word_length": (1.0, True), "symbols": (0.03, False), "dup_lines": (0.15, False), "repeats": (0.06, False)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the lines with a word."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False)) if n >= WINDOW else []
    if len(set(windows)) < len(windows):
        count, upto = Counter(windows), 0
        for i, w in enumerate(windows):
            if count[w] > 1:
                repeated += i + WINDOW - max(i, upto)
                upto = i + WINDOW
    return n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [measure(t.as_py() or "") for t in b.column(2)]
        columns = list(zip(*found, strict=True)) if found else [[]] * 6
        yield record_batch(_rid=b.column(0), _id=b.column(1), **{c: pa.array(x, pa.int64()) for c, x in zip((*COUNTS, "_lines"), columns, strict=True)}, _lang=b.column(3), _source=b.column(4))


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    rows = with_rid(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"), F.col(source_col).cast("string").alias("_source")))
    kind = dict(rows.dtypes)["_id"]
    found = rows.select("_rid", "_id", "_text", "_lang", "_source").mapInArrow(_measured, f"_rid long, _id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, _lines long, _lang string, _source string")
    n = F.greatest("n_words", F.lit(1))
    ratio = {"word_length": F.col("word_chars") / n, "symbols": F.col("n_symbols") / n, "dup_lines": F.col("n_dup_lines") / F.greatest("_lines", F.lit(1)), "repeats": F.col("n_repeat_words") / n}
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.withColumns({**{f"_{k}": v for k, v in ratio.items()}, "base_failed": failed})


def bucket(value: Column) -> Column:
    """A value's bucket: that of (g**(b - 1), g**b] is b; all below 1e-4 are one."""
    g = (1 + ALPHA) / (1 - ALPHA)
    return F.when(value < 1e-4, F.lit(-100000)).otherwise(F.ceil(F.log(value) / F.log(F.lit(g)))).cast("int")


def middle(b: Column) -> Column:
    g = (1 + ALPHA) / (1 - ALPHA)
    return F.when(b == -100000, F.lit(0.0)).otherwise(2 * F.pow(F.lit(g), b) / (g + 1))


def sketches(found: DataFrame) -> DataFrame:
    """_lang, _source, _ratio, _bucket, _count: additive, so merging is a sum."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("_ratio"), bucket(F.col(f"_{k}")).alias("_bucket")) for k in RATIOS))).alias("_x")
    return found.where("n_words > 0").select("_lang", "_source", each).groupBy("_lang", "_source", "_x._ratio", "_x._bucket").agg(F.count(F.lit(1)).alias("_count"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by, "_ratio", "_bucket").agg(F.sum("_count").alias("_count"))


def quartiles(sketch: DataFrame, *by: str) -> DataFrame:
    """by, _ratio, _n, _q1, _q3."""
    part = Window.partitionBy(*by, "_ratio")
    run = sketch.withColumns({"_upto": F.sum("_count").over(part.orderBy("_bucket")), "_n": F.sum("_count").over(part)})
    at = lambda q: F.min(F.when(F.col("_upto") >= F.greatest(F.ceil(F.col("_n") * q), F.lit(1)), F.col("_bucket")))
    return run.groupBy(*by, "_ratio").agg(F.max("_n").alias("_n"), middle(at(0.25)).alias("_q1"), middle(at(0.75)).alias("_q3"))


def fences(sketch: DataFrame) -> DataFrame:
    """_lang, _source, _ratio, _low, _high for each language and source."""
    own = quartiles(sketch, "_lang", "_source")
    lang = quartiles(merged(sketch, "_lang"), "_lang").select(F.col("_lang").alias("_l"), F.col("_ratio").alias("_r"), F.struct("_n", "_q1", "_q3").alias("_by_lang"))
    every = quartiles(merged(sketch)).select(F.col("_ratio").alias("_e"), F.struct("_n", "_q1", "_q3").alias("_by_all"))
    rows = own.join(lang, F.col("_lang").eqNullSafe(F.col("_l")) & (F.col("_ratio") == F.col("_r"))).join(every, F.col("_ratio") == F.col("_e"))
    own_part = lambda n: F.col(n) * F.col(n) / (F.col(n) * F.col(n) + PRIOR * PRIOR)
    drawn = lambda n, q, to: own_part(n) * F.col(q) + (1 - own_part(n)) * to
    q1, q3 = (drawn("_n", q, drawn("_by_lang._n", f"_by_lang.{q}", F.col(f"_by_all.{q}"))) for q in ("_q1", "_q3"))
    floor = F.create_map(*(F.lit(x) for k, v in RATIOS.items() for x in (k, v[0])))
    spread = F.greatest(q3 - q1, floor[F.col("_ratio")]) * WIDTH
    return rows.select("_lang", "_source", "_ratio", (q1 - spread).alias("_low"), (q3 + spread).alias("_high"))


def thresholds(sketch: DataFrame, sizes: DataFrame) -> DataFrame:
    """sizes: _lang, _source, _rows of all. A row for each, with a map of the fences (null if no document of the group has a word)."""
    limits = fences(sketch).groupBy(F.col("_lang").alias("_g_lang"), F.col("_source").alias("_g_source")).agg(F.map_from_entries(F.collect_list(F.struct("_ratio", F.struct("_low", "_high")))).alias("_fences"))
    return sizes.join(limits, F.col("_lang").eqNullSafe(F.col("_g_lang")) & F.col("_source").eqNullSafe(F.col("_g_source")), "left").drop("_g_lang", "_g_source")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    found = checkpointed(features(docs, id_col, text_col, lang_col, source_col))
    sizes = checkpointed(found.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_rows")))
    limits = checkpointed(thresholds(sketches(found), sizes))
    rows = joined_hot(found, limits, ["_lang", "_source"], "_rows", sizes.agg(F.sum("_rows")).first()[0] or 0)
    beyond = F.lit(False)
    for k, (_, low_too) in RATIOS.items():
        fence = F.col("_fences")[k]
        beyond = beyond | (F.col(f"_{k}") > fence["_high"]) | (F.lit(low_too) & (F.col(f"_{k}") < fence["_low"]))
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(beyond, F.lit(False)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """id, the counts, base_failed, kept, and the ratios the verdict rests on."""
    return judged(docs, id_col, **columns).select(F.col("_id").alias(id_col), *COUNTS, "base_failed", "kept", *(F.col(f"_{k}").alias(f"ratio_{k}") for k in RATIOS))


def keep_good(docs: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    docs = settled(docs)
    good = judged(docs, id_col, **columns).where("kept").select("_rid")
    return rows_by_rid(docs, good, "left_semi")

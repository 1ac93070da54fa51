"""Evaluation: latency aggregates, percentiles by rank, quality by category, verdicts, and runners of query suites."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Milliseconds a type of query may take, on average.
TARGETS = {"Exact": 200, "Partial": 200, "Fuzzy": 500, "Semantic": 800, "No Result": 500}
#: The query suites.
BENCHMARK = {
    "Exact": ["nike", "samsung"],
    "Partial": ["laptop", "head", "lapt", "wire", "foot"],
    "Fuzzy": ["lptop", "botle", "footwe", "nik shose", "samsng phone", "wireles hedphone"],
    "Semantic": ["something to carry my laptop", "device for listening to music", "shoes for morning running", "something to charge my phone", "bag for traveling"],
    "No Result": ["nonexistentproduct12345xyz"],
}


def latency_summary(runs: DataFrame, *by: str) -> DataFrame:
    """runs: ms and by. n, min, avg, median (exact) and max."""
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("min_ms"), F.avg("ms").alias("avg_ms"), F.expr("percentile(ms, 0.5)").alias("median_ms"), F.max("ms").alias("max_ms"))


def latency_rollup(runs: DataFrame, by: str) -> DataFrame:
    """As latency_summary, with a row of all (null) beside those by `by`, in one pass."""
    return runs.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("min_ms"), F.avg("ms").alias("avg_ms"), F.expr("percentile(ms, 0.5)").alias("median_ms"), F.max("ms").alias("max_ms"))


def latency_percentiles(runs: DataFrame, *by: str, shares: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """The value at rank int(n * share) from 0, without interpolation.

    Equal values are counted first, so a group costs its distinct values; ranks come from a running sum.
    """
    counted = runs.groupBy(*by, "ms").agg(F.count(F.lit(1)).alias("k"))
    part = Window.partitionBy(*by)
    ranked = counted.withColumns({"upto": F.sum("k").over(part.orderBy("ms")), "n": F.sum("k").over(part)})
    at = lambda s: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * s), F.col("n") - 1), F.col("ms")))
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *(at(s).alias(f"p{round(100 * s)}_ms") for s in shares))


def quality_breakdown(cases: DataFrame) -> DataFrame:
    """cases: type and status (PASS or FAIL). Counts and rate by type."""
    passed = F.count_if(F.col("status") == "PASS")
    return cases.groupBy("type").agg(F.count(F.lit(1)).alias("total"), passed.alias("passed"), (F.count(F.lit(1)) - passed).alias("failed"), (100.0 * passed / F.count(F.lit(1))).alias("pass_rate"))


def verdict(ms: Column) -> Column:
    """The bands of a latency."""
    return F.when(ms < 100, "Excellent").when(ms < 500, "Good").when(ms < 1000, "Acceptable").otherwise("Slow")


def target_status(kind: Column, avg_ms: Column) -> Column:
    target = F.create_map(*(F.lit(x) for k, v in TARGETS.items() for x in (k, v)))
    return F.when(avg_ms <= target[kind], "PASS").otherwise("FAIL")


def timed(f: Callable[[], object]) -> tuple[object, float]:
    began = time.perf_counter()
    return f(), 1000 * (time.perf_counter() - began)


def run_suite(spark: SparkSession, search: Callable[[str], DataFrame], suite: dict[str, list[str]], runs: int = 3, top: int = 5, expect: Callable[[str, list], bool] | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs of each query (query, type, run, ms) after a warm one, and cases (query, type, status, num_results)."""
    times, cases = [], []
    for kind, queries in suite.items():
        for q in queries:
            rows = search(q).collect()
            ok = expect(q, rows[:top]) if expect else True
            cases.append((q, kind, "PASS" if ok else "FAIL", len(rows)))
            times += [(q, kind, i, timed(lambda q=q: search(q).collect())[1]) for i in range(runs)]
    return spark.createDataFrame(times, "query string, type string, run int, ms double"), spark.createDataFrame(cases, "query string, type string, status string, num_results int")

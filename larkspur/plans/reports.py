"""Reports: JSON, Markdown and CSV of evaluation results. Aggregates are a few rows and are written by the driver through Spark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from larkspur.plans.evaluation import latency_percentiles, latency_summary, quality_breakdown


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    write_text(spark, json.dumps(value, default=str), path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def markdown_table(rows: DataFrame, *order: str) -> str:
    cells = [rows.columns, ["---"] * len(rows.columns), *([f"{x:.2f}" if isinstance(x, float) else str(x) for x in r] for r in rows.orderBy(*order).collect())]
    return "\n".join(f"| {' | '.join(x)} |" for x in cells)


def quality_report(cases: DataFrame) -> str:
    return "# Search quality\n\n" + markdown_table(quality_breakdown(cases), "type") + "\n"


def performance_report(runs: DataFrame) -> str:
    parts = (("By type", latency_summary(runs, "type"), "type"), ("By query", latency_summary(runs, "type", "query"), "query"), ("Percentiles", latency_percentiles(runs), "n"))
    return "# Search performance\n" + "".join(f"\n## {title}\n\n{markdown_table(rows, order)}\n" for title, rows, order in parts)


def edge_report(cases: DataFrame) -> str:
    return "# Edge cases\n\n" + markdown_table(cases, "query") + "\n"

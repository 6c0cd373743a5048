"""Writing scores, metrics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_scores(scored: DataFrame, path: str) -> None:
    """Parquet, a folder for each verdict."""
    scored.write.mode("overwrite").partitionBy("verdict").parquet(path)


def write_metrics(long: DataFrame, path: str) -> None:
    """Parquet, a folder for each metric."""
    long.write.mode("overwrite").partitionBy("metric").parquet(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Text, a record per report (doc_a, doc_b, verdict, report), each beginning with a byte order mark; a folder for each verdict."""
    rows = reports.select("verdict", F.concat(F.lit("\ufeff"), "report", F.lit("\n")).alias("value"))
    rows.write.mode("overwrite").partitionBy("verdict").option("lineSep", "\n").text(path)

"""Ingest and quality gate: files to a corpus, what was refused, and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D
from ..sources import ingest as I


def ingest(spark: SparkSession, path: str, out: str) -> None:
    """Read the files under ``path``; write corpus (with hashed ids and titles), refused files and summary under ``out``."""
    texts, refused = I.quarantine(I.detect_and_decode(I.read_text_files(spark, path)))
    title = F.element_at(F.split("path", "/"), -1)
    texts.select(F.xxhash64("path").alias("doc_id"), "path", title.alias("title"), "charset", "text").write.mode("overwrite").parquet(f"{out}/corpus")
    refused.select("path", "length", "reject_reason").write.mode("overwrite").parquet(f"{out}/refused")
    summary(spark.read.parquet(f"{out}/corpus")).write.mode("overwrite").parquet(f"{out}/summary")


def statistics(corpus: DataFrame) -> DataFrame:
    """Per document: words, letters, dominant script, length class."""
    docs = D.tokens(corpus)
    rows = docs.join(D.dominant_script(docs), "doc_id", "left")
    return rows.select(*(c for c in corpus.columns if c != "text"), "word_count", "letter_count", "dominant_script", D.length_class(F.col("word_count")).alias("length_class"))


def summary(corpus: DataFrame) -> DataFrame:
    """Documents by charset, script and length class."""
    by = [c for c in ("charset",) if c in corpus.columns] + ["dominant_script", "length_class"]
    return statistics(corpus).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("word_count").alias("words"))

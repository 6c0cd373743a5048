"""Corpus preparation in five stages, each written as Parquet and read back as the next one's documents.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns
what it keeps, with the columns of documents, but for the last one, which returns
the packed pieces. run applies them to the documents table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authorship_spark.llm import jaccard_join, line_dedup, packing, pii, toxicity
from authorship_spark.llm.common import materialize, table, text_of, whole_row, with_columns
from authorship_spark.llm.registry import PII_KEY, VOCABULARY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _framed(docs: DataFrame) -> DataFrame:
    """``docs`` as (row, doc_id, text): no column of theirs meets one that an operator adds."""
    return docs.select(whole_row(docs).alias("row"), "doc_id", text_of().alias("text"))


def _like(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Framed ``rows`` with the columns of ``docs`` again, n_chars following the text."""
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return with_columns(rows, docs, new)


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from labelled documents outside the held-out quarter; documents that score as toxic go."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    lexicon, weights = toxicity.learn(docs, labels)
    rows = toxicity.score_rows(_framed(docs), lexicon, weights)
    return _like(docs, rows.where("predicted = 0"))


def recurring_lines_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, without the lines whose template recurs in unrelated documents."""
    return _like(docs, line_dedup.drop_recurring_lines(_framed(docs)))


def near_duplicates_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one of the least id, rows without an id last."""
    # rows are judged, not ids: an id may stand in several rows, or in none
    rows = materialize(_framed(docs).withColumn("nth", F.monotonically_increasing_id()), "rows")
    found = jaccard_join.near_duplicates(rows, words=5, threshold=0.8, id_col="nth")
    # the first row of a group by id: the least of the numbers where two are of one id
    grouped = materialize(rows.select("nth", "doc_id").join(found.where("n_links > 0").select("nth", "class_id"), "nth"), "grouped")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("nth"))
    kept = materialize(grouped.groupBy("class_id").agg(F.min(order)["nth"].alias("kept")), "kept")
    gone = grouped.join(kept.select(F.col("kept").alias("nth")), "nth", "left_anti").select("nth")
    return _like(docs, rows.join(gone, "nth", "left_anti"))


def personal_data_replaced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with surrogates in place of personal data and secrets."""
    return _like(docs, pii.replace_entities(_framed(docs), key=PII_KEY))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of 1024 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"), VOCABULARY("byte_bpe_50k.json"), max_tokens=1024)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_documents_go),
    ("line_dedup", recurring_lines_go),
    ("jaccard_join", near_duplicates_go),
    ("pii", personal_data_replaced),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Training a model, surrogates and a tokenizer are beyond SQL: tests/llm/test_pipeline.py holds run() and each stage against plain readings.
ORACLE_SQL = None

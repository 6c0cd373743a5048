"""Small helpers that the operators share: workers' imports, shared storage, reading."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored as materialize

__all__ = ["FEW", "column", "join_hot", "materialize", "partitions", "ready", "table", "text_of", "whole_row", "with_columns"]
_ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and get Arrow batches of bounded size."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of exactly that name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    """A text column in which null counts as the empty text."""
    return F.coalesce(column(name).cast("string"), F.lit(""))


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that no name of an operator can clash with one of theirs."""
    return F.struct(*(column(c) for c in docs.columns))


def with_columns(rows: DataFrame, docs: DataFrame, new: dict[str, Column], row: str = "row") -> DataFrame:
    """The columns of ``docs`` out of the struct ``row``; ``new`` ones take the place of those of their name or follow."""
    named = {c.lower(): c for c in new}
    kept = [new[named[c.lower()]].alias(c) if c.lower() in named else F.col(row).getField(c).alias(c) for c in docs.columns]
    there = {c.lower() for c in docs.columns}
    return rows.select(*kept, *(value.alias(c) for c, value in new.items() if c.lower() not in there))


#: Rows up to which a side of a join, whose rows were counted, is broadcast.
FEW = 500_000


def join_hot(rows: DataFrame, values: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``values``, which has one row per key and in ``n`` how many of the ``total`` rows hold it.

    Keys of more than a share of 1 / (4 x partitions) of all rows are hot; there can be
    4 x partitions of them at most, so they are listed and their values broadcast. Only
    the rows of other keys are shuffled, and no task gets all rows of a hot key. ``n``
    isn't in the result.
    """
    limit = max(1000, total // (4 * partitions(rows.sparkSession)))
    key = F.xxhash64(*on)
    hot = [r["key"] for r in values.where(F.col(n) > limit).select(key.alias("key")).collect()]
    values = values.drop(n)
    if not hot:
        return rows.join(values, on, how)
    met = rows.where(key.isin(hot)).join(F.broadcast(values.where(key.isin(hot))), on, how)
    return met.unionByName(rows.where(~key.isin(hot)).join(values.where(~key.isin(hot)), on, how))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

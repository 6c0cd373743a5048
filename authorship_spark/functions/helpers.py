"""The three Arrow helpers, for what Spark has no function for."""

from __future__ import annotations

import os
import unicodedata
import zlib
from pathlib import Path

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType


_ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound the Arrow batches that they get."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normalisation form C; null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def decode_utf16(content: pd.Series) -> pd.Series:
    """UTF-16 bytes that begin with their byte order mark; malformed units become U+FFFD."""
    return content.map(lambda b: bytes(b).decode("utf-16", "replace"), na_action="ignore")


def _deflated(data: str | None, dictionary: str | None) -> int:
    try:
        raw, preset = (data or "").encode(), (dictionary or "").encode()
        packer = zlib.compressobj(9, zdict=preset) if preset else zlib.compressobj(9)
        return len(packer.compress(raw)) + len(packer.flush())
    except (zlib.error, ValueError):
        return -1


@F.pandas_udf(IntegerType())
def deflate_size(data: pd.Series, dictionary: pd.Series) -> pd.Series:
    """zlib size at level 9, with ``dictionary`` preset where it isn't null or empty; -1 on an error."""
    return pd.Series([_deflated(a, b) for a, b in zip(data, dictionary, strict=True)], dtype="int32")

"""No text may end a job: a million of one sign through every operator that reads texts; time grows with the text, not with its square."""

import time

import pytest
from pyspark.sql import functions as F

from authorship_spark.functions import text as T
from authorship_spark.operators import documents as D
from authorship_spark.operators import metrics, profiles
from authorship_spark.sources import ingest

MILLION = 1_000_000
TEXTS = {
    "blanks": "a" + " " * MILLION + "b", "line ends": "a" + "\n" * MILLION + "b", "returns": "a" + "\r" * MILLION + "b", "letters": "x" * MILLION, "capitals": "A" * MILLION + "b", "points": "." * MILLION,
    "words": "a " * (MILLION // 2), "name": "Mr A" + "a" * MILLION, "domain": "a@b" + ".c" * (MILLION // 2), "apostrophes": "a'" * (MILLION // 2), "kanji": "漢字" * (MILLION // 2), "yi": "".join(chr(0xA000 + k % 1000) for k in range(MILLION // 2)),
}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS.values())], "doc_id long, text string").repartition(4).cache()


def took(df, seconds=20):
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    assert time.time() - began < seconds
    return df


def test_operators(corpus):
    corpus.count()
    took(D.counted(corpus))
    took(D.documents(corpus), 60)
    took(D.split_chunks(D.counted(corpus)), 40)
    took(D.script_counts(corpus), 40)
    tokens = D.tokens(corpus).withColumn("letters_lower", T.letters_lower(F.col("text")))
    took(profiles.counts(tokens, ("w",)))
    took(profiles.counts(tokens, ("c3",)), 60)
    took(ingest.detect_and_decode(corpus.select("doc_id", F.encode("text", "UTF-8").alias("content"))))


def test_trim_is_linear(spark):
    """Inner blanks: four times as many take no more than about four times as long."""

    def seconds(n):
        df = spark.createDataFrame([(("a" + " " * n + "b"),)] * 8, "text string").repartition(1).cache()
        df.count()
        best = 1e9
        for _ in range(3):
            began = time.time()
            assert df.select(F.sum(F.length(T.normalize_text(F.col("text"), compose=False)))).first()[0] == 8 * (n + 2)
            best = min(best, time.time() - began)
        return best

    assert seconds(1_000_000) < 1 and seconds(4_000_000) < 4


def test_pairs(spark, corpus):
    docs = D.documents(corpus).drop(*D.BULKY).cache()
    wanted = spark.createDataFrame([(i, (i + 1) % len(TEXTS)) for i in range(len(TEXTS))], "doc_a long, doc_b long")
    began = time.time()
    rows = metrics.distances(docs, wanted).collect()
    assert len(rows) == len(TEXTS) and all(r[f"m{n}"] is None or 0 <= r[f"m{n}"] <= 1 for r in rows for n in range(1, 18))
    assert time.time() - began < 120

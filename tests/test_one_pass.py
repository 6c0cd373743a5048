"""Columns made in one look at a text, and features made in one pass, against those made one by one."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from authorship_spark.functions import text as T
from authorship_spark.functions import vectors as V
from authorship_spark.jobs import verify
from authorship_spark.operators import arrays, documents, metrics, pairs

SIGNS = "ab zé İΣ.!?…|\n\t,'中のд۔॥-—«AB𝐀é1"


def texts(spark, n):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 80))), "x") for i in range(n)]
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    rows += [(n + i, " ".join(map(chr, points[i : i + 1000])), "x") for i in range(0, len(points), 1000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_one_look(spark):
    rows = documents.documents(texts(spark, 400))
    x = F.col("text")
    lower = F.regexp_replace(F.lower(F.replace(x, F.lit("Σ"), F.lit("σ"))), r"[^\p{L}]+", "")
    pairs = {
        "words": T.tokenize(x), "sentence_lengths": T.sentence_lengths(x), "paragraph_lengths": T.paragraph_lengths(x), "letters_lower": lower,
        "punct": V.punct_vector(x, F.col("letter_count")), "typo": V.typo_vector(x, F.col("letter_count")),
    }
    unlike = rows.select("doc_id", *((F.col(c).eqNullSafe(v)).alias(c) for c, v in pairs.items())).collect()
    for c in pairs:
        assert [r["doc_id"] for r in unlike if not r[c]] == [], c


def test_long_texts_alone(spark):
    rows = [(1, "a " * 500), (2, "a " * 499), (3, "中" * 500), (4, "中" * 499), (5, "a " * 499 + "中"), (6, " " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in documents.documents(docs, least=500).collect()) == [1, 3, 5]


def test_chunk_words_travel_once():
    words = pa.array([["a", "b", "a"], ["a"], [], ["b"]], pa.list_(pa.string()))
    chunks = pa.array([[["a"], ["b", "a"]], [["c"], ["a"]], [], [[], []]], pa.list_(pa.list_(pa.string())))
    w, z = arrays._pack_words(words)["w_gram"], arrays._pack_chunks(chunks)
    assert z["z_cnt"].to_pylist() == [[1, 1, 0, 1], [0, 1, 1, 0], [], []]
    assert arrays._unless_same(z["z_gram"], w).to_pylist() == [[], ["a", "c"], [], []]


def test_one_pass_as_from_stored_documents(spark):
    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(300)]
    rows = [(i, ". ".join(rng.choice(names, 560 + 90 * (i % 4))), "x") for i in range(9)]
    rows += [(20, "ab" * 1400 + " c" * 600, "x"), (4, rows[4][1], "x")]
    corpus = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = verify.prepare(corpus)
    want = metrics.distances(docs, pairs.pairs_blocked(docs, ("lang",), 3), False)
    got = verify.distances_blocked(corpus, ("lang",), 3, compression=False)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))

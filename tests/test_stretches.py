"""Blocked pairs compared stretch by stretch, where their texts lie, against the same pairs joined with stored features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from authorship_spark.jobs import verify
from authorship_spark.operators import arrays, documents, metrics, pairs, score
from authorship_spark.storage import job, shared_dir


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(300)]
    rows = [(i, ". ".join(rng.choice(names, 20 if i % 7 == 0 else 510 + 90 * (i % 5))), None if i % 9 == 4 else "xy"[i % 5 == 1]) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("window, size", [(3, 4), (2, 64), (5, 5), (40, 64)])
def test_as_joined(corpus, monkeypatch, window, size):
    monkeypatch.setattr(verify, "STRETCH", size)
    docs = verify.prepare(corpus)
    only = None if window == 3 else ("M3", "M5", "M6", "M12")
    want = metrics.distances(docs, pairs.pairs_blocked(docs, ("lang",), window), only=only)
    got = verify.distances_blocked(corpus, ("lang",), window, only=only)
    assert "Join" not in got.select("m1")._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    about = "struct(a.word_count as n, a.text_hash as h)"
    columns = ["doc_a", "doc_b", *(m.lower() for m in metrics.WEIGHTS), about, about.replace("a.", "b.")]
    assert sorted(map(str, got.selectExpr(*columns).collect())) == sorted(map(str, want.selectExpr(*columns).collect()))


def test_features_are_not_stored(spark, corpus):
    with job(spark) as path:
        verify.verify_blocks(corpus, ("lang",), 3)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        held = [str(f.getPath()) for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
        columns = {c for f in held for c in spark.read.parquet(f).columns}
    assert shared_dir(spark) and columns and not [c for c in columns if c.endswith(("_gram", "_cnt"))]


def test_batches_cut_anywhere(corpus):
    docs = documents.documents(corpus, compose=False).withColumn("nth", F.col("doc_id") % 10).orderBy("doc_id")
    rows = metrics._derived(docs, ("M1", "M3", "M12", "M13"), ("nth",))
    kinds = ("w", "c3")
    held = arrays.packed_columns(kinds, True)
    table = rows.orderBy("doc_id").select("nth", F.struct("doc_id", "word_count").alias("row"), *held).toArrow()
    got = []
    for size in (1, 2, 7, 100):
        made = arrays._met_batches(iter(table.to_batches(max_chunksize=size)), kinds, True, False, 3, 8)
        got.append([(r["a"]["doc_id"], r["b"]["doc_id"], r["m1"], r["m3"], r["m12"], r["after"]) for b in made for r in b.to_pylist()])
    assert got[0] == got[1] == got[2] == got[3]
    assert sorted(r[:2] for r in got[0]) == [(i, j) for i in range(40) for j in range(40) if i < j <= i + 3 and i // 10 == j // 10 and i % 10 < 8]
    with pytest.raises(ValueError, match="order"):
        list(arrays._met_batches(iter(table.take([0, 2]).to_batches()), kinds, True, False, 3, 8))


def test_chunks_are_compared_where_they_lie(spark, corpus):
    docs = verify.texts(corpus)
    own = score.self_distance(docs)
    assert own.count() == docs.where("word_count >= 260").count() > 20
    assert sorted(map(str, score.self_distance(docs.unionByName(docs)).collect())) == sorted(map(str, own.collect()))
    twice = docs.withColumn("doc_id", F.when(F.col("doc_id") == 3, 2).otherwise(F.col("doc_id")))
    with pytest.raises(Exception, match="several texts"):
        score.self_distance(twice)

"""The summary is of whole scores: all 17 metrics and the self baseline."""

import pytest
from pyspark.sql import functions as F

from authorship_spark.jobs import queries, verify
from authorship_spark.operators import metrics

from .test_plain import write


def test_summary_of_whole_scores(spark, tmp_path, monkeypatch):
    rows = [(i, write("ABC"[i % 2], i, 60 + 10 * i), "en", "x") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    whole, seen = verify.verify_blocks, []

    def noted(*args, **options):
        scored, long = whole(*args, **options)
        seen.append((scored, long))
        return scored, long

    monkeypatch.setattr(verify, "verify_blocks", noted)
    got = queries.x5_summary(spark, str(tmp_path)).collect()
    (scored, long), = seen
    assert sum(r["n"] for r in got) == scored.count() > 0
    assert {r["verdict"]: r["mean_p"] for r in got} == {r["verdict"]: pytest.approx(r["p"], abs=1e-4) for r in scored.groupBy("verdict").agg(F.avg("p").alias("p")).collect()}
    assert scored.where("self_distance IS NULL").isEmpty() and long.where("metric = 'M16' AND neutral").isEmpty()
    assert long.select("metric").distinct().count() == len(metrics.WEIGHTS)

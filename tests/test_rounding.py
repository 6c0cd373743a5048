"""Values are rounded as SQL rounds them, also where their decimal form ends in a half that is no double."""

import functools
import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from authorship_spark.functions.kernels import rounded
from authorship_spark.operators import arrays, report


def test_as_sql(spark):
    values = [k / 640 for k in range(641)] + [k / 3200 for k in range(-100, 3201, 7)] + [402 / 6400, 0.0, 1e300, -2.5e-6, 0.49999999999999994e-6, 1.5]
    got = [r["y"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i").select(rounded("x", 6).alias("y")).collect()]
    want = [r[0] for r in duckdb.execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()]
    assert got == want
    assert spark.createDataFrame([(None,)], "x double").select(rounded("x", 6).alias("y")).first()["y"] is None


def test_richness_at_a_half(spark, tmp_path):
    # 640 words, of which 333 stand there once
    sign = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    words = [sign(i) for i in range(640)] + [sign(i) for i in range(333, 640)]
    docs = spark.createDataFrame([(1, " ".join(words), "en", "x")], "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["a7_richness"](spark, str(tmp_path)).select("doc_id", "hapax_ratio", "vocab").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, hapax_ratio, vocab FROM ({entry.oracle_sql()['a7_richness']})").fetchall()
    assert [tuple(r) for r in got] == want == [(1, 0.520312, 640)]


def test_reports_at_a_half(spark):
    # SQL rounds the product of a value and 1000, format_string the decimal form
    values = [k / 2000 for k in range(1, 2000)] + [k / 640 for k in range(200)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i")
    got = [r["y"] for r in rows.select(report._fixed(F.col("x"), 3).alias("y")).collect()]
    want = [r[0] for r in duckdb.execute("SELECT printf('%.3f', round(x, 3)) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()]
    assert got == want
    assert got != [r["y"] for r in rows.select(F.format_string("%.3f", "x").alias("y")).collect()]


def test_metrics_are_shuffled_once(spark):
    """Reasons are ranked in the pair's row: no window, no sort of rows, one exchange of metrics."""
    long = spark.createDataFrame([(1, 2, n, f"M{n}", n / 10, 0.1, n == 3) for n in range(1, 9)], "doc_a long, doc_b long, metric_no int, metric string, distance double, weight double, neutral boolean")
    scored = spark.createDataFrame([(1, 2, 0.5)], "doc_a long, doc_b long, p double")
    rows = report.rationale(long, scored)
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r)[2:5] for r in rows.orderBy("part", "nth").collect()] == [("alike", 1, "M1"), ("alike", 2, "M2"), ("different", 1, "M5"), ("different", 2, "M6")]
    assert [r["metric"] for r in report.rationale(long, scored, strongest=True).where("part = 'different'").orderBy("nth").collect()] == ["M8", "M7"]
    far = long.where("metric_no > 5")
    assert [r["metric"] for r in report.rationale(far, scored).where("part = 'alike'").orderBy("nth").collect()] == ["M8", "M7"]


def test_sums_from_the_first_gram_on():
    rng = np.random.default_rng(1)
    pairs = [rng.random((2, 300)) / 300 for _ in range(50)]
    for x, y in pairs:
        xy, xx, yy = (functools.reduce(lambda s, v: s + v, (a * b).tolist(), 0.0) for a, b in ((x, y), (x, x), (y, y)))
        assert arrays.cosine(x, y) == xy / (math.sqrt(xx) * math.sqrt(yy))
    assert [float(x @ x) for x, _ in pairs] != [arrays._dot(x, x) for x, _ in pairs]
    assert arrays.cosine(np.zeros(0), np.zeros(0), both_zero=1.0) == 1.0

"""Properties of metrics and scores on generated authors, and hand-computed scores."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from authorship_spark.functions.helpers import deflate_size
from authorship_spark.jobs import verify
from authorship_spark.operators import metrics, pairs, report, score
from authorship_spark.operators.align import PAIR

WORDS = {
    "A": ("although moreover nevertheless consideration particularly understanding".split(), "the of which that with from".split(), 16, ".,—"),
    "B": ("yes no go run stop look hey".split(), "i you it and but so".split(), 6, "!?."),
    "C": ("system value result method figure table".split(), "is are we can this by".split(), 11, ";:."),
}


def write(author, seed, sentences=60):
    rng = random.Random(f"{author}{seed}")
    long, short, mean, marks = WORDS[author]
    out = []
    for _ in range(sentences):
        n = max(2, round(rng.gauss(mean, mean / 4)))
        out.append(" ".join(rng.choice(short if rng.random() < 0.6 else long) for _ in range(n)).capitalize() + rng.choice(marks))
    return " ".join(out) + "."


@pytest.fixture(scope="module")
def scored(spark):
    texts = {1: write("A", 1), 2: write("A", 2), 3: write("B", 3, 150), 4: write("C", 4), 5: write("A", 1), 6: "", 7: "Короткий текст."}
    docs = verify.prepare(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), force=True).cache()
    wanted = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (3, 4), (2, 1), (1, 5), (6, 1), (1, 6), (7, 1), (6, 7)], "doc_a long, doc_b long")
    rows = metrics.distances(docs, wanted).cache()
    own = score.self_distance(docs).cache()
    return rows, score.scores(rows, own).cache(), own


def test_properties(scored):
    rows, scores, _ = scored
    found = {(r["doc_a"], r["doc_b"]): r.asDict() for r in rows.collect()}
    assert len(found) == 10
    for r in found.values():
        for n in range(1, 18):
            assert r[f"m{n}"] is None or 0 <= r[f"m{n}"] <= 1
    for n in range(1, 18):  # symmetric; compression only nearly
        a, b = found[1, 2][f"m{n}"], found[2, 1][f"m{n}"]
        assert a == b if a is None else a == pytest.approx(b, abs=1e-9)
    for r in scores.collect():
        assert 0.001 <= r["p"] <= 0.999


def test_identity_and_order(scored):
    p = {(r["doc_a"], r["doc_b"]): r for r in scored[1].collect()}
    assert p[1, 5]["identical"] and p[1, 5]["D"] == 0 and p[1, 5]["p"] == pytest.approx(0.999) and p[1, 5]["verdict"] == "same_high"
    assert p[1, 2]["D"] < p[1, 3]["D"] and p[1, 2]["D"] < p[1, 4]["D"]
    assert "critical" in p[1, 6]["warnings"] and "cross_script" in p[7, 1]["warnings"]


def test_self_distance(scored):
    own = {r["doc_id"]: r["self_distance"] for r in scored[2].collect()}
    assert set(own) == {1, 2, 3, 4, 5} and all(0 <= d <= 1 for d in own.values())


@pytest.mark.parametrize("window", [1, 3, 40])
def test_pairs_blocked(spark, window):
    """Neighbours of blocks large and small, over the borders of ranges, against a plain reading; huge ids."""
    rng = random.Random(window)
    rows = [(rng.randrange(-(2**62), 2**62), rng.choice(["en", "en", "en", "fr", None]), rng.choice("ab")) for _ in range(150)] + [(k, "rare", "c") for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string")
    blocks = {}
    for i, lang, source in sorted(rows, key=lambda r: r[0]):
        blocks.setdefault((lang, source), []).append(i)
    want = sorted((ids[k], ids[k + d]) for ids in blocks.values() for k in range(len(ids)) for d in range(1, window + 1) if k + d < len(ids))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(tuple(r) for r in pairs.pairs_blocked(docs, window=window).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert pairs.pairs_blocked(docs.where("false"), window=window).count() == 0


def test_only_some_metrics(spark, scored):
    """What ``only`` leaves out changes nothing else."""
    texts = {1: write("A", 1), 2: write("B", 2)}
    docs = verify.prepare(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), force=True)
    wanted = spark.createDataFrame([(1, 2)], "doc_a long, doc_b long")
    every = metrics.distances(docs, wanted).first()
    for m in ("M2", "M7", "M9", "M13"):
        assert metrics.distances(docs, wanted, only=(m,)).first()[m.lower()] == pytest.approx(every[m.lower()], abs=1e-12) or every[m.lower()] is None


def test_deflate_size(spark):
    """Sizes are zlib's own, with and without a preset dictionary."""
    a, b = write("A", 5), write("A", 6)
    got = spark.createDataFrame([(a, b), (a, ""), ("", b), (None, None)], "x string, y string").select(deflate_size("x", "y").alias("n")).collect()

    def size(data, preset=""):
        packer = zlib.compressobj(9, zdict=preset.encode()) if preset else zlib.compressobj(9)
        return len(packer.compress(data.encode()) + packer.flush())

    assert [r["n"] for r in got] == [size(a, b), size(a), size("", b), size("")] and size(a, a) < size(a, b) < size(a)


def test_report(scored):
    rows, scores, _ = scored
    long = metrics.extract(rows)
    reasons = report.rationale(long, scores)
    assert reasons.groupBy(*PAIR, "part").count().where("count > 3").isEmpty()
    text = report.render_report(scores, long, reasons).where("doc_a = 1 AND doc_b = 2").first()["report"]
    assert "letter 3-gram cosine" in text and "P =" in text
    labelled = scores.select(*PAIR, F.lit("g").alias("group"), F.when((F.col("doc_b") == 2), "AA").otherwise("AB").alias("kind")).where("doc_a = 1 AND doc_b IN (2, 3, 4)")
    assert report.eval_ordering(scores, labelled).count() == 1
    assert report.verdict_summary(scores).agg(F.sum("n")).first()[0] == 10


@pytest.mark.parametrize(
    "d,n,want",
    [(0.30, 2000, (0.991837, 1, 0.991837, "same_high")), (0.34, 1000, (0.5, 0.908879, 0.5, "inconclusive")), (0.36, 600, (0.083173, 0.841765, 0.149129, "diff_high")), (0.40, 100, (0.000746, 0.485713, 0.257506, "diff_medium"))],
)
def test_scores(spark, d, n, want):
    side = F.struct(F.lit(n).alias("word_count"), F.lit("h").alias("text_hash"))
    rows = spark.range(1).select(F.lit(1).alias("doc_a"), F.lit(2).alias("doc_b"), *(F.lit(d).alias(f"m{k}") for k in range(1, 18)), side.alias("a"), F.struct(F.lit(n).alias("word_count"), F.lit("i").alias("text_hash")).alias("b"))
    r = score.scores(rows).first()
    assert (r["p_topic"], r["f"], r["p"]) == pytest.approx(want[:3], abs=2e-6) and r["verdict"] == want[3]


def test_plan_has_no_product(spark):
    docs = verify.prepare(spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string"), force=True)
    rows = metrics.distances(docs, spark.createDataFrame([(1, 2)], "doc_a long, doc_b long"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

"""The library against the plain evaluator: 24 pairs, all 17 distances with cross-compression, scores, reports, and lists of pairs."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from authorship_spark.jobs import verify
from authorship_spark.operators import arrays, metrics, pairs, report, score
from authorship_spark.operators.align import PAIR

from . import plain
from .test_metrics import write

DATA = Path("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def texts(spark):
    made = {1: write("A", 1, 90), 2: write("A", 2, 150), 3: write("B", 3, 190), 4: write("C", 4, 120), 5: write("A", 1, 90), 6: "", 7: "Короткий текст. И ещё один!", 8: "  \r\n 12 34 \r", 9: write("C", 9, 20)}
    made[10] = "\r\n".join(write("BC"[k % 2], k, 12) for k in range(24)) + "\nNASA  flew - to the moon… “Yes” it's OK 😀 1,5"
    made[11] = made[10].replace("the", "die").replace(".", " !").upper()
    if DATA.exists():
        rows = spark.read.parquet(str(DATA)).where("length(text) > 5000").orderBy("doc_id").limit(8).collect()
        made |= {100 + k: r["text"] for k, r in enumerate(rows)}
    return made


@pytest.fixture(scope="module")
def listed(texts):
    rng = random.Random(6)
    found = [(1, 2), (2, 1), (1, 3), (3, 4), (1, 5), (6, 1), (7, 1), (6, 6), (8, 2), (9, 4), (10, 11), (10, 3), (11, 2), (7, 8)]
    ids = [i for i in texts if i >= 100]
    while ids and len(found) < 24:
        found.append(tuple(rng.sample(ids, 2)))
    return found


@pytest.fixture(scope="module")
def docs(spark, texts):
    return verify.prepare(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), force=True)


@pytest.fixture(scope="module")
def verified(spark, docs, listed):
    wanted = spark.createDataFrame(sorted(set(listed)), "doc_a long, doc_b long")
    scored, long = verify.verify(docs, wanted)
    return scored.cache(), long.cache()


def test_distances(verified, texts, listed):
    got = {}
    for r in verified[1].collect():
        got.setdefault((r["doc_a"], r["doc_b"]), {})[r["metric_no"]] = None if r["neutral"] else r["distance"]
    assert set(got) == set(listed)
    for (a, b), found in got.items():
        want = plain.distances(plain.Text(texts[a]), plain.Text(texts[b]))
        for n, d in enumerate(want, 1):
            assert found[n] == (None if d is None else pytest.approx(d, abs=1e-9)), (a, b, n)


def test_scores_and_reports(verified, texts):
    scored, long = verified
    rows = {(r["doc_a"], r["doc_b"]): r.asDict() for r in scored.collect()}
    reports = {(r["doc_a"], r["doc_b"]): r["report"] for r in verify.reports(scored, long).collect()}
    same = 0
    for (a, b), r in rows.items():
        one, two = plain.Text(texts[a]), plain.Text(texts[b])
        cross = (a == 7) != (b == 7) and one.letters != "" and two.letters != ""
        want = plain.score(one, two, cross)
        for c, v in want.items():
            assert r[c] == (pytest.approx(v, abs=1e-7) if isinstance(v, float) else v), (a, b, c)
        if a not in (6, 7, 8) and b not in (6, 7, 8):
            assert reports[a, b] == plain.report((a, b), one, two, plain.distances(one, two), want, metrics.NAMES), (a, b)
            same += 1
    assert same >= 7


def test_listed_pairs(spark, docs, verified):
    """A pair listed three times gives three rows, each as for one; numbers are kept or made; unknown documents are left out."""
    listed = spark.createDataFrame([(7, 1, 2), (8, 1, 2), (9, 1, 2), (4, 2, 1), (5, 1, 77)], "pair_id long, doc_a long, doc_b long")
    found = pairs.pairs_explicit(listed, docs)
    assert sorted(map(tuple, found.collect())) == [(4, 2, 1), (7, 1, 2), (8, 1, 2), (9, 1, 2)]
    scored, long = verify.verify(docs, found)
    once = {(r["doc_a"], r["doc_b"]): r for r in verified[0].collect()}
    rows = scored.collect()
    assert sorted(r["pair_id"] for r in rows) == [4, 7, 8, 9]
    assert all(r["p"] == once[r["doc_a"], r["doc_b"]]["p"] and r["D"] == once[r["doc_a"], r["doc_b"]]["D"] for r in rows)
    assert long.groupBy("pair_id").count().where("count <> 17").isEmpty()
    texts = verify.reports(scored, long).collect()
    assert len(texts) == 4 and len({r["report"] for r in texts if r["doc_a"] == 1}) == 1
    assert report.rationale(long, scored).groupBy("pair_id", "part").count().where("count > 3").isEmpty()
    numbered = pairs.pairs_explicit(listed.drop("pair_id"), docs)
    assert numbered.count() == 4 == numbered.select("pair_id").distinct().count()


def test_repeated_documents(spark, docs, verified):
    """Equal rows of a document count once; one id with two texts is refused."""
    wanted = spark.createDataFrame([(1, 2)], "doc_a long, doc_b long")
    once = metrics.distances(docs, wanted).first()
    assert metrics.distances(docs.unionByName(docs.where("doc_id < 3")), wanted).collect() == [once]
    with pytest.raises(ValueError, match="several texts"):
        metrics.distances(docs.withColumn("doc_id", F.when(F.col("doc_id") == 3, 1).otherwise(F.col("doc_id"))), wanted)


def test_hot_documents(spark, docs, monkeypatch):
    """One document in nearly all pairs: its pairs are dealt over tasks, and nothing changes."""
    monkeypatch.setattr(metrics, "HOT_PAIRS", 10)
    ids = spark.range(200).select((F.col("id") + 1000).alias("doc_id"))
    many = docs.where("doc_id = 4").drop("doc_id").crossJoin(ids)
    both = docs.unionByName(many.select(docs.columns))
    wanted = ids.select(F.lit(1).cast("long").alias("doc_a"), F.col("doc_id").alias("doc_b")).unionByName(ids.where("doc_id < 1100").select(F.col("doc_id").alias("doc_a"), F.lit(2).cast("long").alias("doc_b")))
    feats = metrics.features(both, ("M3", "M5"))
    spread = metrics.attached(wanted, feats, "a", 300)
    plan = spread._jdf.queryExecution().optimizedPlan().toString()
    assert "task" in plan
    keys = [r["n"] for r in spread.where("doc_a = 1").select(F.pmod(F.xxhash64(*PAIR), F.lit(-(-200 // 37))).alias("n")).groupBy("n").count().select(F.col("count").alias("n")).collect()]
    assert len(keys) > 3 and max(keys) < 80  # no task gets most of them
    rows = metrics.compare(feats, wanted, ("M3", "M5")).collect()
    assert len(rows) == 300 and len({(r["m3"], r["m5"]) for r in rows}) == 2


def test_self_distance(docs, texts):
    got = {r["doc_id"]: r["self_distance"] for r in score.self_distance(docs).collect()}
    want = {i: plain.own_distance(plain.Text(t)) for i, t in texts.items()}
    assert got == {i: pytest.approx(d, abs=1e-9) for i, d in want.items() if d is not None} and len(got) > 5


def test_batches_of_short_texts_alone(spark):
    """No text is long enough to be cut, or has a word: the arrays are empty, the distances those of empty profiles."""
    texts = {1: "a b c", 2: "", 3: "!?", 4: "a c"}
    short = verify.prepare(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), force=True)
    wanted = spark.createDataFrame([(1, 2), (2, 3), (1, 4)], "doc_a long, doc_b long")
    for r in metrics.distances(short, wanted).collect():
        want = plain.distances(plain.Text(texts[r["doc_a"]]), plain.Text(texts[r["doc_b"]]))
        assert [r[f"m{n}"] for n in range(1, 18)] == [None if d is None else pytest.approx(d, abs=1e-9) for d in want]


def test_partial_selection():
    """The mask of the k highest, equal ones by place, against a full sort."""
    np = arrays.np
    rng = np.random.default_rng(3)
    for _ in range(300):
        score = rng.integers(0, 6, rng.integers(0, 40)) / 7
        k = int(rng.integers(0, 45))
        want = np.zeros(len(score), bool)
        want[np.lexsort((np.arange(len(score)), -score))[:k]] = True
        assert (arrays.first(score, k) == want).all()
        a, b = (np.unique(rng.integers(0, 50, rng.integers(0, 30))) for _ in range(2))
        size, at, bt = arrays.places(a, b)
        union = np.union1d(a, b)
        assert size == len(union) and (union[at] == a).all() and (union[bt] == b).all()

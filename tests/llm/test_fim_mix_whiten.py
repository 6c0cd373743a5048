"""Fill-in-middle, mixing and whitening against brute force."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from authorship_spark.llm import fim, mixing, registry, whitening

ODD = ["", None, " ", "a", "日本語 text\n\nó", "😀" * 50, "x <P> y", "<S>", "a<M", "<<P", ">S><", "a\x00b", "é́" * 9, "<P", "line\nline\r\n\nend\n", "\n", "  two  words "]


def draws(seed, i):
    x = hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
    return [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]


def units(text, unit):
    if unit == "char":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    # a word with the blanks that follow it; blanks at the beginning are a unit of their own
    return re.findall(r"\A[\s]+|[^ \t\n\v\f\r]+[ \t\n\v\f\r]*", text)


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_fill_in_middle(spark, unit):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab é日😀<PSM> \n") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i, t, "mine", "s") for i, t in enumerate(texts)] + [(None, "no id", "mine", "s"), (4, ODD[4], "mine", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, row string").repartition(3)
    out = fim.fill_in_middle(df, seed="7", unit=unit).withColumn("restored", fim.restore(F.col("output"), F.col("form")))
    assert out.columns == ["doc_id", "output", "row", "form", "n", "prefix_units", "middle_units", "restored"]
    got = {}
    for r in out.collect():
        assert got.setdefault(r["doc_id"], r) == r
    assert len(got) == len(texts) + 1 and out.count() == len(rows)
    forms = set()
    for i, text, *_ in rows:
        text, r = text or "", got[i]
        parts = units(text, unit)
        h1, h2, h3, h4 = draws("7", i)
        n = len(parts)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
        plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90
        want = ("plain", text, None, None) if plain else ("spm", f"<S>{s}<P>{p}<M>{m}", a, b - a) if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}", a, b - a)
        assert (r["form"], r["output"], r["prefix_units"], r["middle_units"]) == want and r["n"] == n and r["restored"] == text and r["row"] == "s"
        forms.add(r["form"])
    assert forms == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.where("false"), unit=unit).count() == 0


def test_fill_in_middle_of_very_long_texts(spark):
    texts = ["é" * 2_000_000, " " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = fim.fill_in_middle(df, rearranged=100).withColumn("same", fim.restore(F.col("output"), F.col("form"))).drop("output")
    assert {r["doc_id"]: (r["n"], r["same"] == texts[r["doc_id"]]) for r in rows.collect()} == {i: (len(t), True) for i, t in enumerate(texts)}


def test_unknown_unit(spark):
    with pytest.raises(Exception, match="no such unit"):
        fim.fill_in_middle(spark.createDataFrame([(1, "a")], "doc_id long, text string"), unit="page").collect()


def targets(sizes, weights, share, most):
    """The plain reading: deal by weight, cap, deal what is over again, until none is over."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        out = {s: Fraction(most * sizes[s]) if s in capped else rest * w[s] / free for s in order}
        over = {s for s in order if out[s] > most * sizes[s]}
        if not over:
            return out
        capped |= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed, tmp_path):
    rng = random.Random(seed)
    names = ["b", "a", "", "é", "😀", "B", None]
    rows = [(i, " ".join("w" for _ in range(rng.randrange(40))) + rng.choice(["", " x", "\n\t y z"]), rng.choice(names if rng.random() < 0.7 else ["a"])) for i in range(600)]
    rows += [(None, None, "only null"), (600, "", "only empty"), (601, None, None), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame([(*r, 9, "k") for r in rows], "doc_id long, text string, source string, size int, key string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    want = targets(sizes, (3, 1, 2), Fraction(3, 2), 2)
    got = registry.op12_mixing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    source_of, taken = {i: s for i, _, s in rows}, dict.fromkeys(sizes, 0)
    for r in got:
        source = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(float(want[source]))
        rate = want[source] / sizes[source] if sizes[source] else 0
        draw = int(hashlib.sha256(f"1:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        assert r["taken"] == r["size"] * (int(rate) + (draw < rate - int(rate))) <= 2 * r["size"]
        taken[source] += r["taken"]
    for source, words_taken in taken.items():
        assert abs(words_taken - want[source]) <= 0.25 * float(want[source]) + 40
    # the mix itself: as many rows, numbered; other columns stay
    sources = mixing.with_targets(mixing.cycled_weights(mixing.source_sizes(df), (3.0, 1.0, 2.0)))
    mixed = mixing.mix(df, sources)
    assert mixed.columns == ["doc_id", "text", "source", "size", "key", "source_size", "target", "copies", "copy"]
    assert sum(words(r["text"]) for r in mixed.collect()) == sum(taken.values()) and mixed.where("copy >= copies OR key <> 'k'").isEmpty()


def test_mixing_with_many_sources_and_hot_ones(spark, monkeypatch):
    """The way without a broadcast gives the same; an empty table and weights of 0 give nothing."""
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(9), "hot" if i % 2 else f"s{i % 300}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sources = mixing.with_targets(mixing.cycled_weights(mixing.source_sizes(df), (1.0, 5.0)))
    plain = sorted(map(tuple, mixing.with_copies(df, sources).collect()))
    monkeypatch.setattr(mixing, "FEW", 10)
    assert sorted(map(tuple, mixing.with_copies(df, sources).collect())) == plain and len(plain) == 6000
    assert mixing.with_targets(mixing.cycled_weights(mixing.source_sizes(df), (0.0,))).where("target <> 0").isEmpty()
    none = df.where("false")
    assert mixing.mix(none, mixing.with_targets(mixing.cycled_weights(mixing.source_sizes(none), (1.0,)))).count() == 0


def whitened(x, k):
    """By exact sums and a plain eigenvalue decomposition."""
    n, s = len(x), x.sum(axis=0)
    centred = (x * n - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return centred @ v[:, :k] / np.sqrt(e[:k]), e / e.sum(), ((n * x - s).astype(object) ** 2).sum(axis=1)


@pytest.mark.parametrize("n,dim", [(400, 5), (3000, 40), (6, 9)])
def test_whitening(spark, tmp_path, n, dim):
    rng = np.random.default_rng(n)
    vectors = rng.normal(size=(n, dim)) * np.linspace(1, 6, dim) + 40
    vectors[: n // 3] = vectors[0]  # a third of all are equal
    rows = [(i, [float(c) for c in v], "z") for i, v in enumerate(vectors)]
    odd = [(-1, None, "z"), (-2, [1.0, None, *[0.0] * (dim - 2)], "z"), (-3, [float("nan")] * dim, "z"), (-4, [float("inf")] * dim, "z"), (-5, [1e300] * dim, "z"), (-6, [], "z")]
    spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n string").repartition(40).write.parquet(f"{tmp_path}/embeddings.parquet")
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    k = min(32, dim)
    want, explained, deviation = whitened(x, k)
    got = {(r["vec_id"], r["component"]): r for r in registry.op13_whitening(spark, str(tmp_path)).collect()}
    assert set(got) == {(i, c + 1) for i in range(n) for c in range(k)}
    rank = min(k, n - n // 3)  # the equal ones are one point
    for c in range(k):
        own = np.array([got[i, c + 1]["whitened"] if got[i, c + 1]["whitened"] is not None else np.nan for i in range(n)])
        if c < rank:
            sign = np.sign(own @ want[:, c])
            assert np.allclose(own, sign * want[:, c], atol=1e-6)
            assert got[0, c + 1]["explained"] == pytest.approx(explained[c], rel=1e-6)
        else:
            assert np.isnan(own).all()
    assert all(r["deviation"] == deviation[i] and r["n"] == n and 0 <= r["identity_error"] < 1e-8 for (i, _), r in got.items())


def test_merging_is_lossless():
    """Any tree of merges gives the scatter of all vectors, a mean of a million and repeated vectors included."""
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(500, 12)) * 30).astype(np.int64) + 1_000_000
    x[:200] = x[0]
    whole = whitening.Summary.of(x)
    parts = [whitening.Summary.of(p) for p in np.split(x, [1, 2, 10, 250, 251, 400])]
    while len(parts) > 1:
        parts = [parts[i].merged(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    exact = np.array([[float(v) for v in row] for row in ((500 * x - x.sum(axis=0)).astype(object).T @ (500 * x - x.sum(axis=0)).astype(object))]) / 500**2
    for got in (whole, parts[0]):
        assert (got.n, got.sums) == (500, x.sum(axis=0).tolist()) and np.allclose(got.r.T @ got.r, exact, rtol=1e-12, atol=1e-7)


def test_whitening_of_little(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "w"), (1, [1.0, 2.0], "w"), (2, [5.0], "w"), (3, [6.0], "w")], "vec_id long, embedding array<float>, whitened string")
    models = whitening.fit(df)
    assert {d: (m.n, m.rank) for d, m in models.items()} == {2: (2, 0), 1: (2, 1)}
    rows = whitening.whiten(df, models)
    assert rows.columns == ["vec_id", "embedding", "whitened", "explained", "n", "deviation"]
    assert sorted((r["vec_id"], r["whitened"]) for r in rows.collect()) == [(1, [None, None]), (1, [None, None]), (2, [-1.0]), (3, [1.0])]
    none = df.where("false")
    assert whitening.fit(none) == {} and whitening.whiten(none, {}).count() == 0 and whitening.identity_error(whitening.whiten(none, {})) == 0
    # beyond a long the deviation is null, and all else stays exact
    model = whitening.Model(3, [3 << 45, 0], np.array([1.0, 1.0]), np.eye(2), np.array([0.5, 0.5]))
    assert model.deviation(np.array([[(1 << 45) + 5, 1], [1, 1]])) == [15**2 + 9, None]

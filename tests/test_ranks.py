"""Grams of a pair as rows, against plain Python; and that none of them is shuffled or sorted."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from authorship_spark.operators import ranks

N = 6


def grams(text, kind):
    return text.split() if kind == "w" else [text.replace(" ", "")[i : i + 2] for i in range(len(text.replace(" ", "")) - 1)]


@pytest.fixture(scope="module")
def given(spark):
    rng = random.Random(2)
    names = ["a", "b", "é", "zz", "中", "𐀀", "ab", "ba", "c", "d"]
    rows = [(i, " ".join(rng.choice(names[: 3 + i]) for _ in range(rng.randint(5, 40)))) for i in range(7)] + [(7, "")]
    rows += [(3, "a q"), (5, rows[5][1])]  # texts that share an id are counted together
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.filter(F.split("text", " "), lambda w: w != ""))
    docs = docs.withColumn("word_count", F.size("words")).withColumn("letters_lower", F.replace("text", F.lit(" "), F.lit("")))
    pairs = [(a, b) for a in range(8) for b in range(a)]
    return rows, docs, pairs, spark.createDataFrame(pairs + pairs[:3], "doc_a long, doc_b long")


def plain(rows, pairs, kind):
    share = {i: Counter(g for k, t in rows if k == i for g in grams(t, kind)) for i in range(8)}
    share = {i: {g: c / sum(found.values()) for g, c in found.items()} for i, found in share.items()}
    order = lambda keys, value: {g: n for n, g in enumerate(sorted(keys, key=lambda g: (-value(g), g.encode())), 1)}
    for a, b in pairs:
        x, y = share[a], share[b]
        union = {*x, *y}
        one, two = (lambda g: x.get(g, 0.0)), (lambda g: y.get(g, 0.0))
        yield a, b, one, two, order(x, one), order(y, two), order(union, lambda g: one(g) / 2 + two(g) / 2), order(union, lambda g: abs(one(g) - two(g)))


def rescaled(value, kept):
    total = sum(map(value, kept))
    return {g: round(value(g) / total, 9) if total > 0 else 0.0 for g in kept}


@pytest.mark.parametrize("kind", ["w", "c2"])
def test_against_plain(given, kind):
    rows, docs, pairs, wanted = given
    held = ranks.profiles_of(docs, kind)
    want = {k: [] for k in ("align", "top", "renorm", "diff", "drop")}
    for a, b, one, two, own1, own2, rk, rkd in plain(rows, pairs, kind):
        high, rest = [g for g in rk if rk[g] <= N], [g for g in rkd if rkd[g] > N]
        want["align"] += [(a, b, g, one(g), two(g)) for g in rk]
        want["top"] += [(a, b, g, rk[g], own1.get(g), own2.get(g)) for g in high]
        want["diff"] += [(a, b, g, n) for g, n in rkd.items() if n <= N]
        for name, kept in (("renorm", high), ("drop", rest)):
            t1, t2 = rescaled(one, kept), rescaled(two, kept)
            want[name] += [(a, b, g, t1[g], t2[g]) for g in kept]
    made = {
        "align": ranks.profile_align(wanted, held, kind), "top": ranks.top_combined(wanted, held, N, kind), "renorm": ranks.restrict_renorm(wanted, held, N, kind),
        "diff": ranks.top_diff(wanted, held, N, kind), "drop": ranks.drop_keys(wanted, held, N, kind),
    }
    for name, df in made.items():
        got = [tuple(round(v, 9) if isinstance(v, float) and name in ("renorm", "drop") else v for v in r) for r in df.collect()]
        assert sorted(map(str, got)) == sorted(map(str, want[name])), name


def test_no_gram_is_shuffled(given):
    _, docs, _, wanted = given
    plan = ranks.drop_keys(wanted, ranks.profiles_of(docs.dropDuplicates(["doc_id"]), "w"), N)._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("MapInArrow")]
    assert not any(step in plan for step in ("Window", "Generate explode")) and "Exchange" not in top

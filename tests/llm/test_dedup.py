"""Jaccard join, components, line dedup and fingerprints against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from authorship_spark.llm import components, jaccard_join, line_dedup, registry, spotsigs


def shingled(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows):
    sets = [(i, shingled(t)) for i, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, least[find(k)], links[k]) for k, (i, _) in enumerate(sets))


@pytest.mark.parametrize("bucket", [512, 4])
def test_near_duplicates(spark, monkeypatch, bucket):
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    rng = random.Random(4)
    word = lambda: "w%d" % rng.randrange(500)
    common = [word() for _ in range(60)]
    rows = [(100 + i, " ".join(common + [word() for _ in range(30)])) for i in range(25)]  # a passage they share
    for g in range(12):
        base = [word() for _ in range(rng.choice([3, 8, 40, 120]))]
        for k in range(rng.choice([1, 2, 5, 20])):
            words = list(base)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = word()
            rows.append((1000 * (g + 1) + k, " ".join(words)))
    rows += [(5, ""), (6, None), (7, "!!"), (8, rows[0][1]), (8, rows[0][1]), (9, rows[0][1].upper() + ".")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(df, recall=1 - 1e-9).collect())
    assert got == brute(rows)
    assert jaccard_join.near_duplicates(df.where("false")).count() == 0


def test_split_buckets_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET", 4)
    rng = random.Random(7)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(120):  # near-variants of one text, most pairs just above the threshold
        words = list(base)
        for k in rng.sample(range(0, 200, 5), 4):
            words[k] = f"v{i}x{k}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(df, threshold=0.6).collect())
    sets = [shingled(t) for _, t in rows]
    near = lambda x, y: len(x & y) >= 0.6 * len(x | y)
    assert [r[2] for r in got] == [sum(near(x, y) for y in sets) - 1 for x in sets]


def test_one_row_of_each_group_stays(spark):
    one, other, third = ("words of text number %s stand here and are its own" % k for k in ("one", "two hundred", "three thousand"))
    rows = [(7, one), (7, one), (3, other), (9, other), (9, third), (None, third), (None, "alone"), (None, "alone"), (5, ""), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates_go(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([(7, one), (3, other), (9, third), (None, "alone"), (5, ""), (6, "")], key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100, 300: 100}


def lines_left(df):
    return {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring_lines(df).collect()}


def test_line_dedup(spark):
    own = "amber birch cedar dune ember fjord".split()
    rows = [(i, f"{w} is {w} for {w}{w}\nPosted on 2024-01-{i + 10} by {i}\n\nTail {w} {w}{w} ends {w}") for i, w in enumerate(own)]
    copy = "A text of its own\nwith lines\nthat stay"
    rows += [(10 + i, copy) for i in range(6)] + [(20, None), (21, ""), (22, "alone")]
    rows += [(30 + i, f"Visit our new {w} shop for offers today\nsomething {w} else {w}") for i, w in enumerate("red blue green grey pink black white brown".split())]
    rows += [(50 + i, f"{w} wrote this long letter to the editor in spring\n{w}{w} {i} {w}") for i, w in enumerate("Anna Bert Carl Dora".split())]  # the field leads
    df = spark.createDataFrame([(i, t, "z", 7, "d") for i, t in rows], "doc_id long, text string, line string, lines_dropped long, _doc string")
    out = line_dedup.drop_recurring_lines(df)
    assert out.columns == df.columns  # the count takes the place of the column of its name
    assert {r["doc_id"]: r["lines_dropped"] for r in out.collect()}[2] == 1
    got = lines_left(df)
    assert len(got) == len(rows)
    assert got[0] == rows[0][1]  # its first place
    for i in range(1, 6):
        assert got[i] == rows[i][1].replace(f"Posted on 2024-01-{i + 10} by {i}\n", "")
    assert all(got[10 + i] == copy for i in range(6))  # copies of a document are no boilerplate
    assert (got[20], got[21], got[22]) == ("", "", "alone")
    assert "Visit" in got[30] and all("Visit" not in got[30 + i] for i in range(1, 8))
    assert "editor" in got[50] and all("editor" not in got[50 + i] for i in range(1, 4))
    assert line_dedup.drop_recurring_lines(df.where("false")).count() == 0


@pytest.mark.parametrize("footer", [1, 3])
def test_line_dedup_finds_every_common_line(spark, footer):
    """What recurs is known from how the texts are made: no line may hide because its hash is low or high."""
    rng = random.Random(footer)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    rows, want, at = [], {}, 0
    for _ in range(25):  # groups of eight unrelated documents with a footer of their own
        common = [" ".join(word() for _ in range(7)) for _ in range(footer)]
        for k in range(8):
            own = [" ".join(word() for _ in range(9)) for _ in range(8)]
            rows.append((at, "\n".join([*own, *common])))
            want[at] = "\n".join([*own, *common] if k == 0 else own)
            at += 1
    whole = "\n".join(" ".join(word() for _ in range(8)) for _ in range(6))
    long = " ".join(word() for _ in range(100_000))
    for text in [whole] * 9 + [long, long]:
        rows.append((at, text))
        want[at] = text
        at += 1
    got = lines_left(spark.createDataFrame(rows, "doc_id long, text string"))
    # with one common line none is missed; a footer of three can be both ends of the rest of its documents
    assert sum(got[i] != want[i] for i in want) <= (0 if footer == 1 else 0.03 * len(want))


def test_line_dedup_repeated_ids(spark):
    rows = [(1, "one alpha\ncommon words stand here"), (1, "two beta\ncommon words stand here"), (2, "three gamma\ncommon words stand here"), (None, "four delta\ncommon words stand here")]
    got = sorted(r["text"] for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # the first place is that of the null id; both rows of id 1 lose the line
    assert got == ["four delta\ncommon words stand here", "one alpha", "three gamma", "two beta"]


def test_fingerprints(spark):
    text = "The quick fox is on the green hill and the dog was in a small house. " * 2
    rows = [(1, text), (2, text), (3, "no anchors"), (4, ""), (5, None), (6, "The quick fox is on the green hill and the cat was in a small house."), (7, "!!!")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, signatures string")
    got = {r["doc_id"]: r for r in spotsigs.fingerprints(df).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[6]["fingerprint"] and got[3]["fingerprint"]
    assert got[4]["fingerprint"] == got[5]["fingerprint"] == got[7]["fingerprint"] == ""
    assert spotsigs.fingerprints(df.where("false")).count() == 0


def test_near_counts(spark):
    rng = random.Random(9)
    rows = []
    for g in range(60):
        base = [rng.randrange(2000) + (0 if g % 3 else 5000) for _ in range(rng.choice([1, 4, 20, 60]))]
        base += list(range(10_000, 10_010)) if g % 2 else []  # what half of them share
        for _ in range(rng.choice([1, 2, 9])):
            s = set(base)
            for _ in range(rng.randrange(3)):
                s = s - {rng.choice(sorted(s))} | {rng.randrange(100_000)}
            rows.append((len(rows), sorted(s)))
    rows += [(len(rows) + k, []) for k in range(3)]
    prints = spark.createDataFrame(rows, "doc_id long, signatures array<long>")
    got = {r["doc_id"]: r["n_near"] for r in spotsigs.near_counts(prints, F.col("doc_id") % 2 == 0).collect()}
    sets = {i: set(s) for i, s in rows}
    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y) - 1e-9
    want = {i: (sum(alike(s, t) for t in sets.values()) - 1 if s and i % 2 == 0 else None) for i, s in sets.items()}
    assert got == want and max(v or 0 for v in want.values()) > 5
    assert spotsigs.near_counts(prints.where("false"), F.col("doc_id") % 2 == 0).count() == 0


def signatures_of(text):
    """The chains of a text, read word by word."""
    words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    anchors = set(spotsigs.ANCHORS)
    content = [(w, words[k - 1] if k and words[k - 1] in anchors else "") for k, w in enumerate(words) if w not in anchors]
    chains = {(p, w, content[k + 1][0] if k + 1 < len(content) else "") for k, (w, p) in enumerate(content) if p}
    return chains or set(words)


def test_fingerprint_query(spark, tmp_path):
    """The whole query, edited texts included, against a plain reading of its contract."""
    rng = random.Random(11)
    vocabulary = "the a of in and is house green river über stone walks naïve 😀 sings old 7 tree".split()
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    rows += [(100, rows[50][1]), (102, None), (150, rows[50][1]), (151, ""), (200, "the house " * 60_000), (210, "x" * 300_000)]
    spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, n_near string, fingerprint int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in registry.op8_fingerprints(spark, str(tmp_path)).collect()}
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts, reverse=True)
    like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    sets = {i: signatures_of(t) for i, t in texts.items()}
    for k, i in enumerate(order):
        text, after = texts[i], order[(k + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[after][:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(sets[i], signatures_of(edited))) and r["near_next"] == pytest.approx(like(sets[i], sets[after]))
        assert len(r["fingerprint"]) == 16 * len(sets[i])
    assert got[50]["fingerprint"] == got[100]["fingerprint"] == got[150]["fingerprint"] and len(got) == len(rows)


def test_following(spark):
    got = {r["id"]: r["next"] for r in spotsigs.following(spark.createDataFrame([(i,) for i in (5, 1, 9, 9, 40)] + [(None,)], "doc_id long")).collect()}
    assert got == {40: 9, 9: 5, 5: 1, 1: 40}

"""Top-k search against brute force; chat formatting against a plain fold and a round trip."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from authorship_spark.llm import chat_format, kdtree


def brute(rows, queries, k):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in queries:
        if q in whole:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 60)
    monkeypatch.setattr(kdtree, "BLOCK_ROWS", 4)
    monkeypatch.setattr(kdtree, "BLOCKS", 2)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5, -0.25, 0.0, 0.0, 1.0, 0.125]) for i in range(300, 420)]  # many equal vectors
    rows += [(500, None), (501, [1.0, None, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, [1.0, 2.0]), (505, [2.0, 1.0]), (506, [1e12] * 6)]
    df = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<double>, score string")
    asked = [0, 50, 300, 350, 419, 500, 502, 504, 506]
    got = kdtree.top_k(df, df.where(F.col("vec_id").isin(asked)), k=5).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == brute(rows, asked, 5)
    assert kdtree.top_k(df.where("false"), df.where("false")).count() == 0
    # repeated rows of an id are candidates each; a repeated query asks once
    twice = df.where("vec_id IN (1, 2, 3)").unionByName(df.where("vec_id = 2"))
    got = sorted((r["rank"], r["vec_id"]) for r in kdtree.top_k(twice, twice.where("vec_id = 1").unionByName(twice.where("vec_id = 1")), k=5).collect())
    assert len(got) == 3 and [v for _, v in got].count(2) == 2


def test_hot_id(spark, monkeypatch):
    """A third of all rows are of one id, some of them alike: no shard gets them all, and each stays a candidate."""
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 50)
    rng = random.Random(4)
    rows = [(7, [rng.choice([0.5, 0.25, 1.0]), 0.5]) for _ in range(300)] + [(i, [rng.gauss(0, 0.2), rng.gauss(0, 0.2)]) for i in range(100, 700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sizes = [r["count"] for r in kdtree.dealt(df.withColumnRenamed("vec_id", "id"), 18).groupBy("shard").count().collect()]
    assert sum(sizes) == 900 and max(sizes) < 100
    got = kdtree.top_k(df, df.where("vec_id IN (7, 100, 150)"), k=40).collect()
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    for q in (100, 150):
        own = next(v for i, v in ints if i == q)
        want = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in ints if i != q)[:40]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert 7 not in [r["vec_id"] for r in got if r["query_id"] == 7] and sum(r["query_id"] == 7 for r in got) == 40


def test_tree(monkeypatch):
    """A tree of many leaves, with equal vectors and ids that repeat, against all products, with and without kth scores."""
    monkeypatch.setattr(kdtree, "LEAF_ROWS", 16)
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.integers(-300, 300, (900, 4)), np.tile([[250, -7, 0, 90]], (300, 1)), rng.integers(-2, 3, (300, 4))])
    ids = rng.permutation(1500) // 2
    tree = kdtree.build_tree(ids, vectors)
    assert (tree["left"] < 0).sum() > 60
    asked = np.arange(0, 1500, 30)
    unique = {int(q): n for n, q in zip(asked, ids[asked])}
    want = {q: sorted((-int(s), int(i)) for s, i in zip(vectors[n] @ vectors.T, ids) if i != q)[:6] for q, n in unique.items()}
    rows, names = np.array(list(unique.values())), np.array(list(unique))
    kth = np.array([-want[int(q)][-1][0] for q in names])
    for floor, known in ((np.zeros_like(kth), False), (kth, True)):
        got = {}
        for q, i, s in kdtree.search(tree, names, vectors[rows], floor, np.full(len(names), known), 6):
            got.setdefault(q, []).append((-s, i))
        assert {q: sorted(x) for q, x in got.items()} == want


def test_blocks_meet_few_shards(spark, monkeypatch):
    """Vectors in 16 far clusters: with kth scores known, blocks go to a part of the shards, and nothing is lost."""
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 40)
    monkeypatch.setattr(kdtree, "BLOCK_ROWS", 8)
    rng = random.Random(6)
    far = [[rng.choice([-4.0, 4.0]) + rng.random() for _ in range(8)] for _ in range(16)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in far[i % 16]]) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = list(range(0, 1600, 50))
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in kdtree.top_k(df, df.where("vec_id % 50 = 0")).collect()}
    assert got == brute(rows, asked, 5)
    ints = F.transform("embedding", lambda v: F.floor(256.0 * v))
    points = df.select(F.col("vec_id").alias("id"), ints.alias("vector"), F.lit(8).alias("dim"))
    trees = kdtree.grow_trees(points, 1600)
    floors = spark.createDataFrame([(q, s) for q, n, _, s in got if n == 5], "id long, floor long")
    seeded = points.join(floors, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(4)).cast("int"))
    boxes, packed = kdtree.cell_boxes(trees), kdtree.blocks_of(seeded)
    pieces = [(r["block"], r["cell"], r["shard"]) for w in range(3) for r in kdtree.routed(packed, boxes, w).select("block", "cell", "shard").collect()]
    assert trees.count() >= 40 and len(pieces) < 4 * trees.count() / 2
    # a query meets no shard twice: its home is left out of the second wave
    queries = [(q, r["cell"], r["shard"]) for w in range(3) for r in kdtree.routed(packed, boxes, w).collect() for q in kdtree._unpacked(bytes(r["queries"]))["ids"].tolist()]
    assert len(queries) == len(set(queries))


def test_fold(spark):
    log = [
        (1, 0, "message", 0, "user", "Hi <|im_end|> <\\|im"), (1, 1, "message", 1, "assistant", "He"), (1, 2, "delta", 1, None, "llo"), (1, 3, "message", 2, "user", "more"),
        (1, 4, "edit", 0, "user", "Hey"), (1, 5, "regenerate", 1, "assistant", None), (1, 6, "delta", 1, "assistant", "<|im_start|>assistant\n"), (1, 7, "delta", 1, "assistant", "x"),
        (2, 1, "delta", 0, "assistant", "b"), (2, 0, "delta", 0, "assistant", "a"), (2, 3, "message", 1, "we\nird<nl>", None), (None, 0, "message", 0, "user", "n"),
    ]
    df = spark.createDataFrame([(*r, "e") for r in log], "conv_id long, seq long, kind string, turn long, role string, text string, extra string")
    want = {1: [("user", "Hey"), ("assistant", "<|im_start|>assistant\nx")], 2: [("assistant", "ab"), ("we\nird<nl>", "")], None: [("user", "n")]}
    rows = chat_format.render(chat_format.reconstruct(df))
    rows = rows.select("*", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r["conv_id"]: r for r in rows.collect()}
    assert {k: [(t["role"], t["text"]) for t in r["turns"]] for k, r in got.items()} == want
    assert {k: r["loss"] for k, r in got.items()} == {1: "<|im_start|>assistant\nx", 2: "ab", None: ""}
    assert got[1]["formatted"].count("<|im_start|>") == 2
    assert chat_format.render(chat_format.reconstruct(df.where("false"))).count() == 0


def test_escape(spark):
    texts = ["<|", "<\\|", "<\\\\|x<||", "a<b|c", "<<|>", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat_format.escape(F.col("t")).alias("e")).withColumn("u", chat_format.unescape(F.col("e"))).collect()
    assert all(r["u"] == r["t"] and "<|" not in r["e"] for r in rows)

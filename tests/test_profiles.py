"""Profiles whose grams are counted text by text."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from authorship_spark.operators import arrays, documents, profiles, score

TEXTS = [(1, "Ab ab ΣΑΣ 東京 𝒳y ab"), (1, "ab cd"), (2, ""), (3, "x"), (4, "1 2 2"), (5, "no letters lost; " * 400)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind", ["w", "c1", "c2", "c3"])
def test_counts(spark, kind):
    """Rows of one id are counted together, no gram goes over a text's end, and grams are neither grouped nor shuffled."""
    docs = documents.tokens(spark.createDataFrame(TEXTS, "doc_id long, text string")).withColumn("letters_lower", F.lower(F.regexp_replace("text", r"[^\p{L}]", ""))).localCheckpoint()
    want = Counter()
    for r in docs.collect():
        n = 0 if kind == "w" else int(kind[1])
        held = r["letters_lower"]
        want.update((r["doc_id"], g) for g in (r["words"] if not n else [held[i : i + n] for i in range(len(held) - n + 1)]))
    rows = profiles.counts(docs, (kind,))
    found = rows.collect()
    assert {(r["doc_id"], r["gram"]): r["cnt"] for r in found} == want and len(found) == len(want)
    assert {r["doc_id"]: r["total"] for r in found} == {d: sum(c for (e, _), c in want.items() if e == d) for d, _ in want}
    assert plan(rows).count("Aggregate") == 1 and "Aggregate [doc_id" in plan(rows) and "gram" not in plan(rows).split("Aggregate [")[1].split("]")[0]


def test_parts():
    """A batch is worked on in parts of bounded size; a row that is larger is a part of its own."""
    rng = random.Random(1)
    sizes = [rng.choice([10, 1000, 100_000, 3_000_000]) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(["x" * n for n in sizes])], ["i", "x"])
    parts = list(arrays._parts(iter([batch, batch.slice(0, 0)])))
    assert np.concatenate([p.column(0).to_numpy() for p in parts]).tolist() == list(range(60))
    assert all(p.num_rows == 1 or p.nbytes <= arrays.PART_BYTES for p in parts) and len(parts) < 60


def test_self_distance_without_scripts(spark):
    """What self distances don't read isn't made."""
    seen, old = [], score.documents
    score.documents = lambda *a, **k: seen.append(old(*a, **k)) or seen[-1]
    try:
        score.self_distance(spark.createDataFrame([(1, "a b. " * 400, 800)], "doc_id long, text string, word_count int"), compression=False)
    finally:
        score.documents = old
    assert "dominant_script" not in seen[0].columns

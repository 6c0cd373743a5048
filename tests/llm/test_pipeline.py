"""The pipeline: each stage alone on awkward rows, and run() against plain readings of its stages."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, score string, predicted int, lines_dropped int, entities string, class_id long, nth long, doc string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "mine", 5, 6, "e", 7, 8, "d") for i, t in rows], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Texts of known make: clean, toxic, with boilerplate, copies, near copies, personal data, null, empty, very long."""
    rng = random.Random(21)
    at = tmp_path_factory.mktemp("tables")
    rows, kinds = [], {}

    def add(kind, text):
        kinds[len(rows)] = kind
        rows.append((len(rows), text))

    for _ in range(60):
        add("clean", words(rng, 40) + "\n" + words(rng, 30))
    for _ in range(40):
        add("toxic", words(rng, 20) + ", you are a moron and scum. " + words(rng, 20))
    for _ in range(8):
        add("footer", words(rng, 40) + "\n" + words(rng, 20) + "\nSubscribe to our letter for more of this")
    for _ in range(6):
        text = words(rng, 80)
        for _ in range(4):
            add("copy", text)
        add("near", text + " " + words(rng, 3))
    for k in range(10):
        add("personal", f"{words(rng, 30)} write to u{k % 5}@mail.org {words(rng, 10)}")
    for text in (None, "", "x" * 200_000, words(rng, 30_000)):
        add("odd", text)
    documents(spark, rows).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(kinds[i] == "toxic")) for i, _ in rows if kinds[i] in ("clean", "toxic")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), dict(rows), kinds


def test_run(spark, tables):
    at, texts, kinds = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, at), name)
        after[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert all(r["n_chars"] == len(r["text"]) and (r["score"], r["predicted"], r["lines_dropped"], r["entities"], r["nth"]) == ("mine", 5, 6, "e", 8) for r in after[name].values())
    # toxicity: the toxic ones go, and no others
    assert set(after["toxicity"]) == {i for i in texts if kinds[i] != "toxic"}
    assert all(r["text"] == (texts[i] or "") for i, r in after["toxicity"].items())
    # lines: all stay; the footer stands in its first document only
    footers = [i for i in texts if kinds[i] == "footer"]
    for i, r in after["line_dedup"].items():
        lines = (texts[i] or "").split("\n")
        assert r["text"].split("\n") == (lines[:-1] if i in footers[1:] else lines)
    # near duplicates: the least of each group by brute force over all pairs
    sets = {}
    for i, r in after["line_dedup"].items():
        w = re.findall(r"[^\W_]+", r["text"].lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    gone = {max(i, k) for i in sets for k in sets if i < k and sets[i] and sets[k] and len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k])}
    assert set(after["jaccard_join"]) == set(sets) - gone and len(gone) == 24
    # personal data: a surrogate of one value everywhere, all else as it was
    found = {}
    for i, r in after["pii"].items():
        old = after["jaccard_join"][i]["text"]
        if kinds[i] == "personal":
            (a,), (b,) = re.findall(r"\S+@\S+", old), re.findall(r"\S+@\S+", r["text"])
            assert found.setdefault(a, b) == b and r["text"] == old.replace(a, b)
        else:
            assert r["text"] == old
    assert len(set(found.values())) == len(found) == 5 and not set(found) & set(found.values())
    # packing: the ids of all pieces are those of the texts; sequences are gapless
    pieces = corpus_pipeline.run(spark, at).collect()
    own = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = {i: np.array([*own.encode(r["text"], add_special_tokens=False).ids, 2], "<u4") for i, r in after["pii"].items()}
    assert {r["doc_id"] for r in pieces} == set(ids)
    assert all(zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces)
    assert sum(r["length"] for r in pieces) == sum(map(len, ids.values()))
    ends = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024 and len(ends) <= 1.02 * -(-sum(ends.values()) // 1024) + 1


@pytest.mark.parametrize("stage", range(5))
def test_stages_alone(spark, tables, stage):
    """Null and repeated ids, null and empty texts, repeated rows, and an empty table."""
    rng = random.Random(stage)
    texts = [words(rng, 30) for _ in range(3)]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[1]), (2, texts[2]), (None, texts[2]), (None, None), (3, None), (4, ""), (4, "")]
    df = documents(spark, rows)
    got = [(r["doc_id"], r["text"] if "text" in r else None) for r in corpus_pipeline.STAGES[stage][1](spark, df, tables[0]).collect()]
    want = [(i, t or "") for i, t in rows]
    if stage == 2:
        want = [(1, texts[0]), (2, texts[1]), (2, texts[2]), (None, ""), (3, ""), (4, ""), (4, "")]
    if stage == 4:
        got, want = [i for i, _ in got], [i for i, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert corpus_pipeline.STAGES[stage][1](spark, df.where(F.lit(False)), tables[0]).count() == 0

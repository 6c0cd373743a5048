"""No text may end a job: a million of one sign, and names and addresses without end, through the operators that read texts."""

import time

import public_tokenizers as P
import pytest
import tokenizers
from pyspark.sql import functions as F

from authorship_spark.llm import fim, jaccard_join, line_dedup, mixing, packing, pii, spotsigs, toxicity

MILLION = 1_000_000
TEXTS = {
    "blanks": "a" + " " * MILLION + "b", "line ends": "a" + "\n" * MILLION + "b", "letters": "x" * MILLION, "name": "Mr A" + "a" * MILLION, "parts of a name": "Mrs A" + "-Bb" * 300_000,
    "domain": "x@b" + ".cd" * 300_000, "mail name": "a." * 500_000, "secret": "password = " + "k" * 200_000, "digits": "1" * MILLION, "numbers": "12 " * 300_000, "signs": "-" * MILLION, "initials": "Dr A. " + "B. " * 300_000,
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS.values())]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).cache()


def took(df, seconds=60):
    began = time.time()
    rows = df.collect()
    assert time.time() - began < seconds
    return rows


def test_pii(docs):
    got = {r["doc_id"]: (r["text"], [e["kind"] for e in r["entities"]]) for r in took(pii.replace_entities(docs, "key"), 120)}
    for i, (name, text) in enumerate(TEXTS.items()):
        kinds = {"name": ["person"], "parts of a name": ["person"], "domain": ["email"], "secret": ["secret"]}.get(name, [])
        assert got[i][1] == kinds and (got[i][0] != text) == bool(kinds), name
    assert got[list(TEXTS).index("name")][0].startswith("Mr ") and len(got[list(TEXTS).index("secret")][0]) == len(TEXTS["secret"])


@pytest.mark.parametrize("value", ["Mr O'Brien", "Ms O''Brien", "Dr A'b", "Dr A'bcd", "Mr A-b", "Mr A-B", "Mr A", "Mr A-", "Mr Ab'", "Mrs Anna-Maria D’Arc's", "Mr É'É", "x@b.", "x@b.c", "x@b..c", "x@b.c-.d.e", "x@b.c."])
def test_patterns_match_as_before(spark, value):
    """The forms without repeated groups find what the plain ones find."""
    name = r"\p{Lu}(?:\p{L}|['’](?=\p{Lu}\p{L}|\p{L}{3})|-(?=\p{Lu}))+"
    title = pii.KINDS["person"].replace(pii._NAME, name)
    mail = pii.KINDS["email"].replace("++", "+")
    row = spark.range(1).select(*(F.regexp_extract_all(F.lit(value), F.lit(p), F.lit(0)).alias(k) for k, p in (("a", pii.KINDS["person"]), ("b", title), ("c", pii.KINDS["email"]), ("d", mail)))).first()
    assert row["a"] == row["b"] and row["c"] == row["d"]


def test_packing(docs):
    own = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {}
    for r in took(packing.pack_documents(docs, P.path("byte_bpe_50k.json"))):
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    for i, text in enumerate(TEXTS.values()):
        assert got[i] == len(own.encode(text, add_special_tokens=False).ids) + 1


def test_others(spark, docs):
    assert len(took(line_dedup.drop_recurring_lines(docs))) == len(TEXTS)
    assert len(took(jaccard_join.near_duplicates(docs, words=5, threshold=0.8))) == len(TEXTS)
    assert len(took(fim.fill_in_middle(docs))) == len(TEXTS)
    assert len(took(mixing.source_sizes(docs))) == 1
    assert len(took(spotsigs.with_signatures(docs, "text", "a").select(F.size("a")))) == len(TEXTS)
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    lexicon, weights = toxicity.learn(docs, labels)
    assert len(took(toxicity.score(docs, lexicon, weights))) == len(TEXTS)

"""Hand-computed cases of the text functions and kernels."""

import math

import pytest
from pyspark.sql import functions as F

from authorship_spark.functions import kernels as K
from authorship_spark.functions import scripts as S
from authorship_spark.functions import text as T
from authorship_spark.functions import vectors as V
from authorship_spark.operators import documents as D


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,words",
    [
        ("Don't stop: 3.14!", ["don", "t", "stop", "3", "14"]),
        ("東京タワー is tall", ["東", "京", "タ", "ワ", "ー", "is", "tall"]),
        ("naïve café №5", ["naïve", "café", "5"]),
        ("мир42 x_y", ["мир42", "x", "y"]),
        ("", []),
    ],
)
def test_tokenize(spark, text, words):
    assert one(spark, T.tokenize(F.col("text")), text=text) == words


def test_normalize(spark):
    assert one(spark, T.normalize_text(F.col("text")), text=" \t é\r\nb\rc \n") == "é\nb\nc"


def test_letters(spark):
    assert one(spark, T.letters_lower(F.col("text")), text="ΟΔΟΣ İx") == "οδοσix"


def test_lengths(spark):
    text = 'Hi there. 3.14 is pi!? "Yes." ok|go\n\nlast line'
    assert one(spark, T.sentence_lengths(F.col("text")), text=text) == [2, 1, 3, 1, 1, 1, 2]
    assert one(spark, T.sentence_lengths(F.col("text")), text="...") == []
    assert one(spark, T.paragraph_lengths(F.col("text")), text="a b\nc\n\n\n- \nd e f") == [2, 1, 3]


@pytest.mark.parametrize(
    "text,counts",
    [
        ("a ,b  c... d - e", {0: 1, 1: 1, 2: 1, 5: 1}),
        ("rock'n'roll", {10: 2}),
        ("NASA flew", {11: 3}),
        ("we saw NASA", {}),
        ("…—–\"«“😀", {3: 1, 4: 1, 6: 1, 7: 1, 8: 1, 9: 1, 11: 1}),
    ],
)
def test_typo_vector(spark, text, counts):
    got = one(spark, V.typo_vector(F.col("text"), F.lit(1000)), text=text)
    assert {i: v for i, v in enumerate(got) if v} == counts


def test_scripts(spark):
    docs = spark.createDataFrame([(1, "abc мир"), (2, "東京 タワー"), (3, "12"), (4, "мир ab c")], "doc_id long, text string")
    got = {r["doc_id"]: r["dominant_script"] for r in D.dominant_script(docs).collect()}
    assert got == {1: "CYRILLIC", 2: "HAN", 4: "CYRILLIC"} or got[2] in ("HAN", "KATAKANA")
    assert one(spark, S.scripts_differ(F.lit("HAN"), F.lit("HIRAGANA")), x=1) is True
    assert one(spark, S.scripts_differ(F.lit(None).cast("string"), F.lit("LATIN")), x=1) is False


def arr(*x):
    return F.array(*(F.lit(float(v)) for v in x))


def test_kernels(spark):
    value = lambda c: one(spark, c, x=1)
    assert value(K.jsd_hist(arr(0.5, 0.5), arr(1, 0))) == pytest.approx(0.311278, abs=1e-6)
    assert value(K.jsd_hist(arr(0, 0), arr(1, 0))) == 0.5
    assert value(K.jsd_hist(arr(0, 0), arr(0, 0))) == 0
    assert value(K.jsd_hist(arr(1, 0), arr(0, 1))) == pytest.approx(1)
    for a, b, want in ((2, 8, 0.5), (4, 4, 0), (0, 0, 0), (2, 0.5, 0)):
        assert value(K.log_rel_diff(F.lit(float(a)), F.lit(float(b)))) == pytest.approx(want)
    assert value(K.log_rel_diff(F.lit(0.5), F.lit(0.8))) > 1e8
    canberra = (K.canberra_term(F.lit(500.0), F.lit(500.0)) + K.canberra_term(F.lit(250.0), F.lit(750.0))) / 2
    assert value(canberra) == pytest.approx((0 + 500 / 1000.5) / 2)
    assert value(K.cos_arr(arr(0, 0), arr(0, 0))) == 1 and value(K.cos_arr(arr(1, 0), arr(0, 0))) == 0
    assert value(K.ks_statistic(arr(1, 0, 0), arr(0, 0, 1))) == 1


def test_length_stats(spark):
    got = one(spark, V.length_stats(F.array(F.lit(2), F.lit(4), F.lit(9))), x=1)
    assert got["mean"] == 5 and got["sd"] == pytest.approx(math.sqrt(13))


def test_chunks(spark):
    text = " ".join(f"w{i}{'.' if i % 7 == 6 else ''}" for i in range(1500))
    docs = D.tokens(spark.createDataFrame([(1, text), (2, "a b c"), (3, "x " * 300)], "doc_id long, text string"))
    got = D.split_chunks(docs).orderBy("doc_id", "chunk_no").collect()
    assert "".join(r["text"] for r in got if r["doc_id"] == 1) == text
    assert [r["chunk_no"] for r in got if r["doc_id"] == 1] == [0, 1, 2, 3]
    assert len([r for r in got if r["doc_id"] == 3]) == 2 and not [r for r in got if r["doc_id"] == 2]


def test_top_habit_rounds_as_printf(spark):
    """Halves go to even, and the exact value is rounded, not its shortest decimal form."""
    values = [515.625, 0.125, 0.375, 1.005, 2.675, 0.145, 0.165, 1234567.895, 0.0, 0.004, 1e-9, 999.995, 12345678901.625]
    rows = spark.createDataFrame([(i, [0.0, v] + [0.0] * 10) for i, v in enumerate(values)], "i int, typo array<double>")
    got = {r["i"]: r["habit"] for r in rows.select("i", V.top_habit(F.col("typo")).alias("habit")).collect()}
    assert got == {i: f"{V.HABITS[1] if v else V.HABITS[0]}={v:.2f}" for i, v in enumerate(values)}

"""Counts and shares of words and letter n-grams per document, and what follows from them.

Kinds: ``w`` words, ``c1``, ``c2``, ``c3`` letter n-grams. Documents are dealt by
doc_id before their grams are taken, so the texts are shuffled once, grams are counted
text by text (see arrays.py), and ranks and packing stay on that one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.helpers import ready
from . import arrays

KINDS = ("w", "c1", "c2", "c3")


def counts(docs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(doc_id, kind, gram, cnt, total); a document without grams of a kind has no rows of it.

    Rows of one id meet as texts; from there on a document's distinct grams are made
    together, so grams are neither shuffled nor held in a table of a task.
    """
    ready(docs.sparkSession)
    held = [F.flatten(F.collect_list("words")).alias("words")] if "w" in kinds else []
    held += [F.collect_list("letters_lower").alias("letters")] if kinds != ("w",) else []
    docs = docs.groupBy("doc_id").agg(*held)
    docs = docs.select("doc_id", *(arrays.grams(k, F.col("words" if k == "w" else "letters")).alias(k) for k in kinds))
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("grams")) for k in kinds))
    # the outer forms: for the inner ones Spark infers filters that would make the grams a second time
    rows = docs.select("doc_id", F.explode_outer(each).alias("x")).select("doc_id", "x.kind", F.explode_outer("x.grams").alias("g")).where("g IS NOT NULL")
    return rows.select("doc_id", "kind", "g.gram", "g.cnt", "g.total")


def rel_freq(counted: DataFrame) -> DataFrame:
    """Adds rel, the share of all grams of the document and kind, and rel_1000."""
    total = F.col("total")
    return counted.withColumn("rel", F.col("cnt") / total).withColumn("rel_1000", F.col("cnt") * 1000.0 / total).drop("total")


def top_keys(profile: DataFrame, n: int) -> DataFrame:
    """The n grams of the highest shares of each document and kind, by gram on ties; adds rk."""
    order = Window.partitionBy("doc_id", "kind").orderBy(F.desc("rel"), "gram")
    return profile.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= n)


def shannon(profile: DataFrame) -> DataFrame:
    """(doc_id, kind, entropy) in nats."""
    return profile.groupBy("doc_id", "kind").agg(F.sum(-F.col("rel") * F.log("rel")).alias("entropy"))


def _word_sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("vocab"), F.count_if(F.col("cnt") == 1).alias("once"), F.sum("cnt").alias("n"),
        F.sum(F.col("cnt") * F.col("cnt")).alias("squares"), F.sum(-F.col("rel") * F.log("rel")).alias("h"),
    ]


def _slope(rk: str) -> Column:
    """Least-squares slope of log count on log rank, ranks 10 to 1000; null if there is none."""
    late = F.col(rk).between(10, 1000)
    return F.regr_slope(F.when(late, F.log("cnt")), F.when(late, F.log(rk)))


def rich(value=lambda x: F.coalesce(x, F.lit(0.0))) -> list[Column]:
    n, vocab = F.nullif("n", F.lit(0)).cast("double"), F.nullif("vocab", F.lit(0))
    return [
        value(vocab / F.sqrt(n)).alias("guiraud"),
        value(F.col("once") / vocab).alias("hapax_ratio"),
        value((F.col("squares") - n) * 1e4 / (n * n)).alias("yule_k"),
        value(F.col("h")).alias("entropy"),
        F.coalesce("vocab", F.lit(0)).alias("vocab"),
    ]


def richness(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, guiraud, hapax_ratio, yule_k, entropy, vocab) for every document; zeros without words."""
    found = words.groupBy("doc_id").agg(*_word_sums())
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", *rich())


def zipf_slope(words: DataFrame) -> DataFrame:
    """(doc_id, zipf_slope): least-squares slope of log count on log rank, ranks 10 to 1000; 0 if there is none."""
    rk = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("cnt"), "gram"))
    return words.select("doc_id", "cnt", rk.alias("rk")).groupBy("doc_id").agg(F.coalesce(_slope("rk"), F.lit(0.0)).alias("zipf_slope"))

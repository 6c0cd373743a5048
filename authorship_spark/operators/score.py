"""From distances to the probability of one author."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import clamp, logistic
from ..functions.scripts import scripts_differ
from ..functions.text import CRITICAL_WORDS, SHORT_WORDS
from ..storage import stored
from . import metrics
from .align import keys
from .documents import documents, split_chunks
from .pairs import chunk_id

# Fixed constants of the model.
TOPIC_K, TOPIC_CENTER = 120.0, 0.66
SELF_K, SELF_CENTER, SELF_MIX = 22.0, 0.03, 0.4
FULL_WORDS = 2000
CHUNK_WORDS = 100
MOST_CHUNKS = 4


def self_distance(docs: DataFrame, compression: bool = True) -> DataFrame:
    """(doc_id, self_distance): mean distance of a document's chunks from each other.

    Once per document, whatever number of pairs it's in; stored. Documents with fewer than
    two chunks, or a chunk of under 100 words, have no row.
    """
    only = tuple(m for m in metrics.WEIGHTS if compression or m != "M16")
    chunks = split_chunks(docs.withColumn("doc_id", F.struct(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("of"))))
    chunks = chunks.select(chunk_id(F.col("doc_id"), F.col("chunk_no")).alias("doc_id"), "text", F.col("chunk_no").alias("nth"))
    # a text's chunks lie in order where it lies: from the text to its chunks' distances nothing is shuffled or stored
    rows = metrics.near(documents(chunks, compose=False, script=False), MOST_CHUNKS - 1, MOST_CHUNKS, only)
    rows = rows.select("doc_a.whole.*", F.least("a.word_count", "b.word_count").alias("words"), metrics.weighted_distance().alias("d"))
    held = rows.groupBy("id").agg(F.avg("d").alias("self_distance"), F.min("words").alias("least"), F.min("of").alias("x"), F.max("of").alias("y"))
    held = held.withColumn("self_distance", F.when(F.col("x") != F.col("y"), F.raise_error(F.lit("ids stand for several texts each")).cast("double")).otherwise(F.col("self_distance")))
    return stored(held.where(F.col("least") >= CHUNK_WORDS).select(F.col("id").alias("doc_id"), "self_distance"), "own")


def verdict(p: Column) -> Column:
    return F.when(p >= 0.85, "same_high").when(p >= 0.65, "same_medium").when(p > 0.35, "inconclusive").when(p > 0.15, "diff_medium").otherwise("diff_high")


def scores(rows: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """One row per pair of ``metrics.distances``, scored; ``own`` holds self distances per document.

    Columns: pair_id where the rows have it, doc_a, doc_b, D, S, p_topic, self_distance, p_self, p0, f, p, margin,
    verdict, warnings, identical, words_a, words_b, and title, dominant_script and
    charset of both where the documents have them.
    """
    if own is None:
        rows = rows.withColumn("self_a", F.lit(None).cast("double")).withColumn("self_b", F.lit(None).cast("double"))
    else:
        for side in "ab":
            one = own.select(F.col("doc_id").alias(f"doc_{side}"), F.col("self_distance").alias(f"self_{side}"))
            rows = rows.join(one, f"doc_{side}", "left")
    n1, n2 = F.col("a.word_count"), F.col("b.word_count")
    empty = F.sha2(F.lit(""), 256)
    rows = rows.withColumn("identical", (F.col("a.text_hash") == F.col("b.text_hash")) & (F.col("a.text_hash") != empty))
    rows = rows.withColumn("D", F.when(F.col("identical"), 0.0).otherwise(metrics.weighted_distance())).withColumn("S", 1 - F.col("D"))
    rows = rows.withColumn("p_topic", logistic(TOPIC_K, F.col("S") - TOPIC_CENTER))
    rows = rows.withColumn("self_distance", F.when(~F.col("identical"), (F.col("self_a") + F.col("self_b")) * 0.5))
    rows = rows.withColumn("p_self", logistic(SELF_K, F.col("self_distance") - F.col("D") - SELF_CENTER))
    used = F.coalesce(F.col("p_self") > 0.5, F.lit(False))
    mixed = F.when(used, (1 - SELF_MIX) * F.col("p_topic") + SELF_MIX * F.col("p_self"))
    rows = rows.withColumn("p0", F.greatest("p_topic", mixed))
    critical = F.least(n1, n2) < CRITICAL_WORDS
    cross = scripts_differ(F.col("a.dominant_script"), F.col("b.dominant_script")) if "dominant_script" in rows.select("a.*").columns else F.lit(False)
    unstable = used & (F.col("p_topic") < 0.35)
    f = F.least(F.lit(1.0), F.log10(1.0 + F.least(n1, n2)) / math.log10(1.0 + FULL_WORDS))
    f = f * F.when(critical, 0.8).otherwise(1.0) * F.when(cross, 0.7).otherwise(1.0) * F.when(unstable, 0.9).otherwise(1.0)
    rows = rows.withColumn("f", F.when(F.col("identical"), 1.0).otherwise(F.least(F.lit(1.0), f)))
    p = 0.5 + (F.col("p0") - 0.5) * F.col("f")
    rows = rows.withColumn("p", clamp(F.when(F.col("identical"), F.greatest(p, F.lit(0.99))).otherwise(p), 0.001, 0.999))
    codes = [(n1 < SHORT_WORDS, "short_1"), (n2 < SHORT_WORDS, "short_2"), (critical, "critical"), (cross, "cross_script"), (unstable, "self_unstable"), (F.col("identical"), "identical")]
    about = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in ("title", "dominant_script", "charset") for s in "ab" if c in rows.select("a.*").columns]
    return rows.select(
        *keys(rows), "D", "S", "p_topic", "self_distance", "p_self", "p0", "f", "p",
        (0.03 + 0.25 * (1 - F.col("f"))).alias("margin"),
        verdict(F.col("p")).alias("verdict"),
        F.filter(F.array(*(F.when(c, F.lit(name)) for c, name in codes)), lambda w: w.isNotNull()).alias("warnings"),
        "identical", n1.alias("words_a"), n2.alias("words_b"), *about,
    )

"""Mixing sources to target weights: how often each document enters a training mix.

Words are summed by source, a target for each source follows from its weight, and a
source's rate is its target over its words. Each document then enters floor(rate)
times, and once more with a probability of the rate's fraction, by a draw that
hangs on a seed and its id alone: runs agree, and no document waits for another.
Only SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, column, join_hot, materialize, partitions, text_of, whole_row, with_columns

#: A word is a run of signs other than ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def _key(source_col: str) -> Column:
    """A source as a key that is never null: the null source is one of its own."""
    return F.coalesce(F.concat(F.lit("="), column(source_col).cast("string")), F.lit("-"))


def source_sizes(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(key, source, docs, source_size): documents and words of each source; null is a source of its own. Stored."""
    words = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
    rows = docs.select(_key(source_col).alias("key"), column(source_col).cast("string").alias("source"), words.alias("size"))
    found = rows.groupBy("key").agg(F.max("source").alias("source"), F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    return materialize(found, "sources")


def cycled_weights(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """``sizes`` with ``weight``: the given ones in turn, over the sources by code point, null last.

    Sources are dealt by range and numbered in their range, so that no task gets all
    of them; only the number of sources in each range comes to the driver.
    """
    spark = sizes.sparkSession
    dealt = sizes.repartitionByRange(partitions(spark), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    ahead, total = {}, 0
    for r in dealt.groupBy("part").count().orderBy("part").collect():  # a row a partition
        ahead[r["part"]], total = total, total + r["count"]
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    start = F.element_at(F.create_map(*(F.lit(x) for pair in ahead.items() for x in pair)), F.col("part")) if ahead else F.lit(0)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place + start, F.lit(len(weights))) + 1).cast("int"))
    return materialize(dealt.withColumn("weight", weight).drop("part"), "weights")


def with_targets(sources: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """Adds ``target`` to sources (source_size, weight): words that the mix shall take of each.

    ``share`` times all words are dealt by weight. No target goes over ``most`` times
    its source's words; what is over is dealt again by weight among the others, until
    none is over. One small sum a round decides; a round that caps no further source is
    the last. Where every source is capped, or the weights are 0, less is taken.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap, level, capped = F.col("source_size") * most, 0.0, -1
    over = F.lit(False)
    while True:
        now = sources.agg(F.sum(F.when(~over, F.col("weight"))).alias("free"), F.sum(F.when(over, cap)).alias("held"), F.count_if(over).alias("n")).first()
        if now["n"] == capped or not now["free"]:
            break
        capped, level = now["n"], (share * total - (now["held"] or 0)) / now["free"]
        over = F.col("weight") * level > cap
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * level))


def draw(id_col: str, seed: str) -> Column:
    """A number from 0 up to 1 from the seed and the row's id: 52 bits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(column(id_col).cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, sources: DataFrame, seed: str = "1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target and copies: how often the mix takes each.

    ``sources`` has key, docs, source_size and target (see source_sizes and
    with_targets). A null text is empty; a source without words has rate 0. All rows
    and columns stay; the new ones take the place of columns of their names. Rows of one
    id share its draw, so equal rows enter equally often; an empty table gives no rows.

    Sources up to FEW rows are broadcast, and no document is shuffled; more of them are
    joined by key, with hot sources apart.
    """
    size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
    rows = docs.select(whole_row(docs).alias("row"), size.alias("size"), draw(id_col, seed).alias("draw"), _key(source_col).alias("key"))
    held = sources.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs")).first()
    values = sources.select("key", "docs", "source_size", "target")
    rows = rows.join(F.broadcast(values), "key") if held["n"] <= FEW else join_hot(rows, values, ["key"], "docs", held["docs"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = (F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("long")).cast("long")
    return with_columns(rows, docs, {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies})


def mix(docs: DataFrame, sources: DataFrame, seed: str = "1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document's row as often as with_copies says, with ``copy`` from 0."""
    rows = with_copies(docs, sources, seed, id_col, text_col, source_col).where("copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))

"""Pairs of documents: given, or built in blocks. A pair is (doc_a, doc_b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def pairs_explicit(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(pair_id, doc_a, doc_b): the given pairs whose documents are both there, as often as they are given; the order of the two is kept.

    A pair_id that is given stays; otherwise rows are numbered, and the list is stored so
    that the numbers don't change.
    """
    if "pair_id" not in pairs.columns:
        pairs = stored(pairs.select("doc_a", "doc_b").withColumn("pair_id", F.monotonically_increasing_id()), "listed")
    ids = docs.select("doc_id").distinct()
    a = pairs.select("pair_id", "doc_a", "doc_b").join(ids.withColumnRenamed("doc_id", "doc_a"), "doc_a", "left_semi")
    return a.join(ids.withColumnRenamed("doc_id", "doc_b"), "doc_b", "left_semi").select("pair_id", "doc_a", "doc_b")


def _numbered(docs: DataFrame, block: tuple[str, ...]) -> DataFrame:
    """(doc_id, block columns, at): each document's place in its block by id, from 0.

    Ids are dealt out by range and numbered in their range; a block that goes on from
    an earlier range adds what it had there. A range has one such block at most, so
    there are no more of these sums than ranges, and no task gets a whole block.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", *block).repartitionByRange(n, *block, "doc_id").withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "ranges")  # another sampling could draw other borders
    inside = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("part", *block).orderBy("doc_id")) - 1)
    held = dealt.groupBy("part", *block).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*block).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = held.withColumn("ahead", before).where("ahead IS NOT NULL")
    ahead = F.broadcast(ahead.select(F.struct("part", *block).alias("key"), "ahead"))
    met = inside.join(ahead, F.struct(inside["part"], *(inside[c] for c in block)).eqNullSafe(ahead["key"]), "left")
    return met.select("doc_id", *block, (F.col("nth") + F.coalesce("ahead", F.lit(0))).alias("at"))


def pairs_blocked(docs: DataFrame, block: tuple[str, ...] = ("lang", "source"), window: int = 3) -> DataFrame:
    """Each document with the next ``window`` ones of its block, by id.

    Places in the block fall into stretches of ``window``; a document meets those of
    its own stretch and the next one, so the work grows with documents times window,
    whatever the size of a block. A window as large as the largest block gives all
    pairs of every block, which is quadratic and so has to be asked for in this way.
    Null blocks are blocks; a pair of one id is none.
    """
    placed = stored(_numbered(docs, block), "places").withColumn("stretch", F.floor(F.col("at") / window))
    a = placed.withColumn("near", F.explode(F.array("stretch", F.col("stretch") + 1)))
    a = a.select(F.col("doc_id").alias("doc_a"), F.col("at").alias("x"), F.struct(*block, F.col("near").alias("stretch")).alias("key"))
    b = placed.select(F.col("doc_id").alias("doc_b"), F.col("at").alias("y"), F.struct(*block, "stretch").alias("key_b"))
    met = a.join(b, F.col("key").eqNullSafe(F.col("key_b")) & (F.col("y") > F.col("x")) & (F.col("y") <= F.col("x") + window))
    return met.where("doc_a <> doc_b").select("doc_a", "doc_b")


def stretches(docs: DataFrame, block: tuple[str, ...], window: int, size: int) -> DataFrame:
    """(doc_id, stretch, nth): the places of ``pairs_blocked`` in stretches of ``size`` documents of a block, for ids that don't repeat.

    ``nth`` counts from 0 in a stretch. The first ``window`` documents of the next stretch follow as its
    places from ``size`` on: with them a stretch has all that its own documents meet. ``window`` is no larger than ``size``.
    """
    placed = stored(_numbered(docs, block), "places")
    own, nth = F.floor(F.col("at") / size), F.col("at") % size
    guest = (nth < window) & (own > 0)
    held = F.array_append(F.when(guest, F.array(F.struct((own - 1).alias("stretch"), (nth + size).alias("nth")))).otherwise(F.array().cast("array<struct<stretch:bigint,nth:bigint>>")), F.struct(own.alias("stretch"), nth.alias("nth")))
    return placed.select("doc_id", F.inline(held))


def identical(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds ``identical``: both normalised texts are equal and not empty, by their digests."""
    own = docs.select("doc_id", "text_hash", (F.length("text") > 0).alias("some"))
    a = own.select(F.col("doc_id").alias("doc_a"), F.col("text_hash").alias("ha"), "some")
    b = own.select(F.col("doc_id").alias("doc_b"), F.col("text_hash").alias("hb"))
    return pairs.join(a, "doc_a").join(b, "doc_b").select("doc_a", "doc_b", ((F.col("ha") == F.col("hb")) & F.col("some")).alias("identical"))


def chunk_id(doc_id: Column, chunk_no: Column) -> Column:
    """Id of a chunk as a document of its own, whatever the document's id."""
    return F.struct(doc_id.alias("whole"), chunk_no.alias("chunk_no"))


def chunk_pairs(chunks: DataFrame) -> DataFrame:
    """(doc_id, doc_a, doc_b): all pairs of the 2 to 4 chunks of each document, by their ids."""
    held = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list("chunk_no")).alias("nos"))
    a = held.select("doc_id", "nos", F.explode_outer("nos").alias("i"))
    both = a.select("doc_id", "i", F.explode_outer("nos").alias("j")).where("i < j")
    return both.select("doc_id", chunk_id(F.col("doc_id"), F.col("i")).alias("doc_a"), chunk_id(F.col("doc_id"), F.col("j")).alias("doc_b"))

"""Document fingerprints by spot signatures.

Wherever a content word follows a common word (an anchor), the anchor and the
chain of content words from there on make one signature; a document's fingerprint
is its set of signatures (64 bits each). Layout, markup and lists, which have few
anchors, weigh little. A search for near documents partitions the sets by their
length: those of too different lengths can't be alike. Inside a partition a set meets
those that hold one of its rarest signatures, and is compared with them by Jaccard
similarity, pruned by their lengths. Only SQL functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, join_hot, materialize, partitions, text_of

#: Anchors: common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their there they this to was were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "als am auf aus bei das dass dem den der die ein eine einem einen einer er es für hat ich im ist mit nach nicht noch sein sich sie sind so über um und von vor war wie wir zu zum zur "
    "al como con del el ella en entre era es esta este fue ha hay las lo los más me mi muy no nos o para pero por porque se ser si sin sobre su sus también te tiene una uno y ya"
).split()


def with_signatures(rows: DataFrame, text: str, name: str, chain: int = 2) -> DataFrame:
    """Adds ``name``: the sorted distinct signatures (64 bits each) of the column ``text``.

    A text without any chain after an anchor has its single words as signatures;
    one without words has none. Each step is a column, so none is computed twice.
    """
    anchor = lambda w: w.isin(*sorted(set(ANCHORS)))
    nothing = F.array(F.lit(""))
    rows = rows.withColumn("_words", F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", -1))
    # content words; those right after an anchor carry it before a bar
    mark = lambda p, w: F.when(w.isNull() | (w == "") | anchor(w), F.lit("")).when(anchor(p), F.concat(p, F.lit("|"), w)).otherwise(w)
    rows = rows.withColumn("_marked", F.filter(F.zip_with(F.concat(nothing, "_words"), "_words", mark), lambda w: w != ""))
    chains = F.col("_marked")
    for k in range(1, chain):
        later = F.concat(F.slice("_marked", k + 1, 1 << 30), F.array_repeat(F.lit(""), k))
        # a chain whose head carries no anchor is given up at once
        chains = F.zip_with(chains, later, lambda a, b: F.when(F.contains(a, F.lit("|")), F.concat(a, F.lit(" "), F.substring_index(F.coalesce(b, F.lit("")), "|", -1))).otherwise(a))
    hashed = lambda x: F.transform(x, lambda w: F.xxhash64(w))
    rows = rows.withColumn("_chains", F.filter(chains, lambda w: F.contains(w, F.lit("|"))))
    found = F.when(F.size("_chains") > 0, hashed(F.col("_chains"))).otherwise(hashed(F.filter("_words", lambda w: w != "")))
    return rows.withColumn(name, F.array_sort(F.array_distinct(found))).drop("_words", "_marked", "_chains")


def fingerprint(sigs: Column) -> Column:
    """A set of signatures as a string: 16 hex digits each, in order."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s)), 16, "0")), "")


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 where their lengths rule ``at_least`` out.

    Two empty sets are alike (1), an empty and another one are not (0).
    """
    common = F.size(F.array_intersect(a, b))
    most, least = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    exact = common / (F.size(a) + F.size(b) - common)
    return F.when(most == 0, F.lit(1.0)).when((least == 0) | (least < at_least * most), F.lit(0.0)).otherwise(exact)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, signatures and fingerprint of every row; a null text counts as empty."""
    rows = with_signatures(docs.select(F.col(id_col), text_of(text_col).alias("_text")), "_text", "signatures")
    return rows.select(id_col, "signatures", fingerprint(F.col("signatures")).alias("fingerprint"))


def near_counts(prints: DataFrame, asked: Column, threshold: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, n_near) of every row of ``prints`` (``id_col``, signatures).

    n_near is the number of other rows whose likeness to this one is ``threshold`` or
    more, exactly; it's null where ``asked`` (a column of ``prints``) isn't true and
    for empty sets. Rows of one fingerprint are one unit, so copies are counted and
    not met one by one. Every asked unit meets all units of its own and the adjoining
    partitions by length (a geometric step apart) that hold one of its rarest
    signatures, of which a set that is alike must hold one.
    """
    few = lambda df: F.broadcast(df) if df.count() <= FEW else df
    rows = prints.select(F.col(id_col), "signatures", F.coalesce(asked, F.lit(False)).alias("asked"), F.unhex(F.md5(fingerprint(F.col("signatures")))).alias("unit"))
    units = rows.where(F.size("signatures") > 0).groupBy("unit").agg(F.any_value("signatures").alias("signatures"), F.count(F.lit(1)).alias("copies"), F.max("asked").alias("asked"))
    size = F.size("signatures")
    part = F.floor(F.log(size.cast("double")) / math.log(1 / threshold) + 1e-9).cast("int") if threshold < 1 else size
    units = materialize(units.withColumn("part", part), "units")
    ours = units.where("asked").select("unit", F.explode("signatures").alias("s"))
    times = units.select(F.explode("signatures").alias("s")).join(few(materialize(ours.select("s").distinct(), "asked")), "s", "left_semi")
    times = materialize(times.groupBy("s").agg(F.count(F.lit(1)).alias("times")), "times")
    rarest = F.transform(F.array_sort(F.collect_list(F.struct("times", "s"))), lambda x: x["s"])  # one set's signatures
    rare = ours.join(times, "s").groupBy("unit").agg(rarest.alias("rare"))
    enough = (F.size("rare") - F.ceil(threshold * F.size("rare") - 1e-9) + 1).cast("int")
    queries = units.where("asked").select("unit", F.col("signatures").alias("own"), F.col("part").alias("p")).join(rare, "unit").withColumn("rare", F.slice("rare", F.lit(1), enough))
    queries = materialize(queries.select(F.col("unit").alias("query"), "own", "rare", "p"), "queries")
    index = queries.select("query", "p", F.explode("rare").alias("s"))
    index = few(index.withColumn("part", F.explode(F.array(F.col("p") - 1, F.col("p"), F.col("p") + 1))).drop("p"))
    met = units.select("signatures", "copies", "part", F.explode("signatures").alias("s")).join(index, ["part", "s"]).join(queries.drop("p"), "query")
    least, most = F.least(size, F.size("own")), F.greatest(size, F.size("own"))
    # a pair is judged once: at the first of the rare signatures that both hold
    met = met.where((least >= threshold * most) & (F.col("s") == F.get(F.array_intersect("rare", "signatures"), F.lit(0))))
    near = met.where(likeness(F.col("own"), F.col("signatures"), threshold) >= threshold - 1e-9).groupBy("query").agg(F.sum("copies").alias("near"))
    found = units.where("asked").select("unit", F.col("copies").alias("k")).join(near.withColumnRenamed("query", "unit"), "unit").select("unit", (F.col("near") - 1).alias("n_near"), "k")
    wanted = rows.where("asked").select(id_col, "unit")
    counted = join_hot(wanted, materialize(found, "near"), ["unit"], "k", wanted.count(), "left").select(id_col, "n_near")
    return counted.unionByName(rows.where("NOT asked").select(id_col, F.lit(None).cast("long").alias("n_near")))


def following(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, next): the next smaller id, and for the smallest the largest; null ids have none.

    Ids are dealt out by range, numbered in their range, and linked over its borders.
    """
    ids = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    dealt = ids.repartitionByRange(partitions(docs.sparkSession), "id").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")  # another sampling could draw other borders
    inside = dealt.withColumn("next", F.lag("id").over(Window.partitionBy("part").orderBy("id")))
    ends = dealt.groupBy("part").agg(F.max("id").alias("last"))
    before = F.lag("last").over(Window.orderBy("part"))  # one row per range
    ends = ends.withColumn("before", F.coalesce(before, F.max("last").over(Window.partitionBy())))
    return inside.join(F.broadcast(ends), "part").select("id", F.coalesce("next", "before").alias("next"))

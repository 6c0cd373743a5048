"""Profiles of both documents of a pair, aligned gram by gram, as rows.

This is for who wants to see the grams: a row for each of them. Profiles travel to
their pairs as arrays and are aligned, ranked and rescaled there (see arrays.py), so no
gram is shuffled or sorted as a row, and those that aren't asked for are never rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import arrays
from .align import PAIR
from .metrics import attached


def profiles_of(docs: DataFrame, kind: str, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``also``, packed profile): a row for each of the documents (text, words or letters_lower). Stored; map-only."""
    return stored(arrays.packed(docs, (kind,), False, [F.col(c) for c in ("doc_id", *also)]).select("doc_id", *also, *arrays.packed_columns((kind,), False)), "profiles")


def _merged(rows: DataFrame, kind: str) -> DataFrame:
    """A profile for each id: texts that share one are counted together."""
    gram, cnt = arrays.packed_columns((kind,), False)
    rows = rows.select("doc_id", gram, cnt)
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if ids.isEmpty():
        return rows
    each = rows.join(ids, "doc_id", "left_semi").select("doc_id", F.explode_outer(F.arrays_zip(gram, cnt)).alias("x"))
    sums = each.groupBy("doc_id", F.col(f"x.{gram}").alias("g")).agg(F.sum(f"x.{cnt}").cast("int").alias("c"))
    held = sums.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("g").isNotNull(), F.struct("g", "c")))).alias("x"))
    return rows.join(ids, "doc_id", "left_anti").unionByName(held.select("doc_id", F.col("x.g").alias(gram), F.col("x.c").alias(cnt)))


def _aligned(pairs: DataFrame, profiles: DataFrame, kind: str, columns: tuple[str, ...], kept: tuple[str, int, int | None] | None = None) -> DataFrame:
    pairs, profiles = stored(pairs.select(*PAIR).distinct(), "pairs"), _merged(profiles, kind)
    total = pairs.count()
    return arrays.aligned(attached(attached(pairs, profiles, "a", total), profiles, "b", total), kind, columns, kept)


def profile_align(pairs: DataFrame, profiles: DataFrame, kind: str = "w") -> DataFrame:
    """(doc_a, doc_b, gram, r1, r2): the key union, 0 on the side that lacks a gram."""
    return _aligned(pairs, profiles, kind, ("r1", "r2"))


def top_combined(pairs: DataFrame, profiles: DataFrame, n: int, kind: str = "w") -> DataFrame:
    """(doc_a, doc_b, gram, rk, own1, own2): the n highest by the mean of both shares, by gram on ties; their ranks in either profile, null on the side that lacks a gram."""
    return _aligned(pairs, profiles, kind, ("rk", "own1", "own2"), ("rk", 1, n))


def restrict_renorm(pairs: DataFrame, profiles: DataFrame, n: int, kind: str = "w") -> DataFrame:
    """(doc_a, doc_b, gram, t1, t2): the shares of the n highest, rescaled to a sum of 1 on each side."""
    return _aligned(pairs, profiles, kind, ("t1", "t2"), ("rk", 1, n))


def top_diff(pairs: DataFrame, profiles: DataFrame, n: int, kind: str = "w") -> DataFrame:
    """(doc_a, doc_b, gram, rkd): the n grams of the greatest difference of the shares, by gram on ties."""
    return _aligned(pairs, profiles, kind, ("rkd",), ("rkd", 1, n))


def drop_keys(pairs: DataFrame, profiles: DataFrame, n: int, kind: str = "w") -> DataFrame:
    """(doc_a, doc_b, gram, t1, t2): the shares without those n grams, rescaled to a sum of 1 on each side."""
    return _aligned(pairs, profiles, kind, ("t1", "t2"), ("rkd", n + 1, None))

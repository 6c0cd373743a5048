"""The 17 style distances of a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as T
from ..functions.helpers import deflate_size
from ..functions.vectors import smooth_props
from ..storage import stored
from . import align, arrays, profiles
from .align import PAIR

#: Fixed weights, in the order of evaluation.
WEIGHTS = {
    "M1": 0.18, "M2": 0.12, "M3": 0.12, "M4": 0.08, "M5": 0.04, "M6": 0.10, "M7": 0.06, "M8": 0.12, "M9": 0.08,
    "M10": 0.04, "M11": 0.06, "M12": 0.04, "M13": 0.10, "M14": 0.04, "M15": 0.04, "M16": 0.10, "M17": 0.10,
}
NAMES = {
    "M1": "letter 3-gram cosine", "M2": "letter 2-gram cosine", "M3": "frequent words (Delta-like)", "M4": "word divergence", "M5": "letter divergence",
    "M6": "sentence lengths", "M7": "word lengths", "M8": "punctuation", "M9": "vocabulary richness", "M10": "frequent-word overlap", "M11": "typography",
    "M12": "cosine Delta (z)", "M13": "robustness of difference", "M14": "Zipf slope", "M15": "paragraph rhythm", "M16": "cross-compression", "M17": "3-gram min-max",
}
#: Profiles that each metric reads.
KINDS_OF = {"M1": ("c3",), "M2": ("c2",), "M3": ("w",), "M4": ("w",), "M5": ("c1",), "M9": ("w",), "M10": ("w",), "M13": ("c3", "w"), "M14": ("w",), "M17": ("c3",)}
#: Flat columns of a document that each metric reads, beside those that all do.
FLAT_OF = {"M6": ("sentence_hist",), "M7": ("word_hist",), "M8": ("punct",), "M11": ("typo",), "M15": ("paragraph_hist", "paragraph_count")}
_ABOUT = ("dominant_script", "title", "charset")
#: Rows up to which a table of ids, whose rows were counted, is broadcast.
FEW = 500_000
#: Pairs of one document, at least, before they are dealt over several tasks.
HOT_PAIRS = 1000


def _needs(only: tuple[str, ...]) -> tuple[tuple[str, ...], bool, bool]:
    """What metrics need of a document: kinds of profiles, its chunks, its words for compression."""
    return tuple(k for k in profiles.KINDS if any(k in KINDS_OF.get(m, ()) for m in only)), "M12" in only, "M16" in only


def flat_columns(only: tuple[str, ...]) -> list[str]:
    return ["word_count", "text_hash", *(c for m in only for c in FLAT_OF.get(m, ()))]


def features(docs: DataFrame, only: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """One row per document with all that the metrics ``only`` read of it: flat columns and packed profiles. Stored; map-only.

    Rows that repeat a document's id and text count once. One id with two different
    texts is an error: no result could say which of them it means.
    """
    return single(derived(docs, only))


def derived(docs: DataFrame, only: tuple[str, ...] = tuple(WEIGHTS), also: tuple[str, ...] = ()) -> DataFrame:
    """``features`` as the documents come, a row for each of theirs, with the columns ``also`` of them. Stored; map-only."""
    return stored(_derived(docs, only, also), "features")


def _derived(docs: DataFrame, only: tuple[str, ...], also: tuple[str, ...]) -> DataFrame:
    kinds, chunked, compression = _needs(only)
    text = F.col("text")
    streams = {}
    if compression:
        docs = docs if "stream" in docs.columns else docs.withColumn("stream", T.word_stream(T.tokenize(text)))
        streams = {"stream": F.col("stream"), "size": deflate_size(F.col("stream"), F.lit(""))}
    keep = [F.col(c) for c in ("doc_id", *flat_columns(only), *(c for c in _ABOUT if c in docs.columns and c not in also), *also)] + [v.alias(c) for c, v in streams.items()]
    rows = arrays.packed(docs, kinds, chunked, keep) if kinds or chunked else docs.select(*keep)
    if "w" in kinds:
        rows = rows.select(*(c for c in rows.columns if c not in arrays.STATS), *profiles.rich(), F.col("slope").alias("zipf_slope"))
    return rows


def single(rows: DataFrame) -> DataFrame:
    """Stored features, those that repeat an id once; two texts of one id are an error."""
    return stored(rows.dropDuplicates(["doc_id"]), "features") if repeated(rows) else rows


def repeated(rows: DataFrame) -> int:
    """How many ids of rows (doc_id, text_hash) stand there more than once; two texts of one id are an error."""
    held = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("text_hash").alias("x"), F.max("text_hash").alias("y")).where("n > 1")
    twice = held.agg(F.count(F.lit(1)).alias("ids"), F.count_if(F.col("x") != F.col("y")).alias("unlike")).first()
    if twice["unlike"]:
        raise ValueError(f"{twice['unlike']} ids stand for several texts each")
    return twice["ids"]


def near(docs: DataFrame, window: int, own: int, only: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """``distances`` of documents that lie in groups and in order (see ``arrays.met``), from texts to distances where they lie."""
    rows = _derived(docs, only, ("nth",))
    return _distances(arrays.met(rows, *_needs(only), window, own), only)


def attached(pairs: DataFrame, feats: DataFrame, side: str, total: int) -> DataFrame:
    """``pairs`` with the struct ``side`` (a or b): the features of their doc_a or doc_b; pairs without them are left out.

    A document with more than its share of the ``total`` pairs is hot. Its pairs are
    dealt over several tasks, each of which gets a copy of its features. There are no more
    hot documents than 4 x partitions.
    """
    limit = max(HOT_PAIRS, total // (4 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    name = f"doc_{side}"
    counts = pairs.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    hot = counts.select(F.col(name).alias("hot"), F.ceil(F.col("n") / limit).cast("int").alias("tasks")).collect()
    held = feats.select(F.col("doc_id").alias(name), F.struct(*feats.columns).alias(side))
    if not hot:
        return pairs.join(held, name)
    listed = F.broadcast(pairs.sparkSession.createDataFrame(hot, f"hot {feats.schema['doc_id'].dataType.simpleString()}, tasks int"))
    tasks = F.coalesce("tasks", F.lit(1))
    spread = pairs.join(listed, F.col(name) == F.col("hot"), "left").withColumn("task", F.pmod(F.xxhash64(*PAIR), tasks).cast("int")).drop("hot", "tasks")
    copies = held.join(listed, F.col(name) == F.col("hot"), "left").withColumn("task", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("hot", "tasks")
    return spread.join(copies, [name, "task"]).drop("task")


def compare(feats: DataFrame, pairs: DataFrame, only: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """``distances`` of documents whose ``features`` for these metrics are there."""
    kinds, chunked, compression = _needs(only)
    # a listed pair is computed once, however often it is listed; the listed rows get it back
    distinct = stored(pairs.select(*PAIR).distinct(), "pairs")
    total = distinct.count()
    rows = attached(attached(distinct, feats, "a", total), feats, "b", total)
    if kinds or chunked or compression:
        rows = arrays.compared(rows, kinds, chunked, compression)
    rows = _distances(rows, only)
    return pairs.join(rows, list(PAIR)).select("pair_id", *rows.columns) if "pair_id" in pairs.columns else rows


def _distances(rows: DataFrame, only: tuple[str, ...]) -> DataFrame:
    """From pairs with the flat columns of both sides and the kernel's results to m1..m17."""
    missing = [c for c in arrays.RESULTS if c not in rows.columns]
    rows = rows.select("*", *(F.lit(None).cast("double").alias(c) for c in missing))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    both = lambda c, least: F.least(a(c), b(c)) >= least
    value = {}
    if "M6" in only:
        value["M6"] = K.ks_statistic(a("sentence_hist"), b("sentence_hist"))
    if "M7" in only:
        value["M7"] = K.jsd_hist(a("word_hist"), b("word_hist"))
    if "M8" in only:
        value["M8"] = K.jsd_hist(smooth_props(a("punct")), smooth_props(b("punct")))
    if "M9" in only:
        value["M9"] = (K.rel_diff(a("guiraud"), b("guiraud")) + K.rel_diff(a("hapax_ratio"), b("hapax_ratio")) + K.log_rel_diff(a("yule_k"), b("yule_k")) + K.log_rel_diff(a("entropy"), b("entropy"))) / 4
    if "M11" in only:
        value["M11"] = 1 - K.cos_arr(a("typo"), b("typo"))
    if "M13" in only:
        value["M13"] = F.when(F.col("before") < 0.02, 0.0).when(both("word_count", 800), F.col("after") / F.col("before"))
    if "M14" in only:
        value["M14"] = F.when(both("vocab", 30), F.abs(a("zipf_slope") - b("zipf_slope")) / 0.30)
    if "M15" in only:
        value["M15"] = F.when(both("paragraph_count", 4), K.ks_statistic(a("paragraph_hist"), b("paragraph_hist")))
    if "M16" in only:
        ok = F.least(a("size"), b("size"), F.col("c12"), F.col("c21")) > 0
        value["M16"] = F.when(ok, ((F.col("c12") / a("size") + F.col("c21") / b("size")) * 0.5 - 0.82) / 0.18)
    nothing = F.lit(None).cast("double")
    found = {m: value.get(m, F.col(m.lower()) if m in only and m.lower() in arrays.RESULTS else nothing) for m in WEIGHTS}
    out = [F.when(v.isNotNull(), K.clamp(v)).alias(m.lower()) for m, v in found.items()]
    held = rows.select("a.*").columns
    about = [c for c in ("word_count", "text_hash", *_ABOUT) if c in held]
    return rows.select(*PAIR, *out, *(F.struct(*(F.col(f"{s}.{c}").alias(c) for c in about)).alias(s) for s in "ab"))


def distances(docs: DataFrame, pairs: DataFrame, compression: bool = True, only: tuple[str, ...] | None = None) -> DataFrame:
    """One row per pair: doc_a, doc_b, m1..m17 (null where neutral), a and b.

    ``docs`` has the columns of documents(), but for the BULKY ones; ``pairs`` has doc_a
    and doc_b, and is a set, or, with pair_id, a list: then each of its rows comes back,
    with its pair_id. Pairs of a document that isn't there are left out. a and b are structs
    of the documents' counts, script, title, charset and text digest. With ``only``
    (names of metrics) what the others need isn't computed, and they are null.

    Texts aren't shuffled: features are made where a text lies. They travel to their pairs
    twice, once for each side, and all else is done there.
    """
    only = tuple(m for m in (only or WEIGHTS) if compression or m != "M16")
    ids = pairs.select(F.explode_outer(F.array(*PAIR)).alias("doc_id")).distinct()
    if pairs.count() <= FEW:  # otherwise nearly all documents are in some pair
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return compare(features(docs, only), pairs, only)


def extract(rows: DataFrame) -> DataFrame:
    """Long form of ``distances``: doc_a, doc_b, metric_no, metric, distance, weight, neutral, contribution."""
    each = F.array(*(F.struct(F.lit(i).alias("metric_no"), F.lit(m).alias("metric"), F.col(m.lower()).alias("d"), F.lit(w).alias("weight")) for i, (m, w) in enumerate(WEIGHTS.items(), 1)))
    key = align.keys(rows)
    long = rows.select(*key, F.explode_outer(each).alias("x")).select(*key, "x.*")
    long = long.select(*key, "metric_no", "metric", F.coalesce("d", F.lit(0.5)).alias("distance"), "weight", F.col("d").isNull().alias("neutral"))
    return long.withColumn("contribution", F.col("distance") * F.col("weight"))


def weighted_distance() -> Column:
    """Weighted mean of the metrics that aren't neutral; 0 if all are."""
    total = sum((F.when(F.col(m.lower()).isNotNull(), F.lit(w)).otherwise(0.0) for m, w in WEIGHTS.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(m.lower()) * w, F.lit(0.0)) for m, w in WEIGHTS.items()), F.lit(0.0))
    return F.when(total > 0, value / total).otherwise(0.0)

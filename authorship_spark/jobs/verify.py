"""Verify pairs: from a corpus and its pairs to scores, and to a report per pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SHORT_WORDS
from ..operators import documents as D
from ..operators import metrics, pairs, report, score
from ..sources import sinks
from ..storage import job, stored


def prepare(corpus: DataFrame, force: bool = False, compose: bool = True, only: tuple[str, ...] | None = None) -> DataFrame:
    """Documents of a corpus (doc_id, text, ...) that are long enough, with their flat derived columns.

    Several branches read them, so they are stored once in the shared folder; what is as
    large as the text itself is taken from it again where it is needed. With ``only``
    (names of metrics) columns that these don't read are left out.
    """
    docs = D.documents(corpus, compose, only is None, 0 if force else SHORT_WORDS).drop(*D.BULKY)
    return stored(docs if only is None else docs.select(*corpus.columns, *metrics.flat_columns(only)), "documents")


#: Documents of a block that are compared in one stretch; wider windows are joined.
STRETCH = 64


def texts(corpus: DataFrame, force: bool = False) -> DataFrame:
    """A corpus of normalised texts that are long enough, with word_count and text_hash. Stored: they are looked for once."""
    rows = D.counted(corpus, least=0 if force else SHORT_WORDS)
    return stored(rows.withColumn("text_hash", F.sha2("text", 256)), "texts")


def distances_blocked(corpus: DataFrame, block: tuple[str, ...], window: int, force: bool = False, compression: bool = True, only: tuple[str, ...] | None = None) -> DataFrame:
    """``metrics.distances`` of blocked pairs, of ``compression`` or the metrics ``only``."""
    return distances_of(texts(corpus, force), block, window, compression, only)


def distances_of(held: DataFrame, block: tuple[str, ...], window: int, compression: bool = True, only: tuple[str, ...] | None = None) -> DataFrame:
    """``metrics.distances`` of the blocked pairs of stored ``texts``.

    Texts travel to their stretch of the block, in order, with the few that its last ones
    meet; features are made there and compared with the next ones. So features, many times
    as large as their text, are neither stored nor shuffled.
    """
    asked = tuple(m for m in (only or metrics.WEIGHTS) if compression or m != "M16")
    plain = held.drop("word_count", "text_hash")
    if window > STRETCH or metrics.repeated(held):
        rows = metrics.derived(D.documents(plain, compose=False, script=only is None), asked, block)
        wanted = stored(pairs.pairs_blocked(rows, block, window), "pairs")
        return metrics.compare(metrics.single(rows.drop(*(c for c in block if c != "charset"))), wanted, asked)
    placed = stored(pairs.stretches(held, block, window, STRETCH), "stretches")
    placed = F.broadcast(placed) if placed.count() <= metrics.FEW else placed
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = plain.join(placed, "doc_id").repartition(parts, *block, "stretch").sortWithinPartitions(*block, "stretch", "nth")
    return metrics.near(D.documents(rows, compose=False, script=only is None), window, STRETCH, asked)


def verify(docs: DataFrame, wanted: DataFrame, self_baseline: bool = True, compression: bool = True) -> tuple[DataFrame, DataFrame]:
    """(scores, metrics in long form) of the pairs ``wanted`` of prepared documents; a list of pairs with pair_id gets a row for each of its rows."""
    rows = stored(metrics.distances(docs, stored(wanted, "pairs"), compression), "distances")
    own = score.self_distance(docs, compression) if self_baseline else None
    return score.scores(rows, own), metrics.extract(rows)


def verify_blocks(corpus: DataFrame, block: tuple[str, ...] = ("lang", "source"), window: int = 3, force: bool = False, self_baseline: bool = True, compression: bool = True) -> tuple[DataFrame, DataFrame]:
    """Verify each document of at least 500 words (each of all with ``force``) against its next neighbours in its block."""
    held = texts(corpus, force)
    rows = stored(distances_of(held, block, window, compression), "distances")
    own = score.self_distance(held, compression) if self_baseline else None
    return score.scores(rows, own), metrics.extract(rows)


def reports(scored: DataFrame, long: DataFrame) -> DataFrame:
    return report.render_report(scored, long, report.rationale(long, scored))


def run(spark: SparkSession, corpus: DataFrame, out: str, **options) -> None:
    """Verify the blocks of a corpus; write scores, metrics and reports under ``out``. What was stored on the way goes, and nothing else."""
    with job(spark):
        scored, long = verify_blocks(corpus, **options)
        write(spark, scored, long, out)


def run_pairs(spark: SparkSession, corpus: DataFrame, listed: DataFrame, out: str, force: bool = False, **options) -> None:
    """Verify a list of pairs (doc_a, doc_b, and pair_id if it has one); write a score, metrics and a report for each of its rows."""
    with job(spark):
        docs = prepare(corpus, force)
        scored, long = verify(docs, pairs.pairs_explicit(listed, docs), **options)
        write(spark, scored, long, out)


def write(spark: SparkSession, scored: DataFrame, long: DataFrame, out: str) -> None:
    sinks.write_scores(scored, f"{out}/scores")
    sinks.write_metrics(long, f"{out}/metrics")
    sinks.write_reports(reports(spark.read.parquet(f"{out}/scores"), spark.read.parquet(f"{out}/metrics")), f"{out}/reports")

"""A corpus as one row of derived columns per document: map-only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..functions import scripts as S


def from_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A corpus (doc_id, text, and ``keep``) from texts in a column; a null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep)


def dealt(table: DataFrame, by: str = "doc_id") -> DataFrame:
    """A table as it was read, dealt over all cores where it has fewer parts than there are cores.

    A file of one row group is read by one task, and all that is map-only would stay in it.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores:
        return table
    # rows come out of a generator, so that no later filter is worked out in the one task before the exchange
    return table.repartition(cores, by).select(F.inline(F.array(F.struct(*table.columns))))


def tokens(corpus: DataFrame, compose: bool = True, least: int = 0) -> DataFrame:
    """Adds words, word_count and letter_count to a corpus of normalised texts of at least ``least`` words."""
    rows = split_texts(corpus, T.tokenize, F.col("elements"), least, compose).drop("elements")
    return rows.withColumn("word_count", F.size("words")).withColumn("letter_count", T.letter_count(F.col("text")))


def counted(corpus: DataFrame, compose: bool = True, least: int = 0) -> DataFrame:
    """A corpus of normalised texts of at least ``least`` words with word_count alone: for what needs no words."""
    rows = _perhaps(corpus, least).withColumn("text", T.normalize_text(F.col("text"), compose))
    rows = rows.withColumn("word_count", T.word_count(F.col("text")))
    return _behind(rows).where(F.col("word_count") >= least) if least else rows


def _perhaps(corpus: DataFrame, least: int) -> DataFrame:
    """Without texts that are too short for ``least`` words: between two words of a text without ideographs there is a sign at least."""
    return corpus.where(~T.plain(F.col("text")) | (F.length("text") >= 2 * least - 1)) if least else corpus


def _behind(rows: DataFrame) -> DataFrame:
    """Rows out of a generator, so that no later condition is worked out before it, from a text that is normalised and split once more."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def split_texts(corpus: DataFrame, split: Callable[[Column], Column], words: Column, least: int = 0, compose: bool = True) -> DataFrame:
    """Normalised texts with ``elements``, what ``split`` makes of them, and ``words``, which follow from these; those of at least ``least`` words.

    Each text is split once, also for the condition.
    """
    rows = _perhaps(corpus, least).withColumn("text", T.normalize_text(F.col("text"), compose)).withColumn("elements", split(F.col("text")))
    if not least:
        return rows.withColumn("words", words)
    return _behind(rows).withColumn("words", words).where(F.size("words") >= least)


#: Columns of documents() that follow from the text at once and are larger than it: not worth storing.
BULKY = ("words", "letters_lower", "sentence_lengths", "paragraph_lengths", "word_lengths", "stream")


def documents(corpus: DataFrame, compose: bool = True, script: bool = True, least: int = 0) -> DataFrame:
    """All per-document columns that need no grouping, of texts of at least ``least`` words; the dominant script only with ``script``.

    Adds to ``tokens``: text_hash, letters_lower, sentence, word and paragraph
    lengths and histograms, punctuation and typography vectors, the word stream and
    the dominant script.
    """
    # what several columns are made of is a column, so that each text is looked at once for it
    text = F.col("text")
    rows = split_texts(corpus, T.tokens_and_ends, F.filter("elements", lambda x: ~T.is_end(x)), least, compose)
    rows = rows.select("*", T.letters(text).alias("letters"), T.outline(text).alias("outline"), T.shape(F.col("elements")).alias("shape"))
    rows = rows.withColumn("letter_count", F.length("letters"))
    letters, outline, shape = F.col("letter_count"), F.col("outline"), F.col("shape")
    rows = rows.select(
        *corpus.columns, "words", F.size("words").alias("word_count"), "letter_count",
        F.sha2(text, 256).alias("text_hash"),
        T.letters_lower_of(text, F.col("letters")).alias("letters_lower"),
        T.lengths_in(shape, "[\n.]").alias("sentence_lengths"),
        T.lengths_in(shape, "\n").alias("paragraph_lengths"),
        T.word_lengths(F.col("words")).alias("word_lengths"),
        V.punct_vector(outline, letters).alias("punct"),
        V.typo_vector(outline, letters).alias("typo"),
        T.word_stream(F.col("words")).alias("stream"),
        *([S.dominant_script(text, F.col("letters")).alias("dominant_script")] if script else []),
    )
    return rows.select(
        "*",
        V.histogram(F.col("sentence_lengths"), V.SENTENCE_BINS).alias("sentence_hist"),
        V.histogram(F.col("word_lengths"), V.WORD_BINS).alias("word_hist"),
        V.histogram(F.col("paragraph_lengths"), V.PARAGRAPH_BINS).alias("paragraph_hist"),
        F.size("paragraph_lengths").alias("paragraph_count"),
    )


def script_counts(corpus: DataFrame) -> DataFrame:
    """(doc_id, script, n): letters of each script; letters of no known script are left out. Map-only."""
    return corpus.select("doc_id", F.inline(S.script_counts(F.col("text"))))


def dominant_script(corpus: DataFrame) -> DataFrame:
    """(doc_id, dominant_script): the commonest, on a tie the first by name; no row without letters."""
    return corpus.select("doc_id", S.dominant_script(F.col("text")).alias("dominant_script")).where("dominant_script IS NOT NULL")


def length_class(word_count: Column) -> Column:
    return F.when(word_count < T.CRITICAL_WORDS, "critical").when(word_count < T.SHORT_WORDS, "short").otherwise("full")


def long_enough(docs: DataFrame, force: bool = False) -> DataFrame:
    """Documents of at least 500 words; all of them with ``force``."""
    return docs if force else docs.where(F.col("word_count") >= T.SHORT_WORDS)


#: Signs after which a text may be cut, and how much their distance from the even place weighs.
BREAKS = {"\n": 0.5, ".": 0.75, " ": 1.0}


def _with_cut(rows: DataFrame, i: int) -> DataFrame:
    """Adds cut{i}: where the i-th cut of k goes, after the best break near its even place; null if k isn't over i.

    A break's score is its distance times the weight of its sign, so only the nearest
    ones of each weight on either side can be the best. Steps are columns, so that
    none is computed twice.
    """
    prev, size = F.col(f"cut{i - 1}"), F.col("size")
    # sign by sign: translate() looks every sign of the text up
    alike = lambda s: reduce(lambda x, sign: F.replace(x, F.lit(sign), F.lit(" " if sign == "\t" else ".")), "!?…。\t", s)
    many = F.col("k") > i
    rows = rows.withColumn("target", F.floor(size * F.lit(float(i)) / F.nullif(F.col("k"), F.lit(0)) + 0.5).cast("int")).withColumn("span", F.greatest(F.lit(1), F.floor(size / 8)).cast("int"))
    rows = rows.withColumn("low", F.greatest(prev + 1, F.col("target") - F.col("span"))).withColumn("high", F.least(size - 1, F.col("target") + F.col("span")))
    rows = rows.withColumn("last", F.least("target", "high")).withColumn("first", F.greatest(F.col("target") + 1, F.col("low")))
    rows = rows.withColumn("before", F.when(many, F.reverse(alike(F.substring("text", F.col("low"), F.greatest(F.col("last") - F.col("low") + 1, F.lit(0)))))))
    rows = rows.withColumn("after", F.when(many, alike(F.substring("text", F.col("first"), F.greatest(F.col("high") - F.col("first") + 1, F.lit(0))))))
    near = []
    for n, (sign, weight) in enumerate(BREAKS.items()):
        rows = rows.withColumn(f"l{n}", F.nullif(F.instr("before", sign), F.lit(0))).withColumn(f"r{n}", F.nullif(F.instr("after", sign), F.lit(0)))
        near += [(F.col("last") - F.col(f"l{n}") + 1, weight), (F.col("first") + F.col(f"r{n}") - 1, weight)]
    scored = F.array_compact(F.array(*(F.when(at.isNotNull(), F.struct((F.abs(at - F.col("target")) * weight).alias("score"), at.alias("at"))) for at, weight in near)))
    rows = rows.withColumn("best", F.coalesce(F.array_min(scored)["at"], F.col("target")))
    bad = (F.col("best") <= prev) | (F.col("best") >= size)
    cut = F.when(bad, F.greatest(prev + 1, F.least(F.col("target"), size - 1))).otherwise(F.col("best"))
    return rows.withColumn(f"cut{i}", F.when(many, cut)).drop("target", "span", "low", "high", "last", "first", "before", "after", "best", *(f"{s}{n}" for s in "lr" for n in range(len(BREAKS))))


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds ``spans`` to documents (text, word_count): start and end of 2 to 4 pieces, cut at breaks; none below 260 words."""
    rows = docs.withColumn("k", T.chunk_number(F.col("word_count"))).withColumn("size", F.length("text")).withColumn("cut0", F.lit(0))
    for i in range(1, 4):
        rows = _with_cut(rows, i)
    ends = F.filter(F.array("cut1", "cut2", "cut3", "size"), lambda x: x.isNotNull())
    spans = F.zip_with(F.concat(F.array("cut0"), ends), ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    held = F.when(F.col("k") > 0, F.filter(spans, lambda s: s["end"] > s["start"]))
    return rows.select(*docs.columns, F.coalesce(held, F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))


def piece(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def split_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, text): the pieces of each text of at least 260 words."""
    rows = with_spans(docs.select("doc_id", "text", "word_count"))
    # the outer form and a filter behind it: before it, Spark would compute every cut a second time
    rows = rows.select("doc_id", "text", F.posexplode_outer("spans").alias("chunk_no", "span")).where("chunk_no IS NOT NULL")
    return rows.select("doc_id", "chunk_no", piece(F.col("text"), F.col("span")).alias("text"))

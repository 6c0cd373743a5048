"""The registered queries of the authorship operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scripts as S
from ..functions import text as T
from ..functions import vectors as V
from ..functions.kernels import rounded
from ..operators import documents, metrics, pairs, profiles, ranks, report, score
from ..operators.align import PAIR
from ..sources import ingest, sinks
from ..storage import scratch, stored
from . import ingest as ingest_job
from . import verify

BLOCK, WINDOW = ("lang", "source"), 3


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.dealt(documents.from_text(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=BLOCK))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.documents(corpus(spark, sf_dir))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.tokens(corpus(spark, sf_dir))


def _each(df: DataFrame, array: str, value: str = "value") -> DataFrame:
    return df.select("doc_id", F.posexplode_outer(array).alias("idx", value)).where("idx IS NOT NULL")


def _r(c: str, name: str | None = None):
    return rounded(F.col(c), 6).alias(name or c)


def _long(spark, sf_dir, only: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents of at least 500 words and their pairs, both stored: many branches read them."""
    docs = verify.prepare(corpus(spark, sf_dir), only=only)
    return docs, stored(pairs.pairs_blocked(docs, BLOCK, WINDOW), "pairs")


def _profile(spark, sf_dir, *kinds: str) -> DataFrame:
    docs = _tokens(spark, sf_dir)
    docs = docs.withColumn("letters_lower", T.letters_lower(F.col("text"))) if kinds != ("w",) else docs
    return profiles.rel_freq(profiles.counts(docs, kinds))


def _words_of_pairs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Blocked pairs of documents of at least 500 words, and these documents' word profiles."""
    rows = ranks.profiles_of(documents.tokens(corpus(spark, sf_dir), least=T.SHORT_WORDS), "w", BLOCK)
    return pairs.pairs_blocked(rows, BLOCK, WINDOW), rows


def _distances(spark, sf_dir, compression: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    return verify.distances_blocked(corpus(spark, sf_dir), BLOCK, WINDOW, compression=compression, only=only)


def _kept(spark, sf_dir, compression: bool = False) -> DataFrame:
    """Distances for tables and reports that read them more than once."""
    return stored(_distances(spark, sf_dir, compression), "distances")


def _scores(spark, sf_dir, compression: bool, own: bool) -> DataFrame:
    return verify.verify_blocks(corpus(spark, sf_dir), BLOCK, WINDOW, self_baseline=own, compression=compression)[0]


def s2_from_text(spark, sf_dir):
    return documents.from_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html")


def s5_decode(spark, sf_dir):
    """Every document's bytes, as the files of a folder would hold them, decoded again."""
    files = corpus(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return ingest.detect_and_decode(files).select("doc_id", "charset", "text", "reject_reason")


def s6_quarantine(spark, sf_dir):
    """Every document's bytes as they are and behind a ZIP header: what is refused, and why."""
    docs = corpus(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    zipped = docs.select("doc_id", F.concat(F.unhex(F.lit("504B0304")), "content").alias("content"))
    return ingest.quarantine(ingest.detect_and_decode(docs.unionByName(zipped)))[1].select("doc_id", "reject_reason")


def t1_normalize(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", "text")


def t2_tokenize(spark, sf_dir):
    return _each(_tokens(spark, sf_dir), "words", "word")


def t3_letters_lower(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", T.letters_lower(F.col("text")).alias("letters_lower"))


def t4_counts(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", F.col("word_count").cast("long").alias("word_count"), F.col("letter_count").cast("long").alias("letter_count"))


def t5_sentence_lengths(spark, sf_dir):
    return _each(_tokens(spark, sf_dir).withColumn("x", T.sentence_lengths(F.col("text"))), "x")


def t6_paragraph_lengths(spark, sf_dir):
    return _each(_tokens(spark, sf_dir).withColumn("x", T.paragraph_lengths(F.col("text"))), "x")


def t7_word_lengths(spark, sf_dir):
    return _each(_tokens(spark, sf_dir).withColumn("x", T.word_lengths(F.col("words"))), "x")


def t8_punct_vector(spark, sf_dir):
    return _each(_docs(spark, sf_dir), "punct").withColumn("value", rounded("value", 6))


def t9_typo_vector(spark, sf_dir):
    return _each(_docs(spark, sf_dir), "typo").withColumn("value", rounded("value", 6))


def t10_top_habit(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", V.top_habit(F.col("typo")).alias("habit"))


def t11_script_counts(spark, sf_dir):
    return documents.script_counts(_tokens(spark, sf_dir))


def t12_dominant_script(spark, sf_dir):
    return documents.dominant_script(_tokens(spark, sf_dir))


def t13_script_label(spark, sf_dir):
    rows = documents.dominant_script(_tokens(spark, sf_dir))
    return rows.select("doc_id", S.script_label(F.col("dominant_script")).alias("label"), S.is_cjk(F.col("dominant_script")).alias("cjk"))


def t14_scripts_differ(spark, sf_dir):
    docs, wanted = _long(spark, sf_dir)
    own = docs.select("doc_id", "dominant_script")
    a, b = (own.select(F.col("doc_id").alias(f"doc_{s}"), F.col("dominant_script").alias(s)) for s in "ab")
    rows = wanted.join(a, "doc_a", "left").join(b, "doc_b", "left")
    return rows.select(*PAIR, S.scripts_differ(F.col("a"), F.col("b")).alias("differ"))


#: First letters of scripts that take the place of a to z, by id.
FIRST_LETTERS = {"TIFINAGH": 0x2D30, "YI": 0xA000, "CANADIAN_ABORIGINAL": 0x1401, "NKO": 0x07CA, "CYRILLIC": 0x0430, "HAN": 0x4E00}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _in_scripts(docs: DataFrame) -> DataFrame:
    """``docs`` with all or half of their small letters in another script, by id."""
    text, kind = F.col("text"), F.pmod("doc_id", F.lit(2 * len(FIRST_LETTERS)))
    for k, first in enumerate(FIRST_LETTERS.values()):
        for many, at in ((26, 2 * k), (13, 2 * k + 1)):
            text = F.when(kind == at, F.translate("text", _LETTERS[:many], "".join(map(chr, range(first, first + many))))).otherwise(text)
    return docs.withColumn("text", text)


def t11_script_counts_mixed(spark, sf_dir):
    return documents.script_counts(_in_scripts(documents.counted(corpus(spark, sf_dir))))


def t12_dominant_script_mixed(spark, sf_dir):
    return documents.dominant_script(_in_scripts(documents.counted(corpus(spark, sf_dir))))


def t14_scripts_differ_mixed(spark, sf_dir):
    """Neighbours of a block whose letters are of one script or of two."""
    docs, wanted = _long(spark, sf_dir, ())  # the text alone is read
    own = stored(documents.dominant_script(_in_scripts(docs)), "scripts")
    a, b = (own.select(F.col("doc_id").alias(f"doc_{s}"), F.col("dominant_script").alias(s)) for s in "ab")
    rows = wanted.join(a, "doc_a", "left").join(b, "doc_b", "left")
    return rows.select(*PAIR, S.scripts_differ(F.col("a"), F.col("b")).alias("differ"))


def t15_chunks(spark, sf_dir):
    return documents.split_chunks(documents.counted(corpus(spark, sf_dir)))


def t16_length_class(spark, sf_dir):
    n = F.col("word_count")
    return _tokens(spark, sf_dir).select("doc_id", (n < T.SHORT_WORDS).alias("is_short"), (n < T.CRITICAL_WORDS).alias("is_critical"), documents.length_class(n).alias("length_class"))


def t17_word_stream(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", T.word_stream(F.col("words")).alias("stream"))


def a1_word_profile(spark, sf_dir):
    return _profile(spark, sf_dir, "w").select("doc_id", "gram", "cnt")


def _a2(n: int):
    return lambda spark, sf_dir: _profile(spark, sf_dir, f"c{n}").select("doc_id", "gram", "cnt")


def a3_rel_freq(spark, sf_dir):
    return _profile(spark, sf_dir, "w").select("doc_id", "gram", _r("rel"), _r("rel_1000"))


def _a4(column: str):
    return lambda spark, sf_dir: _each(_docs(spark, sf_dir), column).withColumn("value", rounded("value", 6))


def a5_length_stats(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", V.length_stats(F.col("sentence_lengths")).alias("x"))
    return rows.select("doc_id", _r("x.mean", "mean"), _r("x.sd", "sd"))


def a6_entropy(spark, sf_dir):
    return profiles.shannon(_profile(spark, sf_dir, "c1")).select("doc_id", _r("entropy"))


def a7_richness(spark, sf_dir):
    docs = _tokens(spark, sf_dir)
    rows = profiles.richness(docs, profiles.rel_freq(profiles.counts(docs, ("w",))))
    return rows.select("doc_id", *(_r(c) for c in ("guiraud", "hapax_ratio", "yule_k", "entropy")), "vocab")


def a8_zipf(spark, sf_dir):
    return profiles.zipf_slope(_profile(spark, sf_dir, "w")).select("doc_id", rounded("zipf_slope", 5).alias("zipf_slope"))


def a9_smooth_props(spark, sf_dir):
    return _each(_docs(spark, sf_dir).withColumn("x", V.smooth_props(F.col("punct"))), "x").withColumn("value", rounded("value", 6))


def j1_pairs_explicit(spark, sf_dir):
    """Pairs that the labels table gives: each labelled document with its predecessor by id."""
    wanted = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("doc_a"), (F.col("doc_id") - 1).alias("doc_b"))
    return pairs.pairs_explicit(wanted, corpus(spark, sf_dir)).select(*PAIR)


def j1_pairs_listed(spark, sf_dir):
    """A list that gives each of these pairs twice: a row for each of its rows, with the distances of the pair."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("doc_a"), (F.col("doc_id") - 1).alias("doc_b"), F.explode(F.array(F.lit(0), F.lit(1))).alias("nth"))
    docs = verify.prepare(corpus(spark, sf_dir), force=True, only=("M3", "M5", "M9"))
    listed = stored(pairs.pairs_explicit(labels.select((F.col("doc_a") * 2 + F.col("nth")).alias("pair_id"), *PAIR), docs), "listed")
    rows = metrics.distances(docs, listed, compression=False, only=("M3", "M5", "M9"))
    return rows.select("pair_id", *PAIR, *(rounded(c, 5).alias(c) for c in ("m3", "m5", "m9")))


def j2_pairs(spark, sf_dir):
    return pairs.pairs_blocked(documents.long_enough(_tokens(spark, sf_dir)), BLOCK, WINDOW)


def j3_identical(spark, sf_dir):
    docs = stored(_tokens(spark, sf_dir).select("doc_id", "lang", "text", F.sha2("text", 256).alias("text_hash")), "texts")
    return pairs.identical(pairs.pairs_blocked(docs, ("lang",), WINDOW), docs)


def j4_profile_align(spark, sf_dir):
    return ranks.profile_align(*_words_of_pairs(spark, sf_dir)).select(*PAIR, "gram", _r("r1"), _r("r2"))


def j5_top_keys(spark, sf_dir):
    return profiles.top_keys(_profile(spark, sf_dir, "w"), 50).select("doc_id", "gram", "rk")


def j6_top_combined(spark, sf_dir):
    return ranks.top_combined(*_words_of_pairs(spark, sf_dir), 100).select(*PAIR, "gram", "rk")


def j7_restrict_renorm(spark, sf_dir):
    return ranks.restrict_renorm(*_words_of_pairs(spark, sf_dir), 300).select(*PAIR, "gram", _r("t1"), _r("t2"))


def j8_top_diff(spark, sf_dir):
    return ranks.top_diff(*_words_of_pairs(spark, sf_dir), 120).select(*PAIR, "gram", "rkd")


def j9_drop_keys(spark, sf_dir):
    return ranks.drop_keys(*_words_of_pairs(spark, sf_dir), 120).select(*PAIR, "gram", _r("t1", "d1"), _r("t2", "d2"))


def j10_key_sets(spark, sf_dir):
    rows = ranks.top_combined(*_words_of_pairs(spark, sf_dir), 50)
    mine, yours = F.coalesce(F.col("own1") <= 50, F.lit(False)), F.coalesce(F.col("own2") <= 50, F.lit(False))
    return rows.groupBy(*PAIR).agg(F.count_if(mine & yours).alias("inter"), F.count_if(mine | yours).alias("uni"))


def j11_chunk_pairs(spark, sf_dir):
    rows = pairs.chunk_pairs(documents.split_chunks(documents.counted(corpus(spark, sf_dir))))
    return rows.select("doc_id", F.col("doc_a.chunk_no").alias("chunk_a"), F.col("doc_b.chunk_no").alias("chunk_b"))


def _m(name: str):
    only = (name.upper(),)
    return lambda spark, sf_dir: _distances(spark, sf_dir, name == "m16", only).select(*PAIR, rounded(F.coalesce(name, F.lit(0.5)), 5).alias("distance"), F.col(name).isNull().alias("neutral"))


def m1_trigram_cosine(spark, sf_dir):
    """The smallest slice from end to end: letter 3-grams of blocked pairs to their cosine distance."""
    return _m("m1")(spark, sf_dir)


def m_all(spark, sf_dir):
    """All 17, cross-compression included."""
    return metrics.extract(_distances(spark, sf_dir, True)).select(*PAIR, "metric_no", "metric", _r("distance"), "weight", "neutral")


def r1_distance(spark, sf_dir):
    """Without cross-compression, whose sizes SQL can't give."""
    return _distances(spark, sf_dir).select(*PAIR, rounded(metrics.weighted_distance(), 5).alias("D"))


_SCORE = ("D", "S", "p_topic", "p0", "f", "p", "margin")


def r9_scores_core(spark, sf_dir):
    """Scores without cross-compression and self baseline."""
    rows = _scores(spark, sf_dir, False, False)
    return rows.select(*PAIR, *(rounded(c, 4).alias(c) for c in _SCORE), "verdict", F.array_join("warnings", ",").alias("warnings"), "identical")


def r3_self_distance(spark, sf_dir):
    return score.self_distance(verify.prepare(corpus(spark, sf_dir), only=())).select("doc_id", _r("self_distance"))


def r3_self_distance_core(spark, sf_dir):
    """Without cross-compression, so that SQL can give it."""
    own = score.self_distance(verify.prepare(corpus(spark, sf_dir), only=()), compression=False)
    return own.select("doc_id", rounded("self_distance", 5).alias("self_distance"))


def r9_scores_self(spark, sf_dir):
    """Scores with the self baseline, without cross-compression."""
    rows = _scores(spark, sf_dir, False, True)
    return rows.select(*PAIR, *(rounded(c, 4).alias(c) for c in (*_SCORE, "self_distance", "p_self")), "verdict", F.array_join("warnings", ",").alias("warnings"), "identical")


def r9_scores(spark, sf_dir):
    """Full scores: all 17 metrics and the self baseline."""
    rows = _scores(spark, sf_dir, True, True)
    return rows.select(*PAIR, *(_r(c) for c in (*_SCORE, "self_distance", "p_self")), "verdict", "warnings", "identical")


def x1_metric_table(spark, sf_dir):
    rows = metrics.extract(_distances(spark, sf_dir))
    name = F.element_at(F.create_map(*(F.lit(x) for pair in metrics.NAMES.items() for x in pair)), F.col("metric"))
    return rows.where("metric <> 'M16'").select(*PAIR, "metric", name.alias("name"), rounded("distance", 5).alias("distance"), "weight", "neutral", rounded("contribution", 5).alias("contribution"))


def x2_rationale(spark, sf_dir):
    rows = _kept(spark, sf_dir)
    return report.rationale(metrics.extract(rows), score.scores(rows)).select(*PAIR, "part", "nth", "metric")


def x3_report(spark, sf_dir):
    rows = _kept(spark, sf_dir, True)
    return verify.reports(score.scores(rows), metrics.extract(rows))


def x4_eval(spark, sf_dir):
    """Same-author pairs are the first two chunks of a document; other pairs are of neighbours. A group per document."""
    whole, wanted = _long(spark, sf_dir, ())
    chunks = documents.split_chunks(whole).where("chunk_no < 2").select(pairs.chunk_id(F.col("doc_id"), F.col("chunk_no")).alias("doc_id"), "text")
    docs = stored(documents.documents(chunks, compose=False), "chunks")
    ids = docs.select("doc_id")
    chunk = lambda c, k: pairs.chunk_id(F.col(c), F.lit(k))
    same = ids.where("doc_id.chunk_no = 1").select(chunk("doc_id.whole", 0).alias("doc_a"), F.col("doc_id").alias("doc_b"), F.col("doc_id.whole").alias("group"), F.lit("AA").alias("kind"))
    other = wanted.select(chunk("doc_a", 0).alias("doc_a"), chunk("doc_b", 0).alias("doc_b"), F.col("doc_a").alias("group"), F.lit("AB").alias("kind"))
    labelled = stored(same.unionByName(other), "labelled")
    rows = metrics.distances(docs, labelled.select(*PAIR), compression=False)
    return report.eval_ordering(score.scores(rows), labelled)


def x4_eval_kinds(spark, sf_dir):
    """Every kind of pair in a document's group: AA as in x4_eval, AB and AC with its next two neighbours, BC of these two, and II with an exact copy."""
    whole, wanted = _long(spark, sf_dir, ())
    chunks = documents.split_chunks(whole).where("chunk_no < 2").select(pairs.chunk_id(F.col("doc_id"), F.col("chunk_no")).alias("doc_id"), "text")
    docs = stored(documents.documents(chunks, compose=False), "chunks")
    chunk = lambda c, k=0: pairs.chunk_id(F.col(c), F.lit(k))
    label = lambda df, a, b, group, kind: df.select(a.alias("doc_a"), b.alias("doc_b"), F.col(group).alias("group"), kind.alias("kind"))
    same = label(docs.where("doc_id.chunk_no = 1"), chunk("doc_id.whole"), F.col("doc_id"), "doc_id.whole", F.lit("AA"))
    near = wanted.groupBy("doc_a").agg(F.slice(F.array_sort(F.collect_list("doc_b")), 1, 2).alias("next"))  # WINDOW ids at most
    near = near.select("doc_a", F.get("next", F.lit(0)).alias("b"), F.get("next", F.lit(1)).alias("c"))
    other = label(near, chunk("doc_a"), chunk("b"), "doc_a", F.lit("AB"))
    third = label(near.where("c IS NOT NULL"), chunk("doc_a"), chunk("c"), "doc_a", F.lit("AC"))
    apart = label(near.where("c IS NOT NULL"), chunk("b"), chunk("c"), "doc_a", F.lit("BC"))
    first = whole.groupBy("text_hash").agg(F.min("doc_id").alias("first"))
    copies = label(whole.join(first, "text_hash").where("first < doc_id"), chunk("first"), chunk("doc_id"), "doc_id", F.lit("II"))
    labelled = stored(same.unionByName(other).unionByName(third).unionByName(apart).unionByName(copies), "labelled")
    rows = metrics.distances(docs, labelled.select(*PAIR), compression=False)
    return report.eval_ordering(score.scores(rows), labelled)


def _summary(scored: DataFrame) -> DataFrame:
    return report.verdict_summary(scored).select("verdict", "n", rounded("mean_p", 4).alias("mean_p"))


def x5_summary(spark, sf_dir):
    """Verdicts by all 17 metrics and the self baseline."""
    return _summary(_scores(spark, sf_dir, True, True))


def x5_summary_core(spark, sf_dir):
    """Without cross-compression and self baseline, as r9_scores_core, so that SQL can give it."""
    return _summary(_scores(spark, sf_dir, False, False))


def w3_corpus_statistics(spark, sf_dir):
    return ingest_job.summary(documents.from_text(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=("lang",)))


def _framed(spark, sf_dir) -> DataFrame:
    """Every page's bytes behind the first bytes of one format after the other, by id."""
    heads = [bytes.fromhex(h) for h in _HEADS.split()]
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    head = F.element_at(F.array(*(F.lit(h) for h in heads)), (F.pmod("page_id", F.lit(len(heads))) + 1).cast("int"))
    return rows.select("page_id", F.concat(head, "content").alias("content"))


#: First bytes of each format in the order of its signature, and of a text.
_HEADS = (
    "89504E470D0A1A0A FFD8FFE0 47494638 524946460000000057454250 524946460000000057415645 424D0000000000000000000000002800000000000000 49492A00 4D4D002A 00000100 255044462D 504B0304 "
    "526172211A07 377ABCAF271C 1F8B08 4F676753 664C6143 000000186674797069736F6D 494433 FFFB90 7F454C46 4D5A9000 D0CF11E0A1B11AE1 53514C69746520666F726D6174203300 20"
)


def s3_signature(spark, sf_dir):
    return _framed(spark, sf_dir).select("page_id", ingest.binary_signature(F.col("content")).alias("signature"))


def s4_looks_binary(spark, sf_dir):
    """Every document's bytes with some letters made NUL or control bytes, by id."""
    text, kind = F.regexp_replace("text", r"[^\x00-\x7F]", ""), F.col("doc_id") % 4
    put = lambda x, old, new: F.replace(x, F.lit(old), F.lit(new))
    made = F.when(kind == 0, put(text, "z", "\x00")).when(kind == 1, put(put(text, "w", "\x00"), "a", "\x01")).when(kind == 2, put(text, "o", "\x02")).otherwise(text)
    rows = corpus(spark, sf_dir).select("doc_id", F.encode(made, "UTF-8").alias("content"))
    return rows.select("doc_id", ingest.looks_binary(F.col("content")).alias("reason"))


def s5_charsets(spark, sf_dir):
    """Every document's letters in one charset after the other, by id: UTF-8 with its mark, UTF-16 both ways, windows-1251, ISO-8859-1."""
    kind = F.col("doc_id") % 5
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    cyrillic = F.encode(F.translate(plain, "abvgd", "".join(map(chr, (0xE0, 0xE1, 0xE2, 0xE3, 0xE4)))), "ISO-8859-1")
    latin = F.encode(F.concat(F.translate(plain, "abvgd", ""), F.lit("\xa9")), "ISO-8859-1")
    content = F.when(kind == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(kind == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(kind == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))).when(kind == 3, cyrillic).otherwise(latin)
    return ingest.detect_and_decode(corpus(spark, sf_dir).select("doc_id", content.alias("content"))).select("doc_id", "charset", "text", "reject_reason")


def s1_read_files(spark, sf_dir):
    """The documents written as text files, one a source, and read back whole."""
    at = scratch(spark, "files")
    rows = corpus(spark, sf_dir).repartition("source").sortWithinPartitions("source", "doc_id")
    rows.select("source", F.regexp_replace("text", "\n", " ").alias("value")).write.partitionBy("source").text(at)
    files = ingest.read_text_files(spark, at)
    named = files.select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "length", F.decode("content", "UTF-8").alias("text"))
    return named.groupBy("source").agg(F.sum("length").alias("bytes"), F.sum(F.regexp_count("text", F.lit("\n"))).cast("long").alias("records"))


def s7_scores_written(spark, sf_dir):
    """Scores (without cross-compression and self baseline) through their sink and back."""
    at = scratch(spark, "scores")
    sinks.write_scores(_scores(spark, sf_dir, False, False), at)
    return spark.read.parquet(at).select(*PAIR, rounded("p", 4).alias("p"), "verdict")


def s7_metrics_written(spark, sf_dir):
    at = scratch(spark, "metrics")
    sinks.write_metrics(metrics.extract(_distances(spark, sf_dir)), at)
    return spark.read.parquet(at).where("metric <> 'M16'").select(*PAIR, "metric", rounded("distance", 5).alias("distance"))


def s8_reports_written(spark, sf_dir):
    """Reports through their sink and back: how many records each verdict's folder has. (The reader takes a file's first byte order mark away.)"""
    at = scratch(spark, "reports")
    rows = _kept(spark, sf_dir)
    sinks.write_reports(verify.reports(score.scores(rows), metrics.extract(rows)), at)
    return spark.read.text(at).where(F.col("value").rlike(r"^\x{FEFF}?[a-z_]+: P = ")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def s8_reports_text(spark, sf_dir):
    """Reports through their sink and back, whole: a record lies between two byte order marks."""
    at = scratch(spark, "reports")
    rows = _kept(spark, sf_dir)
    sinks.write_reports(verify.reports(score.scores(rows), metrics.extract(rows)), at)
    back = spark.read.option("lineSep", "\ufeff").text(at).where("value <> ''").select("verdict", F.rtrim("value", F.lit("\n")).alias("report"))
    named = lambda n: F.regexp_extract("report", rf"text {n}: .* \(id (-?[0-9]+)\)", 1).cast("long")
    return back.select(named(1).alias("doc_a"), named(2).alias("doc_b"), "verdict", "report")


Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    own = [
        s2_from_text, s5_decode, s6_quarantine, t1_normalize, t2_tokenize, t3_letters_lower, t4_counts, t5_sentence_lengths, t6_paragraph_lengths, t7_word_lengths,
        t8_punct_vector, t9_typo_vector, t10_top_habit, t11_script_counts, t12_dominant_script, t13_script_label, t14_scripts_differ, t15_chunks, t16_length_class,
        t17_word_stream, a1_word_profile, a3_rel_freq, a5_length_stats, a6_entropy, a7_richness, a8_zipf, a9_smooth_props, j1_pairs_explicit, j2_pairs, j3_identical,
        j4_profile_align, j5_top_keys, j6_top_combined, j7_restrict_renorm, j8_top_diff, j9_drop_keys, j10_key_sets, j11_chunk_pairs, m1_trigram_cosine, m_all,
        r1_distance, r3_self_distance, r9_scores_core, r9_scores, x1_metric_table, x2_rationale, x3_report, x4_eval, x5_summary, w3_corpus_statistics,
        s1_read_files, s3_signature, s4_looks_binary, s5_charsets, s7_scores_written, s7_metrics_written, s8_reports_written, r3_self_distance_core, r9_scores_self,
        t11_script_counts_mixed, t12_dominant_script_mixed, t14_scripts_differ_mixed, j1_pairs_listed, x4_eval_kinds, s8_reports_text, x5_summary_core,
    ]
    found: dict[str, Query] = {f.__name__: f for f in own}
    found |= {f"a2_char_profile_{n}": _a2(n) for n in (1, 2, 3)}
    found |= {"a4_sentence_hist": _a4("sentence_hist"), "a4_word_hist": _a4("word_hist"), "a4_paragraph_hist": _a4("paragraph_hist")}
    found |= {f"m{n}": _m(f"m{n}") for n in range(2, 18)}
    return found

"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, fim, jaccard_join, kdtree, line_dedup, mixing, packing, pii, spotsigs, token_counts, toxicity, whitening
from .common import materialize, table, text_of

#: Where the public vocabularies lie; files are named by each query.
VOCABULARY: Callable[[str], str] = public_tokenizers.path


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return kdtree.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY("byte_bpe_50k.json"))


#: The key of the registered queries; a real corpus needs a secret one of its own.
PII_KEY = "registered-query"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.replace_entities(table(spark, sf_dir, "documents"), key=PII_KEY)
    return docs.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon, weights = toxicity.learn(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, lexicon, weights)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "clauses")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY("piece_bpe_32k.model"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    # each row is logged as a service would stream it: an opening event, then its text in two deltas
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    half = F.floor(F.length("text") / 2).cast("int")
    log = rows.withColumn("turn", nth.cast("long")).withColumn(
        "event",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("step"), F.lit("message").alias("kind"), F.lit("").alias("piece")),
                F.struct(F.lit(1).alias("step"), F.lit("delta").alias("kind"), F.substring("text", F.lit(1), half).alias("piece")),
                F.struct(F.lit(2).alias("step"), F.lit("delta").alias("kind"), F.substring("text", half + 1, F.length("text")).alias("piece")),
            )
        ),
    )
    events = log.select("conv_id", (F.col("turn") * 3 + F.col("event.step")).alias("seq"), "event.kind", "turn", "role", F.col("event.piece").alias("text"))
    formatted = chat_format.render(chat_format.reconstruct(events))
    turns, loss = chat_format.read_back(F.col("formatted")), chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))
    read = formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
           UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = VOCABULARY("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    # each document is the next one of another: it sends that one the beginning it needs, and its signatures
    sizes = docs.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    after = spotsigs.following(docs).withColumnRenamed("id", "before").join(sizes.withColumnRenamed("doc_id", "before"), "before")
    after = after.select(F.col("next").alias("doc_id"), "before", F.floor(F.col("n") / 2).cast("int").alias("needed"))
    # both sides of the later join start alike, so that they share one shuffle of the texts
    placed = spotsigs.with_signatures(docs.where("doc_id IS NOT NULL").join(after, "doc_id"), "text", "a")
    sent = placed.select(F.col("before").alias("doc_id"), F.left("text", F.col("needed")).alias("other"), F.col("a").alias("c"))
    sent = sent.groupBy("doc_id").agg(F.min(F.struct("other", "c")).alias("x")).select("doc_id", "x.*")  # of several texts of one id the least
    alone = spotsigs.with_signatures(docs.where("doc_id IS NULL"), "text", "a").withColumn("other", F.lit("")).withColumn("c", F.lit(None).cast("array<long>"))
    rows = placed.select("doc_id", "text", "a").join(sent, "doc_id").unionByName(alone)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left(F.coalesce("other", F.lit("")), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "a", F.coalesce("c", F.array().cast("array<long>")).alias("c"), edited.alias("edited"))
    rows = spotsigs.with_signatures(rows, "edited", "b")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("a")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("b")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("a"), F.col("b")).alias("near_edited"),
        spotsigs.likeness(F.col("a"), F.col("c")).alias("near_next"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_dropped")


#: The template tree over {source}: what is left of each document's text.
LINES_SQL = """
li AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM {source}),
lo AS (SELECT doc_id, unnest(range(0, len(a))) AS line, unnest(a) AS raw FROM li),
lm AS (SELECT doc_id, line, raw, regexp_replace(trim(raw), '[^\\s0-9]*[0-9]\\S*', '<*>', 'g') AS template FROM lo),
lb AS (SELECT doc_id, line, template, string_split(template, ' ') AS tokens, md5(array_to_string(string_split(template, ' ')[1:3], ' ')) AS branch FROM lm WHERE template <> ''),
lf AS (SELECT doc_id, list_sort(list_distinct(list(branch))) AS b FROM lb GROUP BY doc_id),
ln AS (SELECT doc_id, line, template, tokens, (CASE WHEN b[1] = branch THEN b[2] ELSE b[1] END, CASE WHEN b[-1] = branch THEN b[-2] ELSE b[-1] END) AS family FROM lb JOIN lf USING (doc_id)),
lp AS (SELECT DISTINCT template, tokens, len(tokens) AS n, len(tokens) * 2 // 5 AS w FROM ln),
lw AS (SELECT template, tokens, n, w, unnest(range(0, n - w + 1, greatest(1, (n - w) // 7))) AS pos FROM lp WHERE w > 0),
lv AS (SELECT DISTINCT template, array_to_string(list_concat(list_concat(tokens[1:pos], list_transform(range(w), lambda x: '<*>')), tokens[pos + w + 1:]), ' ') AS form FROM lw WHERE pos >= 3 OR pos + w <= n - 3),
lc AS (SELECT form, count(*) AS variants FROM lv GROUP BY form HAVING count(*) >= 4),
lg AS (SELECT template, arg_min(form, (-variants, md5(form))) AS general FROM lv JOIN lc USING (form) GROUP BY template),
lt AS (SELECT ln.*, coalesce(lg.general, ln.template) AS general FROM ln LEFT JOIN lg USING (template)),
ld AS (SELECT general, min((doc_id, line)) AS first FROM lt GROUP BY general HAVING count(DISTINCT family) >= 4),
lx AS (SELECT doc_id, line FROM lt JOIN ld USING (general) WHERE (doc_id, line) <> first),
lines_left AS (SELECT m.doc_id, coalesce(string_agg(CASE WHEN x.line IS NULL THEN m.raw END, chr(10) ORDER BY m.line), '') AS text, CAST(count(x.line) AS BIGINT) AS lines_dropped
       FROM lm m LEFT JOIN lx x ON m.doc_id = x.doc_id AND m.line = x.line GROUP BY m.doc_id)
"""

OP9_SQL = "WITH " + LINES_SQL.replace("{source}", "documents") + "SELECT doc_id, text, lines_dropped FROM lines_left"


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), words=5, threshold=0.8)


#: Pairs of documents with five-word shingles of Jaccard similarity 0.8 or more, and their groups.
NEAR_SQL = """
t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM {source}),
u AS (SELECT doc_id, w, len(w) AS k FROM t WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, CASE WHEN k < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS s
      FROM (SELECT doc_id, w, k, unnest(range(1, greatest(k - 4, 1) + 1)) AS i FROM u)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
near AS (SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = d.doc_id), d.doc_id)) AS class_id,
         CAST((SELECT count(*) FROM e WHERE e.x = d.doc_id) AS BIGINT) AS n_links FROM {source} d)
"""

OP10_SQL = "WITH RECURSIVE " + NEAR_SQL.replace("{source}", "documents") + "SELECT doc_id, class_id, n_links FROM near"


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed="1")
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS x FROM documents),
h AS (SELECT *, CAST(length(t) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""

#: Weights of the registered mix in turn, and what it takes of all words.
MIX_WEIGHTS, MIX_SHARE = (3.0, 1.0, 2.0), 1.5


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sources = mixing.with_targets(mixing.cycled_weights(mixing.source_sizes(docs), MIX_WEIGHTS), share=MIX_SHARE, most=2)
    rows = mixing.with_copies(docs, sources, seed="1")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


# a level of water: sources are capped in the order of the level at which they are full
OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2 * z / w, source NULLS LAST) AS k FROM w),
c AS (SELECT *, coalesce(sum(2 * z) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before, sum(w) OVER (ORDER BY k DESC) AS free, sum(z) OVER () AS total FROM o),
v AS (SELECT arg_min((1.5::DOUBLE * total - full_before) / free, k) AS level FROM c WHERE (1.5::DOUBLE * total - full_before) / free <= 2 * z / w),
t AS (SELECT source, z, least(CAST(2 * z AS DOUBLE), w * level) AS target FROM c, v),
r AS (SELECT d.doc_id, size, z, target, CASE WHEN z > 0 THEN target / z ELSE 0 END AS rate,
      CAST('0x' || sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:13] AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, z AS source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    models = whitening.fit(vectors)
    rows = materialize(whitening.whiten(vectors, models, components=32), "whitened")
    error = whitening.identity_error(rows)
    each = rows.select("vec_id", "n", "deviation", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "x"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "x.whitened", "x.explained", F.lit(error).alias("identity_error"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk_search": op1_topk_search,
        "op2_packing": op2_packing,
        "op3_pii": op3_pii,
        "op4_toxicity": op4_toxicity,
        "op6_chat_format": op6_chat_format,
        "op5_token_counts": op5_token_counts,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_fingerprints": op8_fingerprints,
        "op9_line_dedup": op9_line_dedup,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_mixing": op12_mixing,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk_search": OP1_SQL,
        "op6_chat_format": OP6_SQL,
        "op9_line_dedup": OP9_SQL,
        "op10_jaccard_join": OP10_SQL,
        "op11_fill_in_middle": OP11_SQL,
        "op12_mixing": OP12_SQL,
    }

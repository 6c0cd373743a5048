"""Line dedup by a log-template tree of fixed depth.

A line's way down the tree is its token count, then its leading tokens; a second
branch, for lines whose leading tokens vary, takes the last tokens instead. Every
token with a digit is a variable field, ``<*>``. In a leaf, templates that agree but
for one window of tokens are variants of one general template: the window becomes
``<*>``. A template that recurs in unrelated documents is boilerplate: its lines are
dropped everywhere but at their first place. Copies of a whole document are left to
near-duplicate removal: documents count as one if the rest of both, the judged line
left out, takes the same least and the same greatest hashed branch. Only SQL
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW, join_hot, materialize, text_of, whole_row, with_columns

#: Leading (or last) tokens on a line's way to its leaf.
DEPTH = 3
#: So many variants of one general template make it one.
VARIANTS = 4
#: A window takes two fifths of the tokens, so that three fifths stay constant...
WINDOW = (2, 5)
#: ...and is tried at every start, or, in long lines, at so many even steps.
STEPS = 7


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per line that isn't blank: doc, line (from 0), template, hash (128 bits), family."""
    split = docs.select(F.col(id_col).alias("doc"), F.split(text_of(text_col), "\n", -1).alias("all"))
    masked = lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(F.trim(x), r"[^\s0-9]*+[0-9]\S*", "<*>")).otherwise(F.trim(x))
    split = split.select("doc", F.transform("all", masked).alias("all"))
    branch = lambda x: F.unhex(F.md5(F.substring_index(x, " ", DEPTH)))
    each = split.select("doc", F.transform("all", lambda x: F.struct(x.alias("template"), branch(x).alias("branch"))).alias("all"))
    branches = F.transform(F.filter("all", lambda x: x["template"] != ""), lambda x: x["branch"])
    rows = each.withColumn("b", F.array_sort(F.array_distinct(branches)))
    rows = rows.select("doc", F.slice("b", 1, 2).alias("low"), F.slice(F.reverse("b"), 1, 2).alias("high"), F.posexplode("all").alias("line", "x"))
    rows = rows.select("doc", "line", "x.template", "x.branch", "low", "high").where("template <> ''")
    # the ends of the other lines' branches
    other = lambda ends: F.coalesce(F.when(F.get(ends, F.lit(0)) == F.col("branch"), F.get(ends, F.lit(1))).otherwise(F.get(ends, F.lit(0))), F.lit(b""))
    return rows.select("doc", "line", "template", F.unhex(F.md5("template")).alias("hash"), F.xxhash64(other("low"), other("high")).alias("family"))


def _leaves(template: Column) -> list[Column]:
    """Both leaves of a template; equal ones of different templates only cost time."""
    tokens = F.regexp_count(template, F.lit(" "))
    return [F.xxhash64(tokens, F.substring_index(template, " ", k)) for k in (DEPTH, -DEPTH)]


def _general(lines: DataFrame, stored: DataFrame) -> DataFrame:
    """(hash, general, n): the general templates of templates that have one, and each one's lines."""
    leaves = stored.select("hash", F.explode(F.array("head", "tail")).alias("leaf")).distinct()
    rich = materialize(leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= VARIANTS).select("leaf"), "leaves")
    rich = F.broadcast(rich) if rich.count() <= FEW else rich
    head, tail = _leaves(F.col("template"))
    texts = lines.select("hash", "template", head.alias("head"), tail.alias("tail"))
    for side in ("head", "tail"):
        texts = texts.join(rich.select(F.col("leaf").alias(side), F.lit(True).alias(f"rich_{side}")), side, "left")
    texts = texts.where("rich_head OR rich_tail").groupBy("hash").agg(F.any_value("template").alias("template"), F.count(F.lit(1)).alias("n"))
    texts = texts.withColumn("tokens", F.split("template", " ", -1)).withColumn("size", F.size("tokens"))
    texts = texts.withColumn("w", F.floor(F.col("size") * WINDOW[0] / WINDOW[1]).cast("int")).where("w > 0")
    starts = F.sequence(F.lit(0), F.col("size") - F.col("w"), F.greatest(F.lit(1), F.floor((F.col("size") - F.col("w")) / STEPS).cast("int")))
    placed = texts.select("hash", "n", "tokens", "size", "w", F.explode(starts).alias("at")).where((F.col("at") >= DEPTH) | (F.col("at") + F.col("w") <= F.col("size") - DEPTH))
    form = F.concat(F.slice("tokens", F.lit(1), F.col("at")), F.array_repeat(F.lit("<*>"), F.col("w")), F.slice("tokens", F.col("at") + F.col("w") + 1, F.col("size")))
    forms = materialize(placed.select("hash", "n", F.unhex(F.md5(F.array_join(form, " "))).alias("form")).distinct(), "forms")
    sizes = materialize(forms.groupBy("form").agg(F.count(F.lit(1)).alias("variants")).where(F.col("variants") >= VARIANTS), "variants")
    met = join_hot(forms, sizes.withColumn("k", F.col("variants")), ["form"], "k", forms.count())
    best = F.min_by("form", F.struct(-F.col("variants"), F.col("form")))
    return materialize(met.groupBy("hash").agg(best.alias("general"), F.max("n").alias("n")), "general")


def recurring_lines(docs: DataFrame, min_documents: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, line) of every line to drop: its template recurs, and has an earlier place."""
    lines = _lines(docs, id_col, text_col)
    head, tail = _leaves(F.col("template"))
    stored = materialize(lines.select("doc", "line", "hash", "family", head.alias("head"), tail.alias("tail")), "lines")
    total = stored.count()
    general = _general(lines, stored)
    places = stored.select("doc", "line", "family", "hash")
    counted = join_hot(places, general, ["hash"], "n", total, "left").select("doc", "line", "family", F.coalesce("general", "hash").alias("general"))
    often = counted.groupBy("general").agg(F.count_distinct("family").alias("documents"), F.count("*").alias("n"), F.min(F.struct("doc", "line")).alias("first"))
    often = materialize(often.where(F.col("documents") >= min_documents).select("general", "n", "first"), "recurring")
    again = join_hot(counted, often, ["general"], "n", total).where(~F.struct("doc", "line").eqNullSafe(F.col("first")))
    return again.select("doc", "line")


def drop_recurring_lines(docs: DataFrame, min_documents: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines whose template recurs in ``min_documents`` unrelated documents.

    All rows and columns stay; ``text_col`` has the lines that are left (a null
    text becomes empty), and lines_dropped counts the others (it takes the place of
    an input column of that name; no other name can clash). The first place of a
    template, by id and line, keeps its line. Blank lines are never dropped. Each
    row counts as a document; rows of one id lose the same line numbers, rows with
    a null id count, but keep all their lines. Documents of one line each, the
    judged one, count as one. An empty table gives no rows.
    """
    dropped = recurring_lines(docs, min_documents, id_col, text_col)
    dropped = dropped.where("doc IS NOT NULL").groupBy("doc").agg(F.collect_set("line").alias("gone"))  # a document's lines at most
    rows = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("doc")).join(dropped, "doc", "left")
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    new = {text_col: F.when(F.col("gone").isNull(), text).otherwise(left), "lines_dropped": F.greatest(F.size("gone"), F.lit(0)).cast("long")}
    return with_columns(rows, docs, new)

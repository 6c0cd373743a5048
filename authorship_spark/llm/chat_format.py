"""Chat formatting by event sourcing: a log of events becomes final messages, then text.

Events of a conversation, by ``seq``:

- ``message`` opens a turn: its role, and the text so far;
- ``delta`` adds to the text of its turn;
- ``edit`` puts another text in the place of its turn's;
- ``regenerate`` empties its turn and withdraws every later turn logged before it.

The log is dealt out once, by conversation; the fold, the running offsets and the
rendering all work on that one partitioning. Only SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Text in which no control string stands: ``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|``..."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """A role stands on one line, so its line ends are escaped too."""
    return escape(F.regexp_replace(F.regexp_replace(role, "<(~*)nl>", "<~$1nl>"), "\n", "<nl>"))


def unescape_role(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unescape(role), "<nl>", "\n"), "<~(~*)nl>", "<$1nl>")


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, seq, kind, turn, role, text).

    Events of one ``seq`` count in the order opening, edit, regenerate, delta, then by
    text, so repeated events give the same result each time. Deltas without an opening
    event make a turn of role ''. Null texts and roles are empty; a null conversation
    id is one conversation. A turn that was withdrawn and not written again is absent.
    """
    event = F.struct(
        F.col("seq"),
        F.expr("CASE kind WHEN 'message' THEN 0 WHEN 'edit' THEN 1 WHEN 'regenerate' THEN 2 ELSE 3 END").alias("step"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("role", F.lit("")).alias("role"),
    )
    turns = events.repartition("conv_id").groupBy("conv_id", "turn").agg(
        F.array_sort(F.collect_list(event)).alias("log"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("since", F.max("again").over(earlier))
    turns = turns.withColumn("log", F.when(F.col("since").isNull(), F.col("log")).otherwise(F.filter("log", lambda e: e["seq"] > F.col("since"))))
    last = F.array_max(F.transform(F.filter("log", lambda e: e["step"] < 3), lambda e: F.struct(e["seq"], e["step"], e["text"])))
    turns = turns.where(F.size("log") > 0).withColumn("last", last)
    # what counts: the last opening event and the deltas after it
    added = F.filter("log", lambda e: (e["step"] == 3) & (F.col("last").isNull() | (e["seq"] >= F.col("last.seq"))))
    head = F.when(F.coalesce(F.col("last.step"), F.lit(2)) == 2, F.lit("")).otherwise(F.col("last.text"))
    roles = F.filter("log", lambda e: e["role"] != "")
    return turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.try_element_at(F.transform(roles, lambda e: e["role"]), F.lit(-1)), F.lit("")).alias("role"),
        F.concat(head, F.array_join(F.transform(added, lambda e: e["text"]), "")).alias("text"),
    )


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans.

    Every turn is START, role, line end, escaped text, END, line end. ``loss_spans``
    (start, end, in code points from 0) hold the texts of role ``learn``: the loss mask.
    """
    part = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.withColumn("part", part).withColumn("at", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)))
    start = F.col("at") + F.length(F.concat(F.lit(START), escape_role(F.col("role")))) + 1
    rows = rows.withColumn("start", start).withColumn("end", F.col("at") + F.length("part") - len(END) - 1)
    turn = F.struct("turn", "part", (F.col("role") == learn).alias("learn"), F.struct("start", "end").alias("span"))
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return held.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["part"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: t["span"]).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - len(END) - 2)
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")

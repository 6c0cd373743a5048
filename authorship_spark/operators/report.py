"""Rationale, text reports, summaries and the ordering check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import rounded
from ..functions.scripts import script_label
from .align import PAIR, keys
from .metrics import NAMES

#: Middle of the scale: what is nearer counts as alike, what is farther as different.
MIDDLE = 0.5


def rationale(long: DataFrame, scored: DataFrame, strongest: bool = False) -> DataFrame:
    """(doc_a, doc_b, part, nth, metric, distance): what speaks for and against one author.

    Three most alike from p = .65 up, three most different to .35, two of each between.
    Alike: the smallest distances up to 0.5; different: the first ones from 0.5 up,
    ascending (or, with ``strongest``, the largest first). If none qualifies: alike
    from the largest down, different from the smallest up. Neutral metrics don't count;
    ties keep the metrics' order.
    """
    p, key = F.col("p"), keys(scored)
    want = scored.select(*key, F.when(p >= 0.65, 3).when(p <= 0.35, 0).otherwise(2).alias("alike"), F.when(p >= 0.65, 0).when(p <= 0.35, 3).otherwise(2).alias("different"))
    ranked = F.array_sort(F.transform(F.filter("held", lambda x: ~x["neutral"]), lambda x: F.struct(x["distance"].alias("distance"), x["metric_no"].alias("metric_no"), x["metric"].alias("metric"))))
    rows = _together(long).join(want, key).withColumn("ranked", ranked)

    def part(name: str, fits: Callable[[Column], Column], strongest: bool, falling: bool) -> Column:
        fitting, turned = F.filter("ranked", fits), lambda x, turn: F.reverse(x) if turn else x
        chosen = F.slice(F.when(F.size(fitting) > 0, turned(fitting, strongest)).otherwise(turned(F.col("ranked"), falling)), 1, F.col(name))
        return F.transform(chosen, lambda x, i: F.struct(F.lit(name).alias("part"), (i + 1).alias("nth"), x["metric"].alias("metric"), x["distance"].alias("distance")))

    alike = part("alike", lambda x: x["distance"] <= MIDDLE, False, True)
    different = part("different", lambda x: x["distance"] >= MIDDLE, strongest, False)
    return rows.select(*key, F.inline(F.concat(alike, different)))


def _together(long: DataFrame) -> DataFrame:
    """A row for each pair, with all its metrics in their order: so they are shuffled once, whatever is made of them."""
    each = F.struct("metric_no", "metric", "distance", "weight", "neutral")
    return long.groupBy(*keys(long)).agg(F.array_sort(F.collect_list(each)).alias("held"))


def _fixed(x: Column, places: int) -> Column:
    """To so many places, rounded as SQL rounds."""
    return F.format_string(f"%.{places}f", rounded(x, places))


def render_report(scored: DataFrame, long: DataFrame, reasons: DataFrame) -> DataFrame:
    """(doc_a, doc_b, verdict, report): a text block per pair, with title, words, script and charset of both texts."""
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    name = lambda x: F.element_at(names, x["metric"])

    def line(x: Column) -> Column:
        about = F.format_string("%-4s %-28s", x["metric"], name(x))
        return F.when(x["neutral"], F.concat(about, F.lit(" neutral"))).otherwise(F.concat(about, F.lit(" d="), _fixed(x["distance"], 3), F.lit(" w="), _fixed(x["weight"], 2)))

    key = keys(scored)
    lines = _together(long).select(*key, F.array_join(F.transform("held", line), "\n").alias("metrics"))
    reason = lambda x: F.concat(x["part"], F.lit(": "), name(x), F.lit(" ("), _fixed(x["distance"], 3), F.lit(")"))
    said = F.array_sort(F.collect_list(F.struct("part", "nth", "metric", "distance")))
    why = reasons.groupBy(*key).agg(said.alias("said")).select(*key, F.array_join(F.transform("said", reason), "\n").alias("why"))
    rows = scored.join(lines, key, "left").join(why, key, "left")
    used = (F.col("p_self") > 0.5) & (F.col("p0") > F.col("p_topic") + 1e-9)
    own = F.when(used, F.concat(F.lit("\nself distance "), _fixed(F.col("self_distance"), 3), F.lit(", P(self) "), _fixed(F.col("p_self"), 3))).otherwise("")
    about = lambda c, s: F.col(f"{c}_{s}") if f"{c}_{s}" in scored.columns else F.lit(None).cast("string")

    def text(nth: int, s: str) -> Column:
        title = F.coalesce(about("title", s), F.lit("untitled"))
        script = F.coalesce(script_label(about("dominant_script", s)), F.lit("no letters"))
        return F.format_string("text %d: %s (id %s), %d words, script %s, charset %s", F.lit(nth), title, F.col(f"doc_{s}").cast("string"), F.col(f"words_{s}"), script, F.coalesce(about("charset", s), F.lit("given as text")))

    heading = F.format_string("%s: P = %s%% +- %s%%", "verdict", _fixed(F.col("p") * 100, 1), _fixed(F.col("margin") * 100, 1))
    head = F.concat_ws("\n", heading, text(1, "a"), text(2, "b"))
    value = {c: _fixed(F.col(c), 3) for c in ("D", "S", "p_topic", "p0", "f")}
    sums = F.concat(F.format_string("D %s, S %s, P(topic) %s", value["D"], value["S"], value["p_topic"]), own, F.format_string("\nP0 %s, f %s", value["p0"], value["f"]))
    warn = F.when(F.size("warnings") > 0, F.concat(F.lit("warnings: "), F.array_join("warnings", ", ")))
    return rows.select(*key, "verdict", F.concat_ws("\n\n", head, "metrics", sums, "why", warn).alias("report"))


def eval_ordering(scored: DataFrame, labelled: DataFrame) -> DataFrame:
    """(group, passed): P of a group's same-author pair (kind AA) is over all its others; kind II needs P of 0.90.

    ``labelled`` has doc_a, doc_b, group and kind (AA, AB, AC, BC or II).
    """
    rows = labelled.join(scored.select(*PAIR, "p"), list(PAIR))
    found = rows.groupBy("group").agg(
        F.max(F.when(F.col("kind") == "AA", F.col("p"))).alias("same"),
        F.max(F.when(F.col("kind").isin("AB", "AC", "BC"), F.col("p"))).alias("other"),
        F.min(F.when(F.col("kind") == "II", F.col("p"))).alias("identical"),
    )
    ordered = F.coalesce(F.col("same") > F.col("other"), F.lit(True))
    return found.select("group", (ordered & F.coalesce(F.col("identical") >= 0.90, F.lit(True))).alias("passed"))


def verdict_summary(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs and mean P per verdict (and ``by``)."""
    return scored.groupBy("verdict", *by).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"))

"""What names a pair, and how many grams of its aligned profiles each metric takes."""

from __future__ import annotations

from pyspark.sql import DataFrame

PAIR = ("doc_a", "doc_b")
#: Grams of the combined ranking that each metric takes.
TOP = {"M1": 300, "M2": 250, "M3": 100, "M4": 300, "M10": 50, "M17": 400}
#: Grams of the greatest difference that M13 leaves out at most, by kind.
DROPPED = {"c3": 150, "w": 120}


def keys(rows: DataFrame) -> list[str]:
    """What names a row's pair: the two documents, and the number of a listed pair where it has one."""
    return [c for c in ("pair_id", *PAIR) if c in rows.columns]

"""Style vectors of fixed length, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 16 marks of the punctuation vector, in order.
MARKS = [",", ".", "!", "?", ";", ":", "«", "»", '"', "'", "(", ")", "—", "–", "…", "-"]
#: The 12 habits of the typography vector, in order.
HABITS = ["space_before_mark", "double_space", "three_dots", "ellipsis", "em_dash", "hyphen_dash", "en_dash", "straight_quote", "guillemets", "curly_quotes", "apostrophe", "emoji_caps"]
SENTENCE_BINS, WORD_BINS, PARAGRAPH_BINS = 40, 15, 60
_LETTER = r"[\p{L}&&[^\x{10000}-\x{10FFFF}]]"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _one(text: Column, mark: str) -> Column:
    """How often a string that can't overlap itself stands in a text."""
    return (F.length(text) - F.length(F.replace(text, F.lit(mark)))) / F.lit(len(mark))


def _per_1000(counts: list[Column], letters: Column) -> Column:
    norm = F.greatest(F.lit(1), letters) / F.lit(1000.0)
    return F.array(*(c / norm for c in counts))


def punct_vector(text: Column, letters: Column) -> Column:
    return _per_1000([_one(text, m) for m in MARKS], letters)


def typo_vector(text: Column, letters: Column) -> Column:
    # what a pattern begins with is rare, and looking behind comes after it: each sign is looked at once
    caps = _count(text, rf"(?=\p{{Lu}}{{3}})(?<!{_LETTER})\p{{Lu}}{{3,}}(?=[^\p{{L}}]|\p{{L}}(?<![\x{{0000}}-\x{{FFFF}}]))")
    counts = [
        _count(text, r"[,.!?;:](?<=[ \t\n].|^.)"),
        _count(text, " (?<=  )"),
        _count(text, r"\.{3,}"),
        _one(text, "…"),
        _one(text, "—"),
        _one(text, "- "),
        _one(text, "–"),
        _one(text, '"'),
        _one(text, "«") + _one(text, "»"),
        _one(text, "“") + _one(text, "”") + _one(text, "„"),
        _count(text, r"'(?<=\p{L}')(?=\p{L})"),
        _count(text, r"[\x{1F000}-\x{10FFFF}\x{2600}-\x{27BF}\x{2190}-\x{21FF}]") + 3 * caps,
    ]
    return _per_1000(counts, letters)


def top_habit(typo: Column) -> Column:
    """The first largest habit as name=value; the exact value is rounded, halves to even, as printf does in SQL."""
    at = F.array_position(typo, F.array_max(typo)).cast("int")
    # format_string would round the shortest decimal form, halves up
    return F.concat_ws("=", F.element_at(F.lit(HABITS), at), F.call_function("format_number", F.array_max(typo), F.lit("0.00")))


def histogram(values: Column, bins: int) -> Column:
    """Shares of the values 1..bins, larger ones in the last; zeros without values.

    Each value becomes one sign, and a bin's signs are counted by leaving them out: the
    values are looked at once, and a bin costs a pass over a short string.
    """
    sign = lambda b: F.char(b + 32)
    signs = F.array_join(F.transform(values, lambda v: sign(F.greatest(F.lit(1), F.least(F.lit(bins), v)))), "")
    share = lambda s, b: (F.length(s) - F.length(F.replace(s, F.lit(chr(b + 32)), F.lit("")))) / F.greatest(F.length(s), F.lit(1))
    # through an array of one, so that the signs are made once and not for each bin
    return F.transform(F.array(signs), lambda s: F.array(*(share(s, b) for b in range(1, bins + 1))))[0]


def length_stats(values: Column) -> Column:
    """Mean and sample deviation; 0 and 0 without values, deviation 0 for one."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / n
    spread = F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
    return F.struct(F.when(n > 0, mean).otherwise(0.0).alias("mean"), F.when(n > 1, F.sqrt(spread / (n - 1))).otherwise(0.0).alias("sd"))


def smooth_props(v: Column) -> Column:
    """Add a half to each value and rescale to a sum of 1."""
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x + 0.5)
    return F.transform(v, lambda x: (x + 0.5) / total)

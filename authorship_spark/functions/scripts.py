"""Unicode scripts of letters.

Which letter is of which script is a table of code-point ranges over all scripts of the
JVM's Unicode version. It is read off the JVM once a session - each script's runs in
one text of all code points - and enters plans as a constant: an array with an entry
for each page of 256 code points, which holds the few ranges that lie on that page.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import letters as letters_of

#: Labels of scripts, by how often they are met; any other script is labelled by its name.
LABELS = {
    "LATIN": "Latin", "CYRILLIC": "Cyrillic", "GREEK": "Greek", "HAN": "Chinese characters", "HIRAGANA": "Hiragana", "KATAKANA": "Katakana", "HANGUL": "Hangul",
    "ARABIC": "Arabic", "HEBREW": "Hebrew", "DEVANAGARI": "Devanagari", "THAI": "Thai", "ARMENIAN": "Armenian", "GEORGIAN": "Georgian", "BENGALI": "Bengali", "TAMIL": "Tamil",
    "TELUGU": "Telugu", "KANNADA": "Kannada", "MALAYALAM": "Malayalam", "GUJARATI": "Gujarati", "GURMUKHI": "Gurmukhi", "ORIYA": "Oriya", "SINHALA": "Sinhala", "LAO": "Lao", "TIBETAN": "Tibetan",
    "MYANMAR": "Myanmar", "KHMER": "Khmer", "ETHIOPIC": "Ethiopic", "MONGOLIAN": "Mongolian", "CHEROKEE": "Cherokee", "SYRIAC": "Syriac", "THAANA": "Thaana", "BOPOMOFO": "Bopomofo",
    "COMMON": "common letters", "INHERITED": "marks",
}
CJK = ("HAN", "HIRAGANA", "KATAKANA")
#: Each script of the table is marked by one sign of a private-use area, in the table's order.
_FIRST_MARK, _NO_SCRIPT = 0xE000, "\uf8ff"
_PAGE = 256


@lru_cache(maxsize=1)
def letter_ranges() -> tuple[tuple[int, int, str], ...]:
    """(first, last, script) of every run of letters of one script, by code point, as the driver's JVM has them."""
    spark = SparkSession.active()
    names = [s.name() for s in spark.sparkContext._jvm.java.lang.Character.UnicodeScript.values() if s.name() != "UNKNOWN"]
    # all planes that hold letters, without surrogates and private-use areas
    text = "".join(map(chr, (c for c in range(0x40000) if not 0xD800 <= c < 0xF900)))
    patterns = spark.createDataFrame([(n, rf"[\p{{L}}&&[\p{{script={n}}}]]+") for n in names], "script string, pattern string")
    found = patterns.select("script", F.explode(F.regexp_extract_all(F.lit(text), F.col("pattern"), F.lit(0))).alias("run"))
    rows = found.select("script", F.ascii(F.left("run", F.lit(1))).alias("first"), F.ascii(F.right("run", F.lit(1))).alias("last")).collect()
    return tuple(sorted((r["first"], r["last"], r["script"]) for r in rows))


@lru_cache(maxsize=1)
def _pages() -> tuple[str, tuple[str, ...]]:
    """The table by pages, as JSON, and the scripts' names in the order of their marks."""
    ranges = letter_ranges()
    names = tuple(sorted({s for *_, s in ranges}))
    pages: list[list] = [[] for _ in range(max(last for _, last, _ in ranges) // _PAGE + 1)]
    for first, last, script in ranges:
        mark = chr(_FIRST_MARK + names.index(script))
        for page in range(first // _PAGE, last // _PAGE + 1):
            pages[page].append({"first": first, "last": last, "mark": mark})
    return json.dumps(pages, ensure_ascii=False), names


def script_counts(text: Column, letters: Column | None = None) -> Column:
    """An array (script, n) of the letters of each script that the text has; letters of no script are left out.

    Latin letters, the commonest, are counted by leaving them out run by run. Where others are left, each
    distinct one is looked up in the table, all letters are turned into their scripts'
    marks in one pass, and the marks are counted: linear in the text. ``letters`` are those of the text, where they are known.
    """
    table, names = _pages()
    pages = F.from_json(F.lit(table), "array<array<struct<first:int,last:int,mark:string>>>")

    def mark(letter: Column) -> Column:
        point = F.ascii(letter)
        near = F.get(pages, F.floor(point / _PAGE).cast("int"))
        found = F.filter(F.coalesce(near, F.array().cast("array<struct<first:int,last:int,mark:string>>")), lambda r: (r["first"] <= point) & (point <= r["last"]))
        return F.coalesce(F.get(found, F.lit(0))["mark"], F.lit(_NO_SCRIPT))

    def marked(rest: Column, held: Column) -> Column:
        """From the letters' marks to an array (script, n)."""
        made = F.call_function("translate", rest, F.array_join(F.transform(held, lambda x: x["letter"]), ""), F.array_join(F.transform(held, lambda x: x["mark"]), ""))
        return F.transform(F.array(made), lambda m: F.transform(
            F.array_remove(F.array_distinct(F.transform(held, lambda x: x["mark"])), _NO_SCRIPT),
            lambda k: F.struct(F.get(F.lit(list(names)), F.ascii(k) - _FIRST_MARK).alias("script"), (F.length(m) - F.length(F.replace(m, k, F.lit("")))).cast("long").alias("n")),
        ))[0]

    def counted(letters: Column, rest: Column) -> Column:
        latin = F.struct(F.lit("LATIN").alias("script"), (F.length(letters) - F.length(rest)).cast("long").alias("n"))
        looked_up = F.transform(F.array_distinct(F.split(rest, "")), lambda c: F.struct(c.alias("letter"), mark(c).alias("mark")))
        others = F.when(rest != "", F.transform(F.array(looked_up), lambda held: marked(rest, held))[0])
        return F.filter(F.concat(F.array(latin), F.coalesce(others, F.array().cast("array<struct<script:string,n:bigint>>"))), lambda x: x["n"] > 0)

    # through arrays of one, so that letters are found and looked up once and not for each use
    found = F.transform(F.array(letters_of(text) if letters is None else letters), lambda x: F.struct(x.alias("letters"), F.regexp_replace(x, r"[a-zA-Z\p{IsLatin}]+", "").alias("rest")))
    return F.transform(found, lambda x: counted(x["letters"], x["rest"]))[0]


def dominant_script(text: Column, letters: Column | None = None) -> Column:
    """The commonest script, on a tie the first by name; null without letters of a script."""
    return F.array_min(F.transform(script_counts(text, letters), lambda x: F.struct((-x["n"]).alias("n"), x["script"].alias("script"))))["script"]


def script_label(script: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair)), script), script)


def is_cjk(script: Column) -> Column:
    return script.isin(*CJK)


def scripts_differ(a: Column, b: Column) -> Column:
    """False if either is unknown; else whether they are of different scripts."""
    return F.coalesce((is_cjk(a) != is_cjk(b)) | (a != b), F.lit(False))

"""Normalising, tokenising and cutting texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .helpers import nfc

# Fixed patterns. Letters of Han, Hiragana and Katakana are tokens of their own.
_CJK = r"[\p{L}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]"
# Below U+2E80 there are none of them, so nothing there is looked up in the table of scripts.
# Small letters and digits, the commonest, are tried first.
TOKEN = r"[a-z0-9[[\p{L}\p{Nd}\p{M}]&&[\x{0000}-\x{2E7F}[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]]]+|" + _CJK
SENTENCE_END = "[\n.!?…。！？؛۔॥|]"
_ENDS = SENTENCE_END[1:-1]
_NOT_PLAIN = r"[^\x{0000}-\x{02FF}]"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"

SHORT_WORDS, CRITICAL_WORDS = 500, 150
#: Words from which a text is cut into so many chunks.
CHUNKS = ((1400, 4), (700, 3), (260, 2))
STREAM_WORDS = 4000
#: What is trimmed from a text's ends: all up to U+0020.
_BLANKS = "".join(map(chr, range(0x21)))


def plain(text: Column) -> Column:
    """Whether a text has no character from U+0300 on: then NFC leaves it as it is."""
    return ~text.rlike(_NOT_PLAIN)


def normalize_text(text: Column, compose: bool = True) -> Column:
    """NFC, LF line ends, and no characters up to U+0020 at either end; null stays null.

    Only texts with a character from U+0300 on can change under NFC, so only they
    go to Python. ``compose=False`` is for texts known to be in NFC.
    """
    if compose:
        text = F.coalesce(nfc(F.when(~plain(text), text)), text)
    lines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    # no pattern: one for the end of a text would start anew at every blank of every run
    return F.btrim(lines, F.lit(_BLANKS))


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters, digits and marks, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    """How many tokens a text has, without making them."""
    return F.regexp_count(F.lower(text), F.lit(TOKEN))


def letters_lower(text: Column) -> Column:
    """The letters alone, each in lower case for itself (so a final sigma stays a sigma)."""
    return letters(F.lower(F.replace(text, F.lit("Σ"), F.lit("σ"))))


def letters_lower_of(text: Column, only_letters: Column) -> Column:
    """``letters_lower`` where the text's letters are known. Below U+0300 lower case keeps letters letters, but for a mark that U+0130 gets; farther up the JVM and its tables of case may differ."""
    return F.when(plain(text), F.replace(F.lower(only_letters), F.lit("\u0307"), F.lit(""))).otherwise(letters_lower(text))


def letters(text: Column) -> Column:
    """The letters alone. What lies between them goes run by run: a match costs more than the signs in it."""
    return F.regexp_replace(text, r"[^a-zA-Z\p{L}]+", "")


def letter_count(text: Column) -> Column:
    return F.length(letters(text))


def _token_counts(text: Column, cut: str) -> Column:
    pieces = F.transform(F.split(F.lower(text), cut, -1), lambda s: F.regexp_count(s, F.lit(TOKEN)))
    return F.filter(pieces, lambda n: n > 0)


def sentence_lengths(text: Column) -> Column:
    return _token_counts(text, SENTENCE_END)


def paragraph_lengths(text: Column) -> Column:
    """Tokens of each line that has any."""
    return _token_counts(text, "\n+")


def tokens_and_ends(text: Column) -> Column:
    """The tokens in order, with each sign that ends a sentence as an element between them. No token has such a sign."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{TOKEN}|{SENTENCE_END}"), F.lit(0))


def is_end(element: Column) -> Column:
    return F.instr(F.lit(_ENDS), element) > 0


def shape(elements: Column) -> Column:
    """One sign for each element of ``tokens_and_ends``: a line end, a dot for another end, w for a token."""
    return F.array_join(F.transform(elements, lambda x: F.when(x == "\n", "\n").when(is_end(x), ".").otherwise("w")), "")


def lengths_in(shape: Column, cut: str) -> Column:
    """Tokens of each piece that has any, from the text's shape: ``sentence_lengths`` and ``paragraph_lengths`` without another look at the text."""
    pieces = F.split(shape if "." in cut else F.replace(shape, F.lit("."), F.lit("")), cut, -1)
    return F.filter(F.transform(pieces, F.length), lambda n: n > 0)


def outline(text: Column) -> Column:
    """A text with one letter for each run of small ones: for what asks only whether a letter stands there."""
    return F.regexp_replace(text, "[a-z]+", "a")


def word_lengths(words: Column) -> Column:
    """Lengths in UTF-16 units; word by word they are searched for pairs of units only if there is one in some word."""
    units = F.transform(words, lambda w: F.length(w) + F.regexp_count(w, F.lit(ASTRAL)))
    return F.when(F.array_join(words, "").rlike(ASTRAL), units).otherwise(F.transform(words, F.length))


def word_stream(words: Column) -> Column:
    """The first words, each with a space after it."""
    first = F.slice(words, 1, STREAM_WORDS)
    return F.when(F.size(words) > 0, F.concat(F.array_join(first, " "), F.lit(" "))).otherwise("")


def chunk_number(word_count: Column) -> Column:
    out = F.lit(0)
    for least, k in reversed(CHUNKS):
        out = F.when(word_count >= least, F.lit(k)).otherwise(out)
    return out

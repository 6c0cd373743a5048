"""Fill-in-middle: texts rearranged so that a model learns to write what stands between two parts.

A numpy kernel cuts all texts of an Arrow batch at once, on their UTF-8 bytes: a
table gives each byte its class, a table of two neighbours' classes says where a
unit begins, a running sum that starts anew with each text numbers the units, and
one binary search for all rows finds the bytes of their cuts. The parts are slices
of the same buffer, so nothing is decoded and no row is handled alone.

Where a text is cut, and in which form it is written, follows from a seed and its
id alone: runs agree, and no row depends on another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import column, ready, text_of, with_columns

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are rearranged, and of these so many begin with their suffix.
REARRANGED, SUFFIX_FIRST = 90, 20

_CONTINUED, _LINE_END, _BLANK, _OTHER = range(4)


def _byte_classes() -> bytes:
    classes = np.full(256, _OTHER, np.uint8)
    classes[0x80:0xC0] = _CONTINUED
    classes[[9, 11, 12, 13, 32]] = _BLANK
    classes[10] = _LINE_END
    return classes.tobytes()


def _begins(unit: str) -> bytes:
    """For 4 x the class of a byte + that of the next one: whether a unit begins with the next one."""
    table = np.zeros((4, 4), np.uint8)
    if unit == "char":
        table[:, [_LINE_END, _BLANK, _OTHER]] = 1
    elif unit == "word":
        table[[_LINE_END, _BLANK], _OTHER] = 1
    elif unit == "line":
        table[_LINE_END, [_LINE_END, _BLANK, _OTHER]] = 1
    else:
        raise ValueError(f"no such unit: {unit}")
    return table.tobytes().ljust(256, b"\0")


_CLASSES = _byte_classes()


def _looked_up(data: np.ndarray, table: bytes) -> np.ndarray:
    """Each byte's value in a table of 256, at one byte of memory for each (an index array would take eight)."""
    return np.frombuffer(data.tobytes().translate(table), np.uint8)


def unit_cuts(data: np.ndarray, offsets: np.ndarray, unit: str, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units of each text, and two cuts of each: (n, units before either cut, byte of either cut).

    Text i is data[offsets[i]:offsets[i + 1]]. ``first`` and ``second`` are draws: a
    text of n units is cut after the smaller and the larger of their remainders by n + 1.
    """
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets.astype(np.int64) - base
    starts, ends = offsets[:-1], offsets[1:]
    classes = _looked_up(data, _CLASSES)
    mask = np.zeros(len(data), np.uint8)
    mask[1:] = _looked_up(4 * classes[:-1] + classes[1:], _begins(unit))
    mask[starts[starts < ends]] = 1  # a text's first byte, whatever the last text ended with
    held = np.cumsum(mask, dtype=np.int32) if len(data) else np.zeros(1, np.int32)
    upto = lambda at: np.where(at > 0, held[np.maximum(at, 1) - 1], 0).astype(np.int64)
    before = upto(starts)  # the sum starts anew with each text
    n = upto(ends) - before
    a, b = first % (n + 1), second % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    # unit k of a text begins where the running sum first reaches the text's own k + 1; the cut after all units is its end
    at = lambda k: np.where(k == n, ends, np.searchsorted(held, (before + k + 1).astype(np.int32))) + base
    return n, low, high, at(low), at(high)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins and ends."""
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    held = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), held


def _arranged(texts: pa.Array, form: pa.Array, low: np.ndarray, high: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Each text in its form; the three parts of all texts are one array over the texts' own buffer."""
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    first = np.frombuffer(offsets, kind)[texts.offset : texts.offset + 1]
    cuts = np.concatenate([first, np.stack([low, high, ends], axis=1).ravel()]).astype(kind)
    parts = type(texts).from_buffers(3 * len(texts), pa.py_buffer(cuts), data or pa.py_buffer(b""))
    prefix, middle, suffix = (parts.take(pa.array(np.arange(k, len(parts), 3))) for k in range(3))
    joined = lambda *pieces: pc.binary_join_element_wise(*pieces, pa.scalar("", texts.type))
    mark = lambda s: pa.scalar(s, texts.type)
    psm = joined(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle)
    spm = joined(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle)
    return pc.if_else(pc.equal(form, "plain"), texts, pc.if_else(pc.equal(form, "spm"), spm, psm))


def _arranged_batches(batches: Iterator[pa.RecordBatch], unit: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, texts, form, first, second = batch.columns
        data, offsets = _buffers(texts)
        n, low, high, low_at, high_at = unit_cuts(data, offsets, unit, first.to_numpy(), second.to_numpy())
        output = _arranged(texts, form, low_at, high_at, offsets[1:])
        plain = pc.equal(form, "plain")
        none = pa.scalar(None, pa.int64())
        sizes = [pa.array(n), pc.if_else(plain, none, pa.array(low)), pc.if_else(plain, none, pa.array(high - low))]
        names = ["row", "form", "output", "n", "prefix_units", "middle_units"]
        yield pa.RecordBatch.from_arrays([row, form, output.cast(pa.string()), *sizes], names=names)


def draws(id_col: str, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers of a row, from the seed and its id; a null id is written as ``null``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(column(id_col).cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: str = "1", unit: str = "char", rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with form, output, n, prefix_units and middle_units instead of the text, which ``restore`` gives back.

    A text of n units (``char``: code points; ``word``: runs of other than blanks with
    what follows them; ``line``) is cut twice. Form ``psm`` writes <P>prefix<S>suffix<M>middle,
    ``spm`` <S>suffix<P>prefix<M>middle, ``plain`` the text itself: the form of
    empty texts, of those that hold one of the marks, and of all but ``rearranged`` of a
    hundred. Counts of units are null in plain rows. A null text is empty. All rows and
    other columns stay; the new ones take the place of columns of their names. Rows of one id
    share its draws, so equal rows get equal results; an empty table gives no rows.
    Memory is that of an Arrow batch, or of one text where that is longer. Map-only.
    """
    ready(docs.sparkSession)
    text = text_of(text_col)
    h1, h2, h3, h4 = draws(id_col, seed)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (h3 % 100 >= rearranged), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    others = docs.select(*(column(c) for c in docs.columns if c != text_col))
    rest = F.struct(F.lit(None).cast("int").alias("none"), *(column(c) for c in others.columns))
    rows = docs.select(rest.alias("row"), text.alias("text"), form.alias("form"), h1.alias("first"), h2.alias("second"))
    made = [StructField(c, LongType()) for c in ("n", "prefix_units", "middle_units")]
    schema = StructType([rows.schema["row"], StructField("form", StringType()), StructField("output", StringType()), *made])
    done = rows.mapInArrow(lambda it: _arranged_batches(it, unit), schema)
    return with_columns(done, others, {c: F.col(c) for c in ("form", "output", "n", "prefix_units", "middle_units")})


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. The marks' places are sure: a rearranged text holds none of its own, nor can one arise where parts meet."""
    middle = F.substring_index(output, MIDDLE, -1)
    head = F.substring(F.substring_index(output, MIDDLE, 1), len(PREFIX) + 1, 1 << 30)
    psm = F.concat(F.substring_index(head, SUFFIX, 1), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.substring_index(head, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

"""Profiles as sorted arrays, one row per document, and what a pair of them gives.

No gram is a row here. A letter n-gram is the number of its code points, 21 bits each, so
numbers are in the grams' order; words stay words in storage, and become numbers in their
order batch by batch, through a dictionary of the batch. A document's profile is its
distinct grams in order with their counts, made in one pass over the text, without a
shuffle. A pair's profiles are two sorted runs: they are merged once for each kind, and
the highest shares and the greatest differences are found by partial selection.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import text as T
from ..functions.helpers import ready
from .align import DROPPED, PAIR, TOP
from .documents import piece, with_spans

DELTA_WORDS, Z_LIMIT, Z_NOISE = 150, 2.0, 1e-12
#: Words below which texts aren't compressed with each other.
STREAM_LEAST = 200
_BITS = 21
#: Bytes of a batch that are worked on at once.
PART_BYTES = 2 << 20
#: What the kernel gives for a pair: distances, M13's mean distance before and after, sizes with the other text as dictionary.
RESULTS = ("m1", "m2", "m3", "m4", "m5", "m10", "m12", "m17", "before", "after", "c12", "c21")
GRAMS_ARROW = pa.list_(pa.struct([("gram", pa.string()), ("cnt", pa.int64()), ("total", pa.int64())]))
STATS = ("vocab", "once", "n", "squares", "h", "slope")


def packed_columns(kinds: tuple[str, ...], chunked: bool) -> list[str]:
    """Array columns of a packed document."""
    return [f"{k}_{part}" for k in kinds for part in ("gram", "cnt")] + (["z_gram", "z_cnt", "z_size"] if chunked else [])


def _numbered(*lists: pa.ListArray) -> tuple[list[np.ndarray], pa.Array]:
    """The strings of list columns as numbers in the strings' order, for each column one flat array; and the strings by number."""
    # a list array of no lists may come without offsets, so it isn't flattened
    flat = [a.flatten() if len(a) else pa.array([], pa.string()) for a in lists]
    coded = pa.concat_arrays(flat).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    codes = rank[coded.indices.to_numpy()] if len(order) else np.zeros(0, np.int64)
    return np.split(codes, np.cumsum([len(f) for f in flat])[:-1]), coded.dictionary.take(order)


def _offsets(lists: pa.ListArray) -> np.ndarray:
    if not len(lists):
        return np.zeros(1, np.int32)
    at = lists.offsets.to_numpy()
    return at - at[0]


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _slope(counts: np.ndarray) -> float:
    """Least-squares slope of log count on log rank, ranks 10 to 1000; 0 if there is none."""
    late = np.sort(counts)[::-1][9:1000]
    if len(late) < 2:
        return 0.0
    x, y = np.log(np.arange(10, 10 + len(late))), np.log(late)
    return float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())


def _pack_words(words: pa.ListArray) -> dict[str, pa.Array]:
    """Distinct words in order with their counts, and the sums that vocabulary statistics are made of."""
    (codes,), names = _numbered(words)
    at = _offsets(words)
    docs, sizes, many = len(words), np.diff(at), max(1, len(names))
    key, count = np.unique(np.repeat(np.arange(docs), sizes) * many + codes, return_counts=True)
    doc, gram = key // many, key % many
    ends = np.searchsorted(doc, np.arange(docs + 1))
    share = count / sizes[doc]
    total = lambda v: np.bincount(doc, weights=v, minlength=docs).astype(float)
    stats = {
        "vocab": np.diff(ends), "once": total(count == 1).astype(np.int64), "n": sizes.astype(np.int64), "squares": total(count.astype(float) ** 2).astype(np.int64), "h": total(-share * np.log(share)),
        "slope": np.array([_slope(count[a:b]) for a, b in zip(ends, ends[1:], strict=False)]),
    }
    return {"w_gram": _lists(ends, names.take(pa.array(gram))), "w_cnt": _lists(ends, pa.array(count, pa.int32()))} | {k: pa.array(v) for k, v in stats.items()}


def _pack_letters(texts: list[str], sizes: tuple[int, ...]) -> dict[str, pa.Array]:
    """Distinct n-grams of each text in order with their counts, for each n."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = np.cumsum([0, *map(len, texts)])
    out = {}
    for n in sizes:
        codes = points[: max(0, len(points) - n + 1)]
        for k in range(1, n):
            codes = (codes << _BITS) | points[k : k + len(codes)]
        found = [np.unique(codes[a : max(a, b - n + 1)], return_counts=True) for a, b in zip(ends, ends[1:], strict=False)]
        at = np.cumsum([0, *(len(g) for g, _ in found)])
        joined = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 2
        out |= {f"c{n}_gram": _lists(at, pa.array(joined[0], pa.int64())), f"c{n}_cnt": _lists(at, pa.array(joined[1], pa.int32()))}
    return out


def _pack_chunks(chunks: pa.ListArray) -> dict[str, pa.Array]:
    """Distinct words over all chunks of a text, in order, with their counts chunk by chunk; and the chunks' words."""
    inner = chunks.flatten()
    (codes,), names = _numbered(inner)
    outer, size = _offsets(chunks), np.diff(_offsets(inner))
    docs, ks, many = len(chunks), np.diff(outer).astype(np.int64), max(1, len(names))
    most = max(1, int(ks.max(initial=0)))
    doc = np.repeat(np.arange(docs), ks)
    nth = np.arange(len(size)) - np.repeat(outer[:-1], ks)
    # one sort by document, word and chunk
    key, count = np.unique((np.repeat(doc, size) * many + codes) * most + np.repeat(nth, size), return_counts=True)
    word, nth = key // most, key % most
    new = np.ones(len(word), bool)
    new[1:] = word[1:] != word[:-1]
    first_of = np.flatnonzero(new)
    doc, gram = word[first_of] // many, word[first_of] % many
    starts = np.concatenate([[0], np.cumsum(ks[doc])]).astype(np.int64)  # each word has an entry a chunk of its document
    held = np.zeros(starts[-1], np.int64)
    held[starts[np.cumsum(new) - 1] + nth] = count
    ends = np.searchsorted(doc, np.arange(docs + 1))
    return {"z_gram": _lists(ends, names.take(pa.array(gram))), "z_cnt": _lists(starts[ends], pa.array(held, pa.int32())), "z_size": _lists(outer, pa.array(size, pa.int32()))}


def _unless_same(grams: pa.ListArray, words: pa.ListArray) -> pa.ListArray:
    """The lists of chunks' words, empty where they are those of the whole text: so no text's words travel twice."""
    size = np.diff(_offsets(grams))
    same = np.array([n > 0 and g.values.equals(w.values) for n, g, w in zip(size, grams, words, strict=True)], bool)
    values = grams.flatten() if len(grams) else pa.array([], pa.string())
    return _lists(np.concatenate([[0], np.cumsum(np.where(same, 0, size))]), values.filter(pa.array(np.repeat(~same, size))))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut in halves down to PART_BYTES or one row: numbers and sorted copies take many times a part's size."""
    for batch in batches:
        if batch.num_rows > 1 and batch.nbytes > PART_BYTES:
            half = batch.num_rows // 2
            yield from _parts(iter((batch.slice(0, half), batch.slice(half))))
        elif batch.num_rows:
            yield batch


def _packed_batches(batches: Iterator[pa.RecordBatch], kinds: tuple[str, ...], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        at = {name: k for k, name in enumerate(batch.schema.names)}
        made = {"row": batch.column(at["row"])}
        if "words" in at:
            made |= _pack_words(batch.column(at["words"]))
        if "letters" in at:
            made |= _pack_letters(batch.column(at["letters"]).to_pylist(), tuple(int(k[1]) for k in kinds if k != "w"))
        if "chunks" in at:
            made |= _pack_chunks(batch.column(at["chunks"]))
            if "words" in at:
                made["z_gram"] = _unless_same(made["z_gram"], made["w_gram"])
        yield pa.RecordBatch.from_arrays([made[n] for n in names], names=names)


def packed(docs: DataFrame, kinds: tuple[str, ...], chunked: bool, keep: list[Column]) -> DataFrame:
    """``keep`` of documents (text, word_count), with array columns for ``kinds`` and, with ``chunked``, for the words of their chunks.

    With ``w`` among the kinds also vocab, once, n, squares, h and slope. Map-only.
    """
    ready(docs.sparkSession)
    text = F.col("text")
    inputs = {}
    if "w" in kinds:
        inputs["words"] = F.col("words") if "words" in docs.columns else T.tokenize(text)
    if any(k != "w" for k in kinds):
        inputs["letters"] = F.col("letters_lower") if "letters_lower" in docs.columns else T.letters_lower(text)
    if chunked:
        docs = with_spans(docs)
        inputs["chunks"] = F.transform("spans", lambda s: T.tokenize(piece(text, s)))
    rows = docs.select(F.struct(*keep).alias("row"), *(v.alias(k) for k, v in inputs.items()))
    array = lambda c: ArrayType({"w_gram": StringType(), "z_gram": StringType()}.get(c, LongType() if c.endswith("gram") else IntegerType()))
    fields = [rows.schema["row"], *(StructField(c, array(c)) for c in packed_columns(kinds, chunked))]
    if "w" in kinds:
        fields += [StructField(c, DoubleType() if c in ("h", "slope") else LongType()) for c in STATS]
    schema = StructType(fields)
    return rows.mapInArrow(lambda it: _packed_batches(it, kinds, schema.names), schema).select("row.*", *schema.names[1:])


def _gram_lists(at: np.ndarray, grams: pa.Array, counts: np.ndarray) -> pa.ListArray:
    total = np.concatenate([[0], np.cumsum(counts)])
    total = np.repeat(total[at[1:]] - total[at[:-1]], np.diff(at))
    return _lists(at, pa.StructArray.from_arrays([grams, pa.array(counts, pa.int64()), pa.array(total, pa.int64())], ["gram", "cnt", "total"]))


def _text_grams(texts: pa.ListArray, n: int) -> pa.ListArray:
    """Of each list of texts the distinct letter n-grams of its texts, with their counts and the sum of these."""
    outer, texts = _offsets(texts), (texts.flatten() if len(texts) else pa.array([], pa.string())).to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = np.cumsum([0, *map(len, texts)])
    codes = points[: max(0, len(points) - n + 1)]
    for k in range(1, n):
        codes = (codes << _BITS) | points[k : k + len(codes)]
    own = [codes[a : max(a, b - n + 1)] for a, b in zip(ends, ends[1:], strict=False)]  # no gram goes over a text's end
    found = [np.unique(np.concatenate([codes[:0], *own[a:b]]), return_counts=True) for a, b in zip(outer, outer[1:], strict=False)]
    at = np.cumsum([0, *(len(g) for g, _ in found)])
    grams, counts = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([f[0] for f in found], [f[1] for f in found]))
    return _gram_lists(at, _spelled(grams, n), counts)


def _spelled(grams: np.ndarray, n: int) -> pa.Array:
    """Numbers of letter n-grams as strings."""
    names, place = np.unique(grams, return_inverse=True)
    signs = np.stack([(names >> (_BITS * (n - 1 - k))) & ((1 << _BITS) - 1) for k in range(n)], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return pa.array([signs[i : i + n] for i in range(0, len(signs), n)], pa.string()).take(pa.array(place))


def _word_grams(words: pa.ListArray) -> pa.ListArray:
    """Of each list of words the distinct ones with their counts and the sum of these."""
    made = _pack_words(words)
    at = _offsets(made["w_gram"])
    return _gram_lists(at, made["w_gram"].flatten() if len(words) else pa.array([], pa.string()), made["w_cnt"].flatten().to_numpy() if len(words) else np.zeros(0, np.int64))


def grams(kind: str, given: Column) -> Column:
    """The array (gram, cnt, total) of a kind, from an array of words or of texts of letters."""
    n = 0 if kind == "w" else int(kind[1])

    def made(lists: pa.Array) -> pa.Array:
        parts = [p.column(0) for p in _parts(iter((pa.RecordBatch.from_arrays([lists], ["x"]),)))]
        done = [_text_grams(p, n) if n else _word_grams(p) for p in parts]
        return pa.concat_arrays(done) if done else pa.array([], GRAMS_ARROW)

    return F.arrow_udf(made, "array<struct<gram:string,cnt:bigint,total:bigint>>")(given)


def first(score: np.ndarray, k: int) -> np.ndarray:
    """A mask of the k highest; of equal ones those that stand first."""
    if len(score) <= k or k < 1:
        return np.full(len(score), k > 0)
    cut = np.partition(score, len(score) - k)[len(score) - k]
    mask = score > cut
    mask[np.flatnonzero(score == cut)[: k - int(mask.sum())]] = True
    return mask


def places(a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Size of the union of two sorted runs, and the places in it of either's members."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")  # merges the two runs
    ranked = both[order]
    new = np.ones(len(both), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.empty(len(both), np.int64)
    at[order] = np.cumsum(new) - 1
    return int(new.sum()), at[: len(a)], at[len(a) :]


def _dot(x: np.ndarray, y: np.ndarray) -> float:
    """Summed from the first gram on, as SQL does; ``@`` adds in another order, and then the last digit tells which of two equal distances is the smaller."""
    return float(np.add.accumulate(x * y)[-1]) if len(x) else 0.0


def cosine(x: np.ndarray, y: np.ndarray, both_zero: float = 0.0) -> float:
    aa, bb = _dot(x, x), _dot(y, y)
    if aa == 0 or bb == 0:
        return both_zero if aa == bb else 0.0
    return _dot(x, y) / (math.sqrt(aa) * math.sqrt(bb))


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence in bits; 0 if both are empty, a half if one is."""
    empty = [float(v.sum()) <= 0 for v in (p, q)]
    if any(empty):
        return 0.0 if all(empty) else 0.5
    mean = (p + q) / 2
    nats = []
    for v in (p, q):
        at = v.nonzero()[0]
        there = v[at]
        nats.append(float((there * np.log(there / mean[at])).sum()))
    return min(1.0, (0.5 * nats[0] + 0.5 * nats[1]) / math.log(2))


def _rescaled(shares: np.ndarray) -> np.ndarray:
    total = shares.sum()
    return shares / total if total > 0 else np.zeros(len(shares))


class _Aligned:
    """Both profiles of a pair over the union of their grams."""

    def __init__(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], kind: str):
        (grams_a, shares_a), (grams_b, shares_b) = a, b
        self.kind, self.shares = kind, [shares_a, shares_b]
        self.size, *self.at = places(grams_a, grams_b)
        self.x, self.y = (self.over(s, at) for s, at in zip(self.shares, self.at, strict=True))
        self.score = self.x / 2 + self.y / 2

    def over(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size, values.dtype)
        out[at] = values
        return out

    def top(self, *metrics: str) -> list[np.ndarray]:
        """Places of the grams that each metric takes, in order; a metric that takes more comes first, and the next ones choose among its grams."""
        out, at = [], np.arange(self.size)
        for metric in metrics:
            at = at[first(self.score[at], TOP[metric])]
            out.append(at)
        return out

    def own(self, side: int, k: int) -> np.ndarray:
        return self.over(first(self.shares[side], k), self.at[side])

    def without_most_different(self) -> tuple[np.ndarray, np.ndarray]:
        """Both sides without the grams of the greatest difference, rescaled."""
        sixth = max(1, (len(self.shares[0]) + len(self.shares[1])) // 6)
        left = ~first(np.abs(self.x - self.y), min(DROPPED[self.kind], sixth))
        return _rescaled(self.x[left]), _rescaled(self.y[left])


def _chunk_shares(counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's shares of a text's chunks, and their sum, from the smallest on, so that equal words have equal sums."""
    shares = counts.reshape(-1, max(1, len(words))) / np.maximum(words, 1) if len(words) else np.zeros((0, 0))
    total = np.zeros(len(shares))
    for column in np.sort(shares, axis=1).T:
        total = total + column
    return shares, total


def _delta(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], placed: tuple | None = None) -> float | None:
    """Cosine of the mean z-scores of two chunked texts (words, their shares and sums); null if one has no two chunks. ``placed``: what ``places`` gives, where it is known."""
    ks = [shares.shape[1] for _, shares, _ in (a, b)]
    if min(ks) < 2:
        return None
    n = sum(ks)
    size, *at = placed or places(a[0], b[0])
    sums = np.zeros((2, size))
    for total, (*_, own), place in zip(sums, (a, b), at, strict=True):
        total[place] = own
    mean = (sums[0] + sums[1]) / n
    top = first(mean, DELTA_WORDS)
    nth, mean = np.cumsum(top) - 1, mean[top]
    both = np.zeros((len(mean), n))
    for (_, shares, _), place, columns in zip((a, b), at, (slice(0, ks[0]), slice(ks[0], n)), strict=True):
        taken = top[place]
        both[nth[place[taken]], columns] = shares[taken]
    there = both > 0
    spread = (np.where(there, (both - mean[:, None]) ** 2, 0.0)).sum(axis=1) + (n - there.sum(axis=1)) * mean * mean
    sd = np.sqrt(spread / (n - 1))[:, None]
    z = np.where(sd > 0, np.clip((both - mean[:, None]) / np.where(sd > 0, sd, 1.0), -Z_LIMIT, Z_LIMIT), 0.0)
    centres = [z[:, : ks[0]].sum(axis=1) / ks[0], z[:, ks[0] :].sum(axis=1) / ks[1]]
    p, q = (np.where(np.abs(c) < Z_NOISE, 0.0, c) for c in centres)
    return 1 - cosine(p, q, both_zero=1.0)


class _Primed:
    """Compressors with a text as their dictionary; that of the last text is kept, and copied for each further partner."""

    def __init__(self) -> None:
        self.text, self.packer = None, None

    def size(self, data: bytes, dictionary: bytes) -> int:
        try:
            if self.packer is None or self.text != dictionary:
                self.text, self.packer = dictionary, zlib.compressobj(9, zdict=dictionary) if dictionary else zlib.compressobj(9)
            packer = self.packer.copy()
            return len(packer.compress(data)) + len(packer.flush())
        except (zlib.error, ValueError):
            return -1


def compare(a: dict[str, tuple], b: dict[str, tuple]) -> dict[str, float | None]:
    """The kernel's results for one pair, as far as its kinds of profiles are there."""
    out: dict[str, float | None] = {}
    kinds = {k: _Aligned(a[k], b[k], k) for k in ("w", "c1", "c2", "c3") if k in a}
    if "c3" in kinds:
        c = kinds["c3"]
        most, top = c.top("M17", "M1")
        out["m1"] = 1 - cosine(c.x[top], c.y[top])
        if len(c.shares[0]) and len(c.shares[1]):
            larger = float(np.maximum(c.x[most], c.y[most]).sum())
            out["m17"] = 1 - (float(np.minimum(c.x[most], c.y[most]).sum()) / larger if larger > 0 else 0.0)
    if "c2" in kinds:
        c = kinds["c2"]
        (top,) = c.top("M2")
        out["m2"] = 1 - cosine(c.x[top], c.y[top])
    if "c1" in kinds:
        out["m5"] = divergence(kinds["c1"].x, kinds["c1"].y)
    if "w" in kinds:
        w = kinds["w"]
        most, top, common = w.top("M4", "M3", "M10")
        x, y = w.x[top] * 1000.0, w.y[top] * 1000.0
        out["m3"] = float((np.abs(x - y) / (x + y + 0.5)).mean()) if len(x) else 0.0
        out["m4"] = divergence(_rescaled(w.x[most]), _rescaled(w.y[most]))
        k = TOP["M10"]
        mine, yours = w.own(0, k)[common], w.own(1, k)[common]
        union = int((mine | yours).sum())
        out["m10"] = 1 - int((mine & yours).sum()) / union if union else 0.0
    if "w" in kinds and "c3" in kinds:
        w, c = kinds["w"], kinds["c3"]
        out["before"] = 0.5 * (1 - cosine(c.x, c.y)) + 0.5 * divergence(w.x, w.y)
        out["after"] = 0.5 * (1 - cosine(*c.without_most_different())) + 0.5 * divergence(*w.without_most_different())
    if "z" in a:
        same = "w" in kinds and a["z"][0] is a["w"][0] and b["z"][0] is b["w"][0]
        out["m12"] = _delta(a["z"], b["z"], (kinds["w"].size, *kinds["w"].at) if same else None)
    return out


def _slices(lists: pa.ListArray, values: np.ndarray | None = None) -> list[np.ndarray]:
    return np.split(lists.flatten().to_numpy() if values is None else values, _offsets(lists)[1:-1])


def _shared(profile: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Grams with their shares, from grams with their counts."""
    grams, counts = profile
    return grams, counts / max(1, counts.sum())


def _profiles(sides: list[dict[str, pa.ListArray]], kinds: tuple[str, ...], chunked: bool) -> list[list[dict[str, tuple]]]:
    """The profiles of each row of each side (packed columns of a batch), by kind: grams and shares, made once for all pairs of a row; words are numbers in one order for all of them."""
    named = [k for k in (*kinds, "z") if k in ("w", "z") and f"{k}_gram" in sides[0]]
    codes = iter(_numbered(*(held[f"{k}_gram"] for k in named for held in sides))[0] if named else [])
    codes = {(k, n): next(codes) for k in named for n in range(len(sides))}
    out: list[list[dict[str, tuple]]] = [[] for _ in sides]
    for kind, parts in [(k, ("cnt",)) for k in kinds] + ([("z", ("cnt", "size"))] if chunked else []):
        for n, held in enumerate(sides):
            columns = [_slices(held[f"{kind}_gram"], codes.get((kind, n))), *(_slices(held[f"{kind}_{p}"]) for p in parts)]
            for i, row in enumerate(zip(*columns, strict=True)):
                if i == len(out[n]):
                    out[n].append({})
                if kind == "z":
                    same = len(row[1]) and not len(row[0])  # the words are those of the text
                    row = (out[n][i]["w"][0] if same else row[0], *_chunk_shares(*row[1:]))
                out[n][i][kind] = row if kind == "z" else _shared(row)
    return out


def _compared_batches(batches: Iterator[pa.RecordBatch], kinds: tuple[str, ...], chunked: bool, compression: bool) -> Iterator[pa.RecordBatch]:
    primed = _Primed(), _Primed()
    for batch in _parts(batches):
        sides = [{c: batch.column(batch.schema.get_field_index(f"{side}_{c}")) for c in packed_columns(kinds, chunked)} for side in "ab"]
        results = [compare(a, b) for a, b in zip(*_profiles(sides, kinds, chunked), strict=True)] if kinds or chunked else [{} for _ in range(batch.num_rows)]
        if compression:
            texts = [batch.column(batch.schema.get_field_index(f"{side}_stream")).to_pylist() for side in "ab"]
            for result, s1, s2 in zip(results, *texts, strict=True):
                if s1 is not None and s2 is not None:
                    x, y = s1.encode(), s2.encode()
                    result["c12"], result["c21"] = primed[1].size(x, y), primed[0].size(y, x)
        made = [pa.array([r.get(c) for r in results], pa.float64()) for c in RESULTS]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["pair", "flat", *RESULTS])


def _met_batches(batches: Iterator[pa.RecordBatch], kinds: tuple[str, ...], chunked: bool, compression: bool, window: int, own: int) -> Iterator[pa.RecordBatch]:
    held, primed = None, []
    for part in _parts(batches):
        first = held.num_rows if held else 0
        rows = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0] if first else part
        column = {name: rows.column(k) for k, name in enumerate(rows.schema.names)}
        nth = column["nth"].to_pylist()
        if any(y not in (0, x + 1) for x, y in zip(nth, nth[1:], strict=False)):
            raise ValueError("rows of a group don't lie in order")
        found = [(j - k, j) for j in range(first, len(nth)) for k in range(min(window, nth[j]), 0, -1) if nth[j - k] < own]
        docs = _profiles([column], kinds, chunked)[0]
        results = [compare(docs[i], docs[j]) if docs else {} for i, j in found]
        if compression:
            texts = [None if t is None else t.encode() for t in column["stream"].to_pylist()]
            primed += [_Primed() for _ in range(len(nth) - len(primed))]
            for result, (i, j) in zip(results, found, strict=True):
                if texts[i] is not None and texts[j] is not None:
                    result["c12"], result["c21"] = primed[j].size(texts[i], texts[j]), primed[i].size(texts[j], texts[i])
                if j > window:
                    primed[j - window - 1] = None  # meets no one any more
        made = [pa.array([r.get(c) for r in results], pa.float64()) for c in RESULTS]
        sides = [column["row"].take(pa.array([pair[n] for pair in found], pa.int64())) for n in (0, 1)]
        yield pa.RecordBatch.from_arrays([*sides, *made], names=["a", "b", *RESULTS])
        held, primed = rows.slice(max(0, len(nth) - window)), primed[-window:]


def met(rows: DataFrame, kinds: tuple[str, ...], chunked: bool, compression: bool, window: int, own: int) -> DataFrame:
    """Packed documents that lie in groups and in order, each compared with the next ``window`` of its group: as ``compared``.

    ``nth`` is a row's place in its group, from 0; those from ``own`` on are there only to be met.
    A task holds a part of a batch and the last ``window`` rows before it, so nothing is
    shuffled, stored or copied for a pair.
    """
    ready(rows.sparkSession)
    arrays = packed_columns(kinds, chunked)
    flat = F.struct(*(c for c in rows.columns if c not in (*arrays, "stream", "nth")))
    streams = [F.when(F.col("word_count") >= STREAM_LEAST, F.col("stream")).alias("stream")] if compression else []
    given = rows.select("nth", flat.alias("row"), *arrays, *streams)
    kind = given.schema["row"].dataType
    schema = StructType([StructField("a", kind), StructField("b", kind), *(StructField(c, DoubleType()) for c in RESULTS)])
    done = given.mapInArrow(lambda it: _met_batches(it, kinds, chunked, compression, window, own), schema)
    return done.select(F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"), "*")


def compared(rows: DataFrame, kinds: tuple[str, ...], chunked: bool, compression: bool) -> DataFrame:
    """Rows (doc_a, doc_b, a, b) with packed documents as the structs a and b: the pair, the flat part of both, and RESULTS."""
    ready(rows.sparkSession)
    arrays = packed_columns(kinds, chunked)
    flat = [c for c in rows.select("a.*").columns if c not in (*arrays, "stream")]
    side = lambda s: F.struct(*(F.col(f"{s}.{c}").alias(c) for c in flat))
    enough = F.least("a.word_count", "b.word_count") >= STREAM_LEAST
    streams = [F.when(enough, F.col(f"{s}.stream")).alias(f"{s}_stream") for s in "ab"] if compression else []
    given = rows.select(
        F.struct(*PAIR).alias("pair"), F.struct(side("a").alias("a"), side("b").alias("b")).alias("flat"),
        *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in arrays), *streams,
    )
    schema = StructType([given.schema["pair"], given.schema["flat"], *(StructField(c, DoubleType()) for c in RESULTS)])
    done = given.mapInArrow(lambda it: _compared_batches(it, kinds, chunked, compression), schema)
    return done.select("pair.*", "flat.*", *RESULTS)


#: Columns that ``aligned`` can give for a gram: shares, ranks in either profile, in both, by difference, and the kept shares rescaled.
ALIGNED = {"r1": "double", "r2": "double", "own1": "int", "own2": "int", "rk": "int", "rkd": "int", "t1": "double", "t2": "double"}


def _ranks(score: np.ndarray) -> np.ndarray:
    """Ranks from the highest, from 1; equal ones as they stand."""
    out = np.empty(len(score), np.int32)
    out[np.argsort(-score, kind="stable")] = np.arange(1, len(score) + 1, dtype=np.int32)
    return out


def _aligned_grams(w: _Aligned, columns: tuple[str, ...], kept: tuple[str, int, int | None] | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the kept grams in the union, and their columns; a rank of 0 is none."""
    ranked = {"rk": lambda: _ranks(w.score), "rkd": lambda: _ranks(np.abs(w.x - w.y))}
    made: dict[str, np.ndarray] = {}
    chosen = np.arange(w.size)
    if kept:
        name, low, high = kept
        made[name] = ranked[name]()
        chosen = np.flatnonzero((made[name] >= low) & (made[name] <= (high or w.size)))
    for c in columns:
        if c in ranked and c not in made:
            made[c] = ranked[c]()
        elif c in ("own1", "own2"):
            side = int(c[-1]) - 1
            made[c] = w.over(_ranks(w.shares[side]), w.at[side])
        elif c in ("r1", "r2", "t1", "t2"):
            made[c] = w.x if c[-1] == "1" else w.y
    return chosen, [_rescaled(made[c][chosen]) if c in ("t1", "t2") else made[c][chosen] for c in columns]


def _aligned_batches(batches: Iterator[pa.RecordBatch], kind: str, columns: tuple[str, ...], kept: tuple[str, int, int | None] | None) -> Iterator[pa.RecordBatch]:
    types = {"double": pa.float64(), "int": pa.int32()}
    for batch in _parts(batches):
        lists = {c: batch.column(batch.schema.get_field_index(c)) for side in "ab" for c in (f"{side}_gram", f"{side}_cnt")}
        named = [lists["a_gram"], lists["b_gram"]]
        codes, names = _numbered(*named) if kind == "w" else ((None, None), None)
        sides = [list(zip(_slices(grams, v), _slices(lists[f"{s}_cnt"]), strict=True)) for s, grams, v in zip("ab", named, codes, strict=True)]
        grams, sizes, made = [np.zeros(0, np.int64)], [], [[np.zeros(0, types[ALIGNED[c]].to_pandas_dtype())] for c in columns]
        for a, b in zip(*sides, strict=True):
            w = _Aligned(_shared(a), _shared(b), kind)
            union = np.empty(w.size, np.int64)
            for (own, _), at in zip((a, b), w.at, strict=True):
                union[at] = own
            chosen, values = _aligned_grams(w, columns, kept)
            grams.append(union[chosen]), sizes.append(len(chosen))
            for held, v in zip(made, values, strict=True):
                held.append(v)
        grams = np.concatenate(grams)
        rows = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        pair = [batch.column(batch.schema.get_field_index(c)).take(rows) for c in PAIR]
        arrays = [pa.array(v, types[ALIGNED[c]], mask=v == 0 if c in ("own1", "own2") else None) for c, v in zip(columns, map(np.concatenate, made), strict=True)]
        text = names.take(pa.array(grams)) if kind == "w" else _spelled(grams, int(kind[1]))
        yield pa.RecordBatch.from_arrays([*pair, text, *arrays], names=[*PAIR, "gram", *columns])


def aligned(rows: DataFrame, kind: str, columns: tuple[str, ...], kept: tuple[str, int, int | None] | None = None) -> DataFrame:
    """(doc_a, doc_b, gram, ``columns`` of ALIGNED): a row per gram of the pairs' profiles. With ``kept`` (rk or rkd, from, to) those of these ranks alone."""
    ready(rows.sparkSession)
    given = rows.select(*PAIR, *(F.col(f"{s}.{kind}_{c}").alias(f"{s}_{c}") for s in "ab" for c in ("gram", "cnt")))
    schema = StructType([given.schema[c] for c in PAIR] + [StructField("gram", StringType()), *(StructField(c, DoubleType() if ALIGNED[c] == "double" else IntegerType()) for c in columns)])
    return given.mapInArrow(lambda it: _aligned_batches(it, kind, columns, kept), schema)

"""N-gram Jaccard self-join by chosen paths.

A run splits sets step by step on sampled shared tokens. At each step a set goes on
by two tokens, those that are least under two hash functions of the step, so a path
branches, and two sets of similarity J share a token of a step with a probability of
1 - (1 - J)^2. Sets that share a token form a bucket; a bucket that is too large is
split on the next step's tokens, and so on. A bucket that a step doesn't split - one
of its parts holds more than half of it, as among many near copies - is left whole.
Small buckets are compared by brute force. Runs with other hash functions are added
until a pair at the threshold that is split on every step of every run is missed
with at most the stated chance.

Texts of equal shingle sets are one unit. Every unit pair is judged in the first
bucket in which it meets, so links are counted, not listed, and a group of copies
costs no row per pair. A large bucket that stays whole is compared in tiles of
bounded size: it is slower, but nothing is capped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, join_hot, materialize, ready, text_of
from .components import components
from .words import WordMemory

#: Buckets of more units are split on the next step's tokens, as long as there is one.
BUCKET = 512
#: Steps of a path.
DEPTH = 4
#: Tokens by which a set goes on at each step.
BRANCH = 2

_WORD = re.compile(r"[^\W_]+")
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


@lru_cache(maxsize=1)
def _word_hashes() -> WordMemory:
    return WordMemory(lambda words: [xxhash.xxh3_64_intdigest(w) for w in words], limit=500_000)


def _split(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``n`` words; a shorter text is one run of all its words."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, _U(n))
    for k in range(n):
        out = _mix(out) + words[k : len(words) - n + 1 + k]
    return np.unique(_mix(out))


def _shingled(texts: list[str], n: int) -> Iterator[np.ndarray]:
    for values in _word_hashes().texts(texts, _split):
        yield shingles(np.array(values, np.uint64), n)


def identity(x: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set of hashes from others."""
    return tuple(int(_mix(x + _U(k)).sum(dtype=np.uint64).astype(np.int64)) for k in (1, 2))


def _signature_batches(batches: Iterator[pa.RecordBatch], n: int, runs: int) -> Iterator[pa.RecordBatch]:
    """Sets, the sampled tokens of all runs, steps and branches, and a byte of each as a sketch."""
    factors = _mix(np.arange(1, runs * DEPTH * BRANCH + 1, dtype=np.uint64)) | _U(1)
    for batch in batches:
        one, two, sizes, tokens, sketches = [], [], [], [], []
        for x in _shingled(batch.column(1).to_pylist(), n):
            sizes.append(len(x))
            for out, value in zip((one, two), identity(x), strict=True):
                out.append(value)
            if not len(x):
                tokens.append(None), sketches.append(None)
                continue
            # the least hashed token of each branch; x is mixed already, so an odd factor makes another hash
            least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
            for k in range(0, len(x), 2048):
                least = np.minimum(least, (factors[:, None] * x[None, k : k + 2048]).min(axis=1))
            least = _mix(least)
            tokens.append(least.astype(np.int64).tolist())
            sketches.append(least.astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
            names=["doc", "h1", "h2", "n", "tokens", "sketch"],
        )


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of batches that come sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        new[0] = last is not None and first != last
        last = tuple(c[-1] for c in columns)
        cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if cut < batch.num_rows or (cut == 0):
                if held:
                    yield pa.Table.from_batches(held)
                held = []
            at = cut
    if held:
        yield pa.Table.from_batches(held)


def _pending(t: pa.Table, threshold: float) -> np.ndarray:
    """Pairs of a tile that are judged here: of like size, in no common bucket that comes before this one."""
    size = t["n"].to_numpy().astype(np.float64)
    ok = np.minimum(size[:, None], size) >= threshold * np.maximum(size[:, None], size) - 1e-9
    if t["i"][0].as_py() != t["j"][0].as_py():
        block = t["block"].to_numpy()
        ok &= block[:, None] < block[None, :]
    else:
        ok &= np.tri(len(size), k=-1, dtype=bool).T
    before = t["before"].combine_chunks()
    keys, owner = before.flatten().to_numpy(), np.repeat(np.arange(len(size)), before.value_lengths().to_numpy())
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a > 1:
            ok[np.ix_(owner[a:b], owner[a:b])] = False
    return ok


def _sift_batches(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Units that have a likely partner in their tile, judged by sketches of least hashes."""
    for t in _groups(batches, ["key", "i", "j"]):
        if t.num_rows < 2:
            continue
        ok = _pending(t, threshold)
        if not ok.any():
            continue
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        m = sketch.shape[1]
        # seven standard deviations below what the threshold makes likely
        need = math.floor(m * threshold - 7 * math.sqrt(m * threshold * (1 - threshold)))
        same = np.zeros(ok.shape, np.int16)
        for k in range(m):
            own = sketch[:, k]
            same += own[:, None] == own
        ok &= same >= need
        some = np.flatnonzero(ok.any(axis=0) | ok.any(axis=1))
        if len(some):
            yield t.select(["key", "i", "j", "block", "unit", "n", "copies", "before"]).take(pa.array(some)).combine_chunks().to_batches()[0]


def _links(sets: list[np.ndarray], pending: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pending pairs of at least that similarity."""
    size = np.array([len(s) for s in sets])
    a, b = np.nonzero(pending)
    if len(a) <= 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
    else:
        n = len(sets)
        token, place = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(n), size)
        times = np.bincount(place, minlength=len(token))
        shared = np.zeros((n, n), np.float32)
        often = np.flatnonzero(times >= 8)
        column = np.full(len(token), -1)
        column[often] = np.arange(len(often))
        for k in range(0, len(often), 4096):
            here = (column[place] >= k) & (column[place] < k + 4096)
            held = np.zeros((n, min(4096, len(often) - k)), np.float32)
            held[owner[here], column[place[here]] - k] = 1
            shared += held @ held.T
        rare = (times[place] < 8) & (times[place] > 1)
        at = np.argsort(place[rare], kind="stable")
        place, owner = place[rare][at], owner[rare][at]
        for step in range(1, 8):  # the owners of one token lie together
            same = place[step:] == place[:-step]
            x, y = owner[:-step][same], owner[step:][same]
            np.add.at(shared, (x, y), 1)
            np.add.at(shared, (y, x), 1)
        common = shared[a, b].astype(np.int64)
    linked = common >= threshold * (size[a] + size[b] - common) - 1e-9
    return a[linked], b[linked]


def _judge_batches(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Per unit of a tile: documents it is linked to there, and the least unit it reaches there."""
    for t in _groups(batches, ["key", "i", "j"]):
        if t.num_rows < 2:
            continue
        sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
        a, b = _links(sets, _pending(t, threshold), threshold)
        if not len(a):
            continue
        unit, copies = t["unit"].to_numpy(), t["copies"].to_numpy()
        links = np.zeros(len(unit), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root = unit.copy()
        while True:
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            if (low == root).all():
                break
            root = low
        some = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(unit[some]), pa.array(links[some]), pa.array(root[some])], names=["unit", "links", "root"])


def _shingle_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(unit, shingles) of the rows (unit, h1, h2, text) whose text is the unit's."""
    for batch in batches:
        units, held = [], []
        for unit, h1, h2, x in zip(*(batch.column(k).to_pylist() for k in range(3)), _shingled(batch.column(3).to_pylist(), n), strict=True):
            if identity(x) == (h1, h2):
                units.append(unit), held.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(held, pa.binary())], names=["unit", "shingles"])


def runs_for(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has shared a token at every step of one with probability ``recall``."""
    met = (1 - (1 - threshold) ** BRANCH) ** DEPTH
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met))) if met < 1 else 1


def _sized(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of buckets that hold at least two units, with the bucket's size; and the sizes."""
    sizes = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    return join_hot(rows, sizes.withColumn("k", F.col("size")), ["key"], "k", total), sizes


def _buckets(units: DataFrame, runs: int) -> DataFrame:
    """(unit, run, key, size): the buckets in which each unit is compared, of all runs."""
    token = lambda step, b: F.element_at("tokens", (F.col("run") * DEPTH + step) * BRANCH + b + 1)
    each = units.select("unit", "tokens", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    rows = each.select("unit", "run", F.explode(F.array(*(F.xxhash64(F.col("run"), token(0, b)) for b in range(BRANCH)))).alias("key"))
    now = materialize(_sized(rows)[0].select("unit", "run", "key", "size"), "buckets")
    chosen = now.where(F.col("size") <= BUCKET)
    for step in range(1, DEPTH):
        full = now.where(F.col("size") > BUCKET)
        if full.isEmpty():
            return chosen
        parts = F.explode(F.array(*(F.xxhash64(F.col("key"), token(step, b)) for b in range(BRANCH))))
        below = full.groupBy("unit").agg(F.collect_list(F.struct("run", "key", "size")).alias("all")).join(units.select("unit", "tokens"), "unit")
        below = below.select("unit", "tokens", F.inline("all"))
        below = below.select("unit", "run", F.col("key").alias("whole"), F.col("size").alias("held"), parts.alias("key"))
        below, _ = _sized(below)
        below = materialize(below, "parts")
        largest = below.groupBy("whole", "held").agg(F.max("size").alias("most"))
        left_whole = materialize(largest.where("2 * most > held").select(F.col("whole").alias("key"), F.col("held").alias("k")), "whole")
        total = full.count()
        chosen = chosen.unionByName(join_hot(full, left_whole, ["key"], "k", total))
        mark = left_whole.select(F.col("key").alias("whole"), (F.col("k") * BRANCH).alias("k"), F.lit(True).alias("stays"))
        now = join_hot(below, mark, ["whole"], "k", total * BRANCH, "left").where("stays IS NULL").select("unit", "run", "key", "size")
        now = materialize(now, "buckets")
        chosen = chosen.unionByName(now.where(F.col("size") <= BUCKET))
    return chosen.unionByName(now.where(F.col("size") > BUCKET))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.999999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, class_id, n_links.

    Two texts are linked if their sets of ``words``-word shingles (lower-cased
    letters and digits; a shorter text is one shingle) have a Jaccard similarity of
    at least ``threshold``. class_id is the least id of the connected group,
    n_links the number of other rows that a row is linked to, copies included.
    Texts without words (null and empty ones too) are linked to none and are their
    own class. Ids are whole numbers; repeated rows of one id are copies of each
    other if their texts are; a row with a null id is linked to none. Other columns
    aren't read. An empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    runs = runs_for(threshold, recall)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text"))
    signed = rows.mapInArrow(lambda it: _signature_batches(it, words, runs), "doc long, h1 long, h2 long, n int, tokens array<long>, sketch binary")
    signed = materialize(signed, "signatures")
    units = signed.where("n > 0 AND doc IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("tokens").alias("tokens"), F.any_value("sketch").alias("sketch"))
    units = materialize(units.withColumn("unit", F.monotonically_increasing_id()), "units")  # numbered once: they are read back

    chosen = materialize(_buckets(units, runs).select("unit", "run", "key", "size"), "chosen")
    grouped = chosen.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("run", "key", "size"))).alias("all"))  # runs x branches at most
    wide = grouped.withColumn("keys", F.col("all.key")).join(units.select("unit", "n", "copies", "sketch"), "unit")
    member = wide.select("unit", "n", "copies", "sketch", "keys", F.posexplode("all").alias("at", "b"))
    tiles = F.ceil(F.col("b.size") / BUCKET).cast("int")
    member = member.select("unit", "n", "copies", "sketch", F.slice("keys", F.lit(1), F.col("at")).alias("before"), F.col("b.key").alias("key"), tiles.alias("tiles"))
    member = member.withColumn("block", F.pmod(F.xxhash64("unit"), F.col("tiles")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    member = member.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "tiles")
    order = ["key", "i", "j"]
    kinds = "key long, i int, j int, block int, unit long, n int, copies long, before array<long>"
    likely = member.select("key", "i", "j", "block", "unit", "n", "copies", "before", "sketch").repartition(*order).sortWithinPartitions(*order)
    likely = materialize(likely.mapInArrow(lambda it: _sift_batches(it, threshold), kinds), "likely")

    # the texts of likely units only are shingled again, and judged exactly
    wanted = materialize(units.join(likely.select("unit").distinct(), "unit", "left_semi").select(F.col("first").alias("doc"), "unit", "h1", "h2"), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    again = rows.join(wanted, "doc").select("unit", "h1", "h2", "text").mapInArrow(lambda it: _shingle_batches(it, words), "unit long, shingles binary")
    sets = again.groupBy("unit").agg(F.any_value("shingles").alias("shingles"))  # repeated rows
    judged = likely.join(sets, "unit").select("key", "i", "j", "block", "unit", "n", "copies", "before", "shingles")
    judged = judged.repartition(*order).sortWithinPartitions(*order)
    judged = materialize(judged.mapInArrow(lambda it: _judge_batches(it, threshold), "unit long, links long, root long"), "links")
    links = judged.groupBy("unit").agg(F.sum("links").alias("links"))
    roots = components(judged.select(F.col("unit").alias("a"), F.col("root").alias("b")))
    firsts = units.select("unit", "first").join(roots.withColumnRenamed("node", "unit"), "unit")
    classes = firsts.groupBy("root").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("k"))
    firsts = join_hot(firsts.select("unit", "root"), materialize(classes, "classes"), ["root"], "k", firsts.count())
    found = units.join(links, "unit", "left").join(firsts, "unit", "left")
    found = found.select("h1", "h2", "n", F.coalesce("class_id", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("k"))
    own = signed.select("doc", "h1", "h2", F.when(F.col("doc").isNotNull(), F.col("n")).alias("n"))
    out = join_hot(own, materialize(found, "found"), ["h1", "h2", "n"], "k", own.count(), "left")
    return out.select(F.col("doc").alias(id_col), F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))

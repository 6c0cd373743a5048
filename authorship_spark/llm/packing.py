"""Best-fit packing of tokenised documents into sequences of fixed length.

Pieces of one length are alike, so the plan needs only how many there are of each
length: at most ``max_tokens`` numbers, whatever the size of the corpus. Large
pieces (over a third of a sequence) are matched first, at most two to a sequence:
the largest with the largest that still fits. Smaller pieces, from long to short,
go where they leave the smallest gap. Spark counts the lengths, ranks the pieces
of each length (in salted groups of bounded size), and a join with the plan gives
each piece its sequence and offset.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ready, text_of, whole_row, with_columns

#: Pieces of one length that are ranked together in one window.
RANK_GROUP = 4096
#: A plan of more rows is joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 200_000
#: Splits text before the merges, in vocabularies whose pre-tokeniser is byte-level.
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Text to a uint32 array of ids, as the tokenizers library gives them for this file.

    A plain byte-level BPE whose merges stand in the order of their ids is run by
    a faster library, which then gives the same ids; any other file by its own, and so are
    texts with more blanks in a row than the faster one's pattern can take.
    """
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    spec = json.loads(own.to_str())
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not spec["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
    plain = plain and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("dropout")
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    plain = plain and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
    if plain:
        # the 256 bytes as printable characters: those that print stand for themselves
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        plain = made == sorted(made)
    if plain:
        fast = tiktoken.Encoding("own", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=added)

    def by_own(text: str) -> np.ndarray:
        return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)

    def by_fast(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern steps back through blanks, and gives up on about a million in a row
            return by_own(text)

    return by_fast if plain else by_own


def _piece_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = _encoder(path)
    end = np.array([end_id], np.uint32)
    for batch in batches:
        row, piece, start, length, crc, kept = [], [], [], [], [], []
        for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            ids = np.concatenate([encode(text).astype("<u4", copy=False), end])
            cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                row.append(i), piece.append(k), start.append(a), length.append(b - a)
                crc.append(zlib.crc32(ids[a:b].tobytes()))
                if keep_ids:
                    kept.append(ids[a:b].astype(np.int32))
        out = [*batch.select(list(range(batch.num_columns - 1))).take(pa.array(row, pa.int64())).columns]
        out += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = [*batch.schema.names[:-1], "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            out.append(pa.array(kept, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(out, names=names)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, max_tokens: int = 1024, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every document's ids (and ``end_id`` after them) into pieces of ``max_tokens``.

    Only longer documents are cut; then the first piece takes the rest and all
    others are full. Columns: ``id_col``, piece (from 0), start, length, ids_crc32
    (of the little-endian 32-bit ids), and ids with ``keep_ids``. A null or empty
    text is one piece that holds ``end_id`` alone. Map-only.
    """
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    return rows.mapInArrow(lambda it: _piece_batches(it, tokenizer, end_id, max_tokens, keep_ids), schema)


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go, from how many there are of it.

    A row (length, first, n, sequence, per, offset): the n pieces from rank
    ``first`` on fill sequences from ``sequence`` on, ``per`` in each, one after
    the other from ``offset`` on.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    order: list[int] = []  # the gaps that are there, ascending
    sequences = 0

    def put(length: int, n: int, sequence: int, per: int, offset: int) -> None:
        out.append((length, used[length], n, sequence, per, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((sequence, n))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        while left[length]:
            mate = next((m for m in large if m <= capacity - length and left[m] > (m == length)), None)
            n = left[length] if mate is None else left[length] // 2 if mate == length else min(left[length], left[mate])
            put(length, n, sequences, 1, 0)
            if mate is not None:
                put(mate, n, sequences, 1, length)
            leave(capacity - length - (mate or 0), sequences, n)
            sequences += n
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            k = bisect.bisect_left(order, length)
            if k == len(order):
                gap, first, n = capacity, sequences, -(-left[length] // (capacity // length))
                sequences += n
            else:
                gap = order[k]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[k]
            per = gap // length
            full = min(n, left[length] // per)
            if full:
                put(length, full * per, first, per, capacity - gap)
                leave(gap - per * length, first, full)
            if left[length] and full < n:
                rest = left[length]
                put(length, rest, first + full, rest, capacity - gap)
                leave(gap - rest * length, first + full, 1)
                full += 1
            leave(gap, first + full, n - full)
    return out


def _ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds rank: 0, 1, 2... among the pieces (row, k, length) of a length, without a task for a whole length."""
    groups = [-(-counts.get(n, 0) // RANK_GROUP) or 1 for n in range(max(counts, default=0) + 1)]
    salt = F.pmod(F.xxhash64("k"), F.element_at(F.lit(groups), (F.col("length") + 1).cast("int")))
    salted = pieces.withColumn("salt", salt)
    base = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("k")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1)
    return ranked.join(base, ["length", "salt"]).select("row", "length", (F.col("base") + F.col("own")).alias("rank"))


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` column.

    The sequences are gapless from offset 0. Every row is placed, repeated rows
    each for itself; an empty table stays empty. The pieces are numbered and stored
    once in the shared folder. Other columns pass through, whatever their names and
    kinds; the new ones take the place of those of their names.
    """
    spark = pieces.sparkSession
    rows = materialize(pieces.select(whole_row(pieces).alias("row"), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("k")), "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # capacity rows at most
    if len(counts) > capacity:
        raise ValueError("more lengths than a sequence has places")
    places = plan_sequences(counts, capacity)
    plan = spark.createDataFrame(places, "length long, first long, count long, sequence long, per long, place long")
    if len(places) <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    ranked = _ranked(rows, counts)
    at = ranked["rank"] - plan["first"]
    placed = ranked.join(plan, (ranked["length"] == plan["length"]) & (at >= 0) & (at < plan["count"]))
    sequence = (plan["sequence"] + F.floor(at / plan["per"])).cast("long")
    return with_columns(placed, pieces, {"sequence_id": sequence, "offset": (plan["place"] + F.pmod(at, plan["per"]) * ranked["length"]).cast("long")})


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, max_tokens: int = 1024, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise ``docs``, cut them into pieces and pack these; see token_pieces and pack.

    The pieces are stored once in the shared folder, so a lost executor costs a
    read and not the encoding of its texts.
    """
    return pack(token_pieces(docs, tokenizer, end_id, max_tokens, keep_ids, id_col, text_col), max_tokens)

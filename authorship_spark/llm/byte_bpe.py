"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each leaf of the tree stands for a live symbol and holds the rank of the pair it
starts, together with its place, so the root is the leftmost pair of the lowest
rank. A merge takes the right symbol out, and sets the leaves of the merged
symbol and of its live left neighbour anew: three point updates of logarithmic
length. The trees of all new words of like size are rows of one numpy matrix, so
a round merges one pair in each of them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, text_of
from .words import WordMemory

_NONE = np.int64(1) << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line has a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.n = ranks, max(ranks.values()) + 1
        self.token = {rank: token for token, rank in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, whole = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), whole.append(rank)
        key = np.array(left, np.int64) * self.n + np.array(right, np.int64)
        at = np.argsort(key, kind="stable")
        self.key, self.whole = key[at], np.array(whole, np.int64)[at]

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, _NONE where they make no token; negative symbols are none."""
        key = np.where((a >= 0) & (b >= 0), a * self.n + b, -1)
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, self.whole[at], _NONE)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        out: list = [None] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if (rank := self.ranks.get(word)) is not None:
                out[i] = [rank]
            elif not word:
                out[i] = []
            else:
                by_size.setdefault(1 << (len(word) - 1).bit_length(), []).append(i)
        for size, members in by_size.items():
            step = max(1, 1_000_000 // size)
            for k in range(0, len(members), step):
                chunk = members[k : k + step]
                for i, ids in zip(chunk, self._merge([words[i] for i in chunk], size), strict=True):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], size: int) -> list[list[int]]:
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        cells = np.arange(size)[None, :] < lengths[:, None]
        sym = np.full((n, size + 1), -1, np.int64)  # the last column stands for no neighbour
        sym[:, :size][cells] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        after = np.where(np.arange(size)[None, :] + 1 < lengths[:, None], np.arange(1, size + 1)[None, :], size)
        after = np.concatenate([after, np.full((n, 1), size)], axis=1)
        before = np.broadcast_to(np.r_[size, np.arange(size - 1), size], (n, size + 1)).copy()
        tree = np.full((n, 2 * size), _NONE, np.int64)
        first = np.full((n, size), _NONE, np.int64)
        both = cells[:, 1:]
        first[:, :-1][both] = self.pair(sym[:, : size - 1][both], sym[:, 1:size][both])
        tree[:, size:] = np.where(first < _NONE, first * size + np.arange(size)[None, :], _NONE)
        level = size
        while level > 1:  # build
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            top = tree[live, 1]
            at, rank = top % size, top // size
            right = after[live, at]
            beyond, ahead = after[live, right], before[live, at]
            sym[live, at] = rank
            sym[live, right] = -1
            after[live, at] = beyond
            before[live, beyond] = at
            starts = self.pair(rank, sym[live, beyond])
            ends = self.pair(sym[live, ahead], rank)
            self._set(tree, size, live, right, np.full(len(live), _NONE))
            self._set(tree, size, live, at, np.where(starts < _NONE, starts * size + at, _NONE))
            some = ahead < size
            self._set(tree, size, live[some], ahead[some], np.where(ends < _NONE, ends * size + ahead, _NONE)[some])
            live = live[tree[live, 1] < _NONE]
        alive = sym[:, :size] >= 0
        ids, cuts = sym[:, :size][alive].tolist(), np.r_[0, np.cumsum(alive.sum(axis=1))].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    @staticmethod
    def _set(tree: np.ndarray, size: int, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        """Point update: a leaf of each of ``rows``, then its way to the root."""
        node = leaf + size
        tree[rows, node] = value
        while size > 1:
            node, size = node >> 1, size >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def decode(self, ids: list[int]) -> bytes:
        """Raises KeyError for an id that the vocabulary lacks."""
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    bpe, split = ByteBpe(load_ranks(path)), regex.compile(pattern)
    memory = WordMemory(lambda words: bpe.encode_words([w.encode() for w in words]), limit=400_000)
    return bpe, split.findall, memory


def _lists(lists: list[np.ndarray]) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    _, split, memory = _encoder(path, pattern)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        ids = [np.array([i for word in words for i in word], np.int32) for words in memory.texts(texts, split)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(ids)], names=[*batch.schema.names[:-1], "ids"])


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    token = _encoder(path, r"(?s).+")[0].token
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        parts, out, at = list(map(token.__getitem__, flat.tolist())), [], 0
        for n in ends.tolist():
            out.append(b"".join(parts[at : at + n]))
            at += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every whole text, without special tokens.

    A null text counts as empty and has no ids. One row per input row, repeated
    rows included; other columns are not read. Map-only.
    """
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    return rows.mapInArrow(lambda it: _encode_batches(it, ranks, pattern), f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes that ``ids`` stand for; null ids give no bytes.

    An id that the vocabulary lacks fails the job: it can't be decoded.
    """
    ready(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(lambda it: _decode_batches(it, ranks), f"`{id_col}` {kind}, ids array<int>, decoded binary")

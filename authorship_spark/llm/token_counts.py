"""Token counts of whole texts by rank-synchronous array merging.

The vocabulary is a BPE piece model with byte fallback. Words that are new to a
worker are laid out as one ragged numpy array of symbols. In each round every
sequence that still has a mergeable pair applies its lowest-rank pair, all
sequences at once; the surviving symbols are the tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, text_of
from .words import WordMemory

#: Pre-tokens end before a space, after a letter that no letter follows, and around a
#: line's end. No piece may reach over such a border: _Pieces checks its vocabulary.
_WORDS = re.compile(r"\n|▁*(?:[^\w▁\n]|[\d_²])*[^\W\d_²]+|▁*(?:[^\w▁\n]|[\d_²])+|▁+")
_NONE = np.iinfo(np.int64).max


class _Pieces:
    """Pair table of a piece model: (left, right) -> rank of the piece they make."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        names = {model.id_to_piece(i): i for i in plain}
        if any(_WORDS.findall(p) != [p] for p in names):
            raise ValueError("pieces reach over word borders: this model can't be split into words")
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        rank = np.full(n, _NONE, np.int64)
        # pieces of one score share a rank: among them the leftmost pair goes first
        last, value = None, -1
        for i in order:
            if model.get_score(i) != last:
                last, value = model.get_score(i), value + 1
            rank[i] = value
        self.n = n
        self.char = np.full(0x110000, -1, np.int64)
        for p, i in names.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        left, right, whole = [], [], []
        for p, i in names.items():
            for k in range(1, len(p)):
                a, b = names.get(p[:k]), names.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), whole.append(i)
        key = np.array(left, np.int64) * n + np.array(right, np.int64)
        at = np.argsort(key, kind="stable")
        self.key, self.whole = key[at], np.array(whole, np.int64)[at]
        self.rank = rank[self.whole]
        # A pair may be merged at all its places at once if what it makes only
        # enters pairs of a higher rank, and no other piece shares its rank.
        least = np.full(n, _NONE, np.int64)
        np.minimum.at(least, np.array(left, np.int64), rank[np.array(whole, np.int64)])
        np.minimum.at(least, np.array(right, np.int64), rank[np.array(whole, np.int64)])
        alone = np.bincount(rank[plain])[np.where(rank < _NONE, rank, 0)] == 1
        self.at_once = (least > rank) & alone

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; rank _NONE where they make none."""
        key = a * self.n + b
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        hit = (self.key[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], _NONE), self.whole[at]

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each word."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.char[chars]
        seq = np.repeat(np.arange(len(words)), sizes)
        # a character that the vocabulary lacks is as many tokens as it has bytes
        cost = np.where(sym < 0, 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF), 1)
        out = np.zeros(len(words), np.int64)
        rank, whole = np.full(len(sym), _NONE, np.int64), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], whole[:-1] = self.pairs(sym[:-1], sym[1:])
            rank[:-1][seq[1:] != seq[:-1]] = _NONE
        while len(sym):
            start = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            length = np.diff(np.r_[start, len(seq)])
            low = np.minimum.reduceat(rank, start)
            if (done := low == _NONE).any():  # finished sequences leave the arrays
                out[seq[start[done]]] = np.add.reduceat(cost, start)[done]
                keep = ~np.repeat(done, length)
                sym, seq, cost, rank, whole = sym[keep], seq[keep], cost[keep], rank[keep], whole[keep]
                if not len(sym):
                    break
                start = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
                length, low = length[~done], low[~done]
            hit = np.flatnonzero(rank == np.repeat(low, length))
            first = np.r_[True, seq[hit[1:]] != seq[hit[:-1]]]
            # places that touch (x x x): every second one from the left of its run
            run = np.r_[True, (hit[1:] != hit[:-1] + 1) | first[1:]]
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[first | (self.at_once[whole[hit]] & (nth % 2 == 0))]
            sym[hit] = whole[hit]
            gone = np.zeros(len(sym), bool)
            gone[hit + 1] = True
            at = hit - np.cumsum(gone)[hit]
            keep = ~gone
            sym, seq, cost, rank, whole = sym[keep], seq[keep], cost[keep], rank[keep], whole[keep]
            touched = np.r_[at, at[at > 0] - 1]  # a place may come twice, with one result
            rank[touched] = _NONE
            touched = touched[touched < len(sym) - 1]
            touched = touched[seq[touched] == seq[touched + 1]]
            rank[touched], whole[touched] = self.pairs(sym[touched], sym[touched + 1])
        return out


@lru_cache(maxsize=2)
def _memory(path: str) -> WordMemory:
    pieces = _Pieces(path)
    return WordMemory(lambda words: pieces.count(words).tolist(), limit=800_000)


def _split(text: str) -> list[str]:
    return _WORDS.findall("▁" + text.replace(" ", "▁")) if text else []


def _count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    memory = _memory(path)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        counts = [sum(values) for values in memory.texts(texts, _split)]
        sizes = [len(text.encode()) for text in texts]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
            names=[*batch.schema.names[:-1], "n_bytes", "n_tokens"],
        )


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text under the piece model at ``model``.

    Returns one row per input row: ``id_col``, n_bytes (UTF-8), n_tokens, and
    over_limit (n_tokens > ``limit``). A null text counts as empty (0 bytes, 0
    tokens); repeated rows and null ids stay as they are; other columns are not
    read. Map-only: nothing is shuffled.
    """
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    counted = rows.mapInArrow(lambda it: _count_batches(it, model), f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))

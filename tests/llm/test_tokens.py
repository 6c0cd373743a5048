"""Token counts, byte-level BPE and packing against the libraries and brute force."""

import hashlib
import random
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from authorship_spark.llm import byte_bpe, packing, token_counts

ODD = [
    "", " ", "  a  b ", "漢字 x", "<s> </s> <unk> ▁▁x ▁", "a" * 700, "ab" * 99 + " aab" * 20, "\n\n \n x\t\r", "x\x1cy \x85z᠎  q",
    "İ'll we've'S ²³ ½ Ⅷ 12a_b", "é́é x².", "😀😃 🇩🇪", "the" * 200, "<|endoftext|> x <|endoftext|>", "The same.", "The same.",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    letters = "etaoin shrdlu, .THE\nß漢é'9"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "y")], "doc_id long, text string, n_tokens string")


def test_counts(docs, texts):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, path, limit=100).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got.values())
    assert (got[-1]["n_tokens"], got[-1]["n_bytes"]) == (0, 0) and got[3]["n_bytes"] == 8


def test_bpe_round_trip(docs, texts):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    rows = byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path).collect()
    got = {r["doc_id"]: r for r in rows}
    for i, text in enumerate(texts):
        assert list(got[i]["ids"]) == library.encode_ordinary(text)
        assert bytes(got[i]["decoded"]).decode() == text
    assert got[-1]["ids"] == [] and len(rows) == len(texts) + 1


def test_empty_tables(docs):
    none = docs.where("false")
    assert token_counts.count_tokens(none, P.path("piece_bpe_32k.model")).count() == 0
    assert packing.pack_documents(none, P.path("byte_bpe_50k.json")).count() == 0


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs.unionByName(docs.where("doc_id < 3")), P.path("byte_bpe_50k.json"), max_tokens=64).collect()
    ids = {i: library.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)} | {-1: [2]}
    places = {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] <= 64
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(r["length"] for r in rows)
    assert total == sum(len(ids[i]) for i in ids) + sum(len(ids[i]) for i in (-1, 0, 1, 2))
    assert len(places) <= -(-total // 64) + 2


@pytest.mark.parametrize("seed", range(20))
def test_plan(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 3, 10, 50])
    counts = {}
    for _ in range(rng.choice([0, 5, 300])):
        n = min(size, max(1, int(rng.expovariate(3 / size))))
        counts[n] = counts.get(n, 0) + 1
    seen, fill, large = dict.fromkeys(counts, 0), {}, {}
    for length, first, n, sequence, per, offset in packing.plan_sequences(counts, size):
        assert first == seen[length]
        seen[length] += n
        for k in range(n):
            at = sequence + k // per
            fill.setdefault(at, []).append((offset + k % per * length, length))
            large[at] = large.get(at, 0) + (3 * length > size)
    assert seen == counts and all(n <= 2 for n in large.values())
    for held in fill.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= size

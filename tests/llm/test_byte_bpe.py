"""Byte-level BPE against the tiktoken library, and the perfect hash and the heap by themselves."""

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from scholia.llm import byte_bpe, entries

from .test_operators import DOCS, corpus, folder


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteCoder()


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_hash_is_minimal_and_perfect():
    r = random.Random(3)
    for n in (1, 2, 7, 1000):
        keys = list({bytes(r.randrange(256) for _ in range(r.randint(1, 12))) for _ in range(n)})
        h = byte_bpe.PerfectHash(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
        assert [keys[k] for k in h.key_of[h.slots(keys)]] == keys


def test_both_tiers(coder, library):
    hashed, held, ids = coder.lookup
    words = list(coder.ranks)
    s = hashed.slots(words)
    assert held.take(pa.array(s)).to_pylist() == words and ids[s].tolist() == list(coder.ranks.values())
    r = random.Random(4)
    for w in ["a" * 50_000, "ab" * 999, *("".join(r.choice("etaoin") for _ in range(r.randint(1, 40))) for _ in range(2000))]:
        assert coder.merges.ids(w.encode()) == library._encode_single_piece(w) or w.encode() in coder.ranks


def test_any_code_points_as_the_library(coder, library):
    r = random.Random(1)
    odd = byte_bpe.newer()
    some = lambda: chr(r.choice([r.randrange(0xD800), r.randrange(0xE000, 0x110000), r.randrange(128), 32, 10, 65, ord(r.choice(odd)) if odd else 32]))
    texts = ["".join(some() for _ in range(r.randrange(60))) for _ in range(4000)] + ["a" * 60_000, " " * 5000 + "x", "\n\n \t x", "", None, "<|endoftext|>", "Zß" * 3000, "don't I'LL we've"]
    ids, at = coder.encode(pa.array(texts, pa.string()))
    back, edge = coder.decode(ids, at)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(t or "")
        assert back[edge[i] : edge[i + 1]].tobytes() == (t or "").encode()
    with pytest.raises(ValueError):
        coder.decode(ids + 10**6, at)


def test_query_and_operators(spark, library, tmp_path):
    d = folder(spark, tmp_path, documents=(corpus(), DOCS))
    want = Counter()
    for i, t, *_ in corpus():
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, entries.QUERIES["op11_byte_bpe"](spark, d).collect())) == want
    clash = spark.read.parquet(f"{d}/documents.parquet").withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    listed = byte_bpe.decode_ids(byte_bpe.encode_texts(clash))
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in listed.collect())
    assert got == Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in corpus())


def test_another_vocabulary(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    d = spark.createDataFrame([(1, "Plain words, 123 und Wörter")], "doc_id long, text string")
    assert byte_bpe.encode_texts(d, "byte_bpe_50k.tiktoken").first().ids == e.encode_ordinary("Plain words, 123 und Wörter")

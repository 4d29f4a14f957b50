"""Byte-level BPE: whole texts to token ids by a file of ranks, and ids back to bytes.

Method. A pattern cuts a text into pre-tokens, and the distinct ones of an Arrow batch are looked up in two tiers. A minimal
perfect hash (hash and displace: one slot for each vocabulary entry, none free) finds the pre-tokens that the vocabulary
holds whole; the slot's bytes are compared, as a hash finds a slot for any word. Each other pre-token is a linked list of its
bytes with a heap of neighbour pairs by (rank, place), so a pre-token of n bytes takes n log n steps, however long it is. The
ids of a batch's words last until the next batch; those met in both are kept, in a cache of bounded size for each worker. Decoding gathers the bytes of all ids of a batch at once.

The ids are those of the tiktoken library without special tokens. Letters and numbers that its Unicode tables lack are
symbols there, so they are symbols here too (``newer``).

Defined results: a null or empty text has no ids; texts of any length are encoded whole, in batches bounded by their bytes; rows
with one doc_id or none are separate rows; an empty table gives an empty table; other columns are neither read nor kept.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .tokens import batches_by_size

RANKS = "byte_bpe_multi_50k.tiktoken"
PACKED = "doc_id long, ids binary"
LISTED = "doc_id long, ids array<int>"
CACHE_WORDS = 200_000
CACHED_BYTES = 64  # longer words are rare and would make the cache's size unbounded
BATCH_CHARS = 2_000_000
KEYS_A_BUCKET, TRIES = 2, 32


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: n keys take the slots 0 to n - 1, one each.

    Keys fall into buckets; the fullest first, each bucket takes the least displacement that moves its keys to free slots. A
    bucket of one key names its slot outright (a displacement below zero), which fills the table to the last slot.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets, self.seed = len(keys), len(keys) // KEYS_A_BUCKET + 1, 0
        while not self._place(keys):
            self.seed += 1

    def hashes(self, keys: list[bytes]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        seed = self.seed
        return np.fromiter((xxh64_intdigest(k, seed) for k in keys), np.uint64, len(keys))

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return (h % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(self.n)).astype(np.int64)

    def _place(self, keys: list[bytes]) -> bool:
        h = self.hashes(keys)
        bucket = self._bucket(h)
        self.moved, self.key_of = np.zeros(self.buckets, np.int64), np.full(self.n, -1, np.int64)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        size = np.diff(edge)
        for b in np.argsort(-size, kind="stable").tolist():
            ks = order[edge[b] : edge[b + 1]]
            if len(ks) < 2:
                break
            d = 0
            while True:
                slots = self._slot(h[ks], np.arange(d, d + TRIES)[:, None])
                s = np.sort(slots, axis=1)
                good = np.flatnonzero((self.key_of[slots] < 0).all(axis=1) & (s[:, 1:] != s[:, :-1]).all(axis=1))
                if len(good):
                    self.moved[b], slots = d + good[0], slots[good[0]]
                    break
                d += TRIES
                if d > 4 * self.n:
                    return False
            self.key_of[slots] = ks
        single = np.flatnonzero(size == 1)
        free = np.flatnonzero(self.key_of < 0)
        self.key_of[free] = order[edge[single]]
        self.moved[single] = -1 - free
        return True

    def slots(self, keys: list[bytes]) -> np.ndarray:
        h = self.hashes(keys)
        d = self.moved[self._bucket(h)]
        return np.where(d < 0, -1 - d, self._slot(h, np.maximum(d, 0)))


class Merges:
    """Ids of words by merging: the pair of least rank, leftmost among equals, is joined until no pair has a rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.pair = [-1] * 65536  # ranks of two bytes
        for x, r in ranks.items():
            if len(x) == 2:
                self.pair[x[0] << 8 | x[1]] = r

    def ids(self, word: bytes) -> list[int]:
        n, get, push, pop, pair = len(word), self.ranks.get, heapq.heappush, heapq.heappop, self.pair
        bits = n.bit_length()
        mask = (1 << bits) - 1
        # a part is known by its first byte's place: what comes after and before it, its id, and the rank of it with the next part
        after, before, part = list(range(1, n + 1)), list(range(-1, n - 1)), [self.byte[c] for c in word]
        rank = [pair[a << 8 | b] for a, b in zip(word, word[1:])]
        heap = [r << bits | i for i, r in enumerate(rank) if r >= 0]
        rank.append(-1)
        heapq.heapify(heap)
        while heap:
            key = pop(heap)
            i, r = key & mask, key >> bits
            if rank[i] != r:  # the part or its neighbour has changed since
                continue
            k = after[i]
            z = after[i] = after[k]
            part[i], rank[k] = r, -1
            if z < n:
                before[z] = i
                r = rank[i] = get(word[i : after[z]], -1)
                if r >= 0:
                    push(heap, r << bits | i)
            else:
                rank[i] = -1
            p = before[i]
            if p >= 0:
                r = rank[p] = get(word[p:z], -1)
                if r >= 0:
                    push(heap, r << bits | p)
        ids, i = [], 0
        while i < n:
            ids.append(part[i])
            i = after[i]
        return ids


@cache
def newer() -> str:
    """Letters and numbers by the regex module's Unicode tables that the tiktoken library's tables don't have yet."""
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    known = tiktoken.Encoding("classes", pat_str=r"[\p{L}\p{N}]", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return "".join(sorted(set(regex.findall(r"[\p{L}\p{N}]", every)) - set(known.decode_bytes(known.encode_ordinary(every)).decode())))


def strung(flat: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists laid end to end in ``flat``, of ``n`` values each: those numbered ``at`` laid end to end, and their sizes."""
    first, size = (np.cumsum(n) - n)[at], n[at]
    ends = np.cumsum(size)
    return flat[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)], size


def cut_at_blanks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Stretches of the texts, each beginning at a text's start or at a blank between two characters that surely aren't white
    space: ASCII marks and letters, or characters of two bytes from U+00C0 on. And the number of each text's stretches."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    edge = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if edge[-1] == edge[0]:
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[edge[0] : edge[-1]]
    edge = edge - edge[0]
    blank = np.flatnonzero(data == 32)
    blank = blank[(blank > 1) & (blank < len(data) - 1)]
    near, back, back2 = data[blank + 1], data[blank - 1], data[blank - 2]
    sure = lambda b: (b > 32) & (b < 127)
    two = lambda b: (b >= 0xC3) & (b < 0xE0)
    blank = blank[(sure(near) | two(near)) & (sure(back) | (two(back2) & (back >= 0x80) & (back < 0xC0)))]
    opens = edge[:-1][edge[:-1] < edge[1:]]
    starts = np.unique(np.append(opens, blank))
    offsets = np.append(starts, len(data)).astype(np.int64)
    per = np.searchsorted(starts, edge[1:]) - np.searchsorted(starts, edge[:-1])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]), per


class ByteCoder:
    def __init__(self, vocabulary: str = RANKS):
        import public_tokenizers
        import regex

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        if any(bytes([i]) not in self.ranks for i in range(256)):
            raise ValueError(f"{vocabulary} lacks single bytes")
        self.merges = Merges(self.ranks)
        entries = list(self.ranks)
        self.first, self.size = np.zeros(max(self.ranks.values()) + 1, np.int64), np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        sizes, ids = np.array([len(x) for x in entries]), np.array(list(self.ranks.values()))
        self.size[ids], self.first[ids] = sizes, np.cumsum(sizes) - sizes
        self.text_pattern = public_tokenizers.PATTERN
        self.pattern = regex.compile(self.text_pattern)
        self.kept: dict[bytes, bytes] = {}
        self.recent: dict[bytes, bytes] = {}

    @cached_property
    def lookup(self) -> tuple[PerfectHash, pa.Array, np.ndarray]:
        """The hash of the vocabulary, and each slot's bytes and id."""
        entries = list(self.ranks)
        hashed = PerfectHash(entries)
        by_slot = [entries[k] for k in hashed.key_of.tolist()]
        return hashed, pa.array(by_slot, pa.binary()), np.array([self.ranks[x] for x in by_slot], np.uint32)

    @cached_property
    def careful(self):
        """The pattern with the newer letters and numbers as symbols; slower, so only texts that may hold some meet it."""
        import regex

        odd = newer()
        p = self.text_pattern.replace(r"[^\s\p{L}\p{N}]", r"[[^\s\p{L}\p{N}]NEWER]").replace(r"\p{L}+", r"[\p{L}--NEWER]+").replace(r"\p{N}+", r"[\p{N}--NEWER]+")
        return regex.compile(p.replace("NEWER", f"[{odd}]"), regex.V1)

    def _ids_of(self, words: list[bytes], distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct words, and the number of ids of each."""
        hashed, slot_bytes, slot_id = self.lookup
        slot = hashed.slots(words)
        whole = np.asarray(pc.equal(slot_bytes.take(pa.array(slot)), distinct))
        rest, kept, recent, new, found, merge = np.flatnonzero(~whole).tolist(), self.kept, self.recent, {}, [], self.merges.ids
        for i in rest:
            w = words[i]
            ids = kept.get(w)
            if ids is None:
                ids = recent.get(w)
                if ids is None:
                    ids = array("I", merge(w)).tobytes()
                elif len(kept) < CACHE_WORDS:
                    kept[w] = ids
                if len(w) <= CACHED_BYTES:
                    new[w] = ids
            found.append(ids)
        self.recent = new
        n = np.ones(len(words), np.int64)
        n[rest] = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.empty(int(n.sum()), np.uint32)
        at_whole = np.repeat(whole, n)
        flat[at_whole] = slot_id[slot[whole]]
        flat[~at_whole] = np.frombuffer(b"".join(found), np.uint32)
        return flat, n

    def _split(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of all texts, and the number of each text's."""
        odd, words, ends, plain = newer(), [], np.zeros(len(texts) + 1, np.int64), self.pattern.findall
        for i, t in enumerate(texts):
            words += plain(t) if not odd or t.isascii() or max(t) < odd[0] else self.careful.findall(t)
            ends[i + 1] = len(words)
        return words, np.diff(ends)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and each text's first place in them (one place more than texts).

        No pre-token crosses a single blank between two other characters, but for the blank that begins it; so texts are cut there
        first, and each distinct stretch is split by the pattern once.
        """
        stretches, per = cut_at_blanks(texts)
        if not len(stretches):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        stretches = stretches.dictionary_encode()
        words, parts = self._split(stretches.dictionary.to_pylist())
        coded = pa.array(words, pa.string()).dictionary_encode()
        del words
        distinct = coded.dictionary.cast(pa.binary())
        flat, n = self._ids_of(distinct.to_pylist(), distinct)
        flat, n = strung(flat, n, coded.indices.to_numpy())
        flat, n = strung(flat, np.diff(np.append(0, np.cumsum(n))[np.append(0, np.cumsum(parts))]), stretches.indices.to_numpy())
        return flat, np.append(0, np.cumsum(n))[np.append(0, np.cumsum(per))]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of flat ids, and the first byte of each text."""
        size = self.size[np.minimum(ids, len(self.size) - 1)]
        if len(ids) and (int(ids.max()) >= len(self.size) or not size.all()):
            raise ValueError("an id is not in the vocabulary")
        ends = np.cumsum(size)
        out = self.flat[np.repeat(self.first[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return out, np.append(0, ends)[starts]


@cache
def byte_coder(vocabulary: str) -> ByteCoder:
    """This worker's coder."""
    return ByteCoder(vocabulary)


def _binaries(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Slices of ``data`` as binary values; starts count bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def encode_texts(docs: DataFrame, vocabulary: str = RANKS, packed: bool = False, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of rows (doc_id, text); packed ids are little-endian unsigned 32-bit integers in one binary value.

    ``decoded`` adds the bytes that the ids decode to, worked out in the same pass, so that callers can compare or digest them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = byte_coder(vocabulary)
        for whole in batches:
            for b in batches_by_size(whole, chars=BATCH_CHARS):
                ids, starts = code.encode(b["text"])
                columns = [b["doc_id"]]
                if packed:
                    columns.append(_binaries(ids.astype("<u4"), 4 * starts))
                else:
                    columns.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32))))
                if decoded:
                    columns.append(_binaries(*code.decode(ids, starts)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(run, (PACKED if packed else LISTED) + ", decoded binary" * decoded)


def decode_ids(encoded: DataFrame, vocabulary: str = RANKS) -> DataFrame:
    """(doc_id, ids, decoded) of ``encode_texts``' rows, packed or listed; decoded is the bytes; null ids decode to none."""
    packed = dict(encoded.dtypes)["ids"] == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = byte_coder(vocabulary)
        for b in batches:
            if packed:
                sizes = pc.fill_null(pc.binary_length(b["ids"]), 0).to_numpy() // 4
                ids = np.frombuffer(b"".join(x for x in b["ids"].to_pylist() if x), "<u4")
            else:
                sizes = pc.fill_null(pc.list_value_length(b["ids"]), 0).to_numpy()
                ids = pc.list_flatten(b["ids"]).to_numpy(zero_copy_only=False).astype(np.uint32)
            data, starts = code.decode(ids, np.append(0, np.cumsum(sizes)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["ids"], _binaries(data, starts)], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"{PACKED if packed else LISTED}, decoded binary")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_texts(read(spark, sf_dir, "documents", "doc_id", "text"), packed=True, decoded=True)
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

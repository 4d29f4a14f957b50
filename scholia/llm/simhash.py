"""SimHash near-duplicates by bit-sliced comparison.

Method. Words are lower-cased (A-Z), every 4-word shingle is hashed by XXH64 with seed 42, and a fingerprint bit is set
where more than half of the hashes have it. Documents of one fingerprint are one class. Two fingerprints within RADIUS
bits agree wholly on at least ``blocks - RADIUS`` of any ``blocks`` blocks of bits, so each class is dealt to one bucket
for each such choice of blocks, which loses no pair; more blocks are used as classes grow, to keep buckets small. Within
a bucket the candidates stand as 64 bit planes, 64 candidates to a word; one query's bits are compared with a plane of
64 candidates by one XOR, three carry-save counters add up the distances, and a word is abandoned once all its
candidates are beyond the radius. Buckets give spanning links, and links give components.

Defined results: null, empty or blank texts have fingerprint zero and link like any other; rows without id have no
component; repeated rows share theirs; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import dealt, in_parts, least_labels, whole_groups
from .common import connected_components, fresh, read, staged

SHINGLE, SEED, RADIUS, BITS = 4, 42, 4, 64
BUCKET = 64
PART = 8192
BATCH_DOCS = 512


def _hashes(text: str | None, xxh) -> np.ndarray:
    ws = text.encode().lower().split() if text else []
    if not ws:
        return np.zeros(0, np.uint64)
    line = b" ".join(ws)
    if len(ws) <= SHINGLE:
        return np.array([xxh(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(ws) - SHINGLE + 1].tolist()
    return np.fromiter((xxh(line[a:z], SEED) for a, z in zip(starts, ends[SHINGLE - 1 :].tolist())), np.uint64, len(starts))


def _majority(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each array of hashes."""
    n = np.array([len(h) for h in hashes])
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(np.concatenate(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = (np.cumsum(n) - n)[some]
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for whole in batches:
        for at in range(0, whole.num_rows, BATCH_DOCS):
            b = whole.slice(at, BATCH_DOCS)
            fp, hashes, held = [], [], 0
            for t in b["text"].to_pylist():
                hashes.append(_hashes(t, xxhash.xxh64_intdigest))
                held += len(hashes[-1])
                if held > 500_000:
                    fp.append(_majority(hashes))
                    hashes, held = [], 0
            fp.append(_majority(hashes))
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(np.concatenate(fp).view(np.int64))], ["key", "fp"])


def fingerprints(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, fp) with the fingerprint's bits as a long, written once."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return staged(rows.mapInArrow(_fingerprinted, "key long, fp long"), "fingerprints")


def block_masks(blocks: int) -> list[int]:
    """Masks of every choice of ``blocks - RADIUS`` blocks, as signed longs."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    one = [(1 << z) - (1 << a) for a, z in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(one, blocks - RADIUS)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def near_rows(fp: np.ndarray, query: np.ndarray, word_of: list[np.ndarray], blocks: list[tuple[int, int, int, int]], room: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within RADIUS bits.

    Each block (q0, q1, w0, w1) compares the query rows query[q0:q1] with the lane words w0 to w1; ``word_of`` holds up to
    64 candidate rows for each word.
    """
    lanes = np.zeros((len(word_of), 64), np.uint64)
    rows = np.full((len(word_of), 64), -1, np.int64)
    for w, r in enumerate(word_of):
        lanes[w, : len(r)], rows[w, : len(r)] = fp[r], r
    planes = np.stack([np.packbits((lanes >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel() for b in range(BITS)])
    valid = np.packbits(rows >= 0, axis=1, bitorder="little").view(np.uint64).ravel()
    found_q, found_c = [], []

    def run(q: np.ndarray, w: np.ndarray) -> None:
        bits = fp[q]
        one, two, four, over = (np.zeros(len(q), np.uint64) for _ in range(4))
        for b in range(BITS):
            d = planes[b][w] ^ (np.uint64(0) - (bits >> np.uint64(b) & np.uint64(1)))
            carry = one & d
            one ^= d
            d = two & carry
            two ^= carry
            over |= four & d
            four ^= d
            if b % 8 == 7:
                alive = valid[w] & ~(over | four & (one | two)) != 0
                if alive.sum() < 0.7 * len(alive) or b == BITS - 1:
                    q, w, bits, one, two, four, over = (x[alive] for x in (q, w, bits, one, two, four, over))
                    if not len(q):
                        return
        hit = valid[w] & ~(over | four & (one | two))
        k, lane = np.nonzero(np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        found_q.append(q[k])
        found_c.append(rows[w[k], lane])

    qs, ws, held = [], [], 0
    for q0, q1, w0, w1 in blocks:
        for w in range(w0, w1):
            qs.append(query[q0:q1])
            ws.append(np.full(q1 - q0, w))
            held += q1 - q0
            if held > room:
                run(np.concatenate(qs), np.concatenate(ws))
                qs, ws, held = [], [], 0
    if held:
        run(np.concatenate(qs), np.concatenate(ws))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_q]), np.concatenate([none, *found_c])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, at in whole_groups(batches, ["choice", "bucket", "lo", "hi"]):
        node, fp = t["node"].to_numpy(), t["fp"].to_numpy().view(np.uint64)
        own, lo, hi = (t[c].to_numpy() for c in ("own", "lo", "hi"))
        query, words, blocks, q = [], [], [], 0
        for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
            rows = np.arange(a, z)
            ask, told = (rows, rows) if lo[a] == hi[a] else (rows[own[a:z] == lo[a]], rows[own[a:z] == hi[a]])
            if not len(ask) or not len(told):
                continue
            w = len(words)
            words += [told[i : i + 64] for i in range(0, len(told), 64)]
            query.append(ask)
            blocks.append((q, q + len(ask), w, len(words)))
            q += len(ask)
        if blocks:
            x, y = near_rows(fp, np.concatenate(query), words, blocks)
            least = least_labels(len(fp), x, y, node)
            on = least != node
            yield pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(least[on])], ["a", "b"])


def near_components(prints: DataFrame) -> DataFrame:
    """(key, fp, component) of rows (key, fp): component is the least key reachable by links; null keys have none."""
    classes = prints.where("key is not null").groupBy("fp").agg(F.min("key").alias("node")).checkpoint()
    n, blocks = classes.count(), RADIUS + 1
    while n > BUCKET << (BITS * (blocks - RADIUS) // blocks) and blocks < 12:
        blocks += 1
    choices = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for i, m in enumerate(block_masks(blocks))))
    rows = classes.select("node", "fp", F.explode(choices).alias("c")).select("node", "fp", "c.choice", "c.bucket")
    key = ["choice", "bucket"]
    links = dealt(in_parts(rows, key, "node", PART), key).select("choice", "bucket", "lo", "hi", "own", "node", "fp").mapInArrow(_compared, "a long, b long")
    parts = connected_components(links)
    named = classes.join(parts.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    named = named.select(F.col("fp").alias("_fp"), F.coalesce("component", classes["node"]).alias("component"))
    return prints.join(named, F.col("fp") == F.col("_fp"), "left").select("key", "fp", F.when(F.col("key").isNotNull(), F.col("component")).alias("component"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(fingerprints(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id"))
    return out.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the least doc_id stays; of rows tied in that the first in the table.

    Null texts, like all texts without a word, are one group; rows with null ids come before others; columns of any name are
    kept as they are; an empty table gives an empty one.
    """
    row = fresh(docs, "row_key")
    kept = staged(docs.withColumn(row, F.monotonically_increasing_id()), "simhash")
    found = near_components(fingerprints(kept, row)).select(F.col("key").alias("_key"), "component")
    ids = kept.select(F.col(row).alias("_row"), F.col("doc_id").alias("_id"))
    first = found.join(ids, F.col("_key") == F.col("_row")).groupBy("component").agg(F.min(F.struct("_id", "_row")).alias("m")).select(F.col("m._row").alias(row))
    return kept.join(first, row, "left_semi").select(*docs.columns)

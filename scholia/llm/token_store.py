"""Token ids in a content-addressed store: chunks stored once, recipes and Merkle manifests to verify them.

Format. A store is a folder of Parquet tables.
* ``chunks``: digest (SHA-256 of the chunk's little-endian ids), n_ids, width (bytes per id), payload (zstd).
* ``recipes``: in ascending doc_id order, row_key, doc_id, nth (documents before), start (ids of all documents before),
  n_tokens, root (Merkle root of the document's chunk digests), chunks (digest, n_ids, ids after it).
* ``manifest``: a Merkle tree over all recipes. Level 0 has a row for BLOCK_DOCS documents in a row: number, n_docs, n_tokens,
  start, and the root of their leaves, which bind a document's place, id, length and root. Each level above has a row for
  BLOCK_DOCS rows of the one below, up to a single row.

Method. A rolling hash over eight ids cuts each document's stream where content says so, hence equal passages give
equal chunks wherever they stand; a chunk has LEAST to MOST ids, except a document's last. Equal digests are stored
once. Reading opens every stored chunk, checks its digest, joins chunk checksums to recipes and adds them up: CRC-32 is
linear, so a document's checksum is the XOR of its chunks' checksums, each moved past the bytes that follow it. The manifest is
worked out again from the recipes and must be the stored one, so a missing, foreign, changed or moved recipe is found.

Defined results: a null text is empty and has the end id only; documents without id come first; rows with one doc_id are
separate documents, in the order of their row keys; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, scratch_path, staged
from .tokens import VOCABULARY, batches_by_size, coder

END_ID = 2
LEAST, MOST, MEAN_BITS = 128, 4096, 9
BLOCK_DOCS = 4096
# a row has a chunk that its task hasn't met before, a document's recipe (with its first chunk), or both
PART_ROWS = "row_key long, doc_id long, n_tokens long, root binary, chunks array<struct<seq: int, digest: binary, n_ids: int, after: long>>, digest binary, n_ids int, width int, payload binary"
_RECIPE = pa.list_(pa.struct([("seq", pa.int32()), ("digest", pa.binary()), ("n_ids", pa.int32()), ("after", pa.int64())]))


def merkle_root(digests: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node moves up as it is."""
    level = list(digests) or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cut_places(ids: np.ndarray) -> np.ndarray:
    """Places at which the hash of the last eight ids has MEAN_BITS zero bits."""
    g = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    g ^= g >> np.uint64(29)
    h = g.copy()
    for k in range(1, 8):
        h[k:] += g[:-k] << np.uint64(5 * k)
    return np.flatnonzero((h >> np.uint64(64 - MEAN_BITS)) == 0) + 1


def chunk_bounds(n: int, cuts: np.ndarray) -> list[int]:
    """Ends of a document's chunks, from the sorted cut places inside it."""
    ends, at = [], 0
    for c in [*cuts.tolist(), n]:
        while c - at > MOST:
            at += MOST
            ends.append(at)
        if c == n and c > at or c - at >= LEAST:
            at = c
            ends.append(at)
    return ends


def _chunked(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        code, press = coder(vocabulary), zstandard.ZstdCompressor(level=1)
        seen: set[bytes] = set()
        for whole in batches:
            for b in batches_by_size(whole):
                ids, starts = code.encode(b["text"], end_id)
                cuts = cut_places(ids)
                lo = np.searchsorted(cuts, starts, "right")
                stored = ids.astype(code.wide)
                width = stored.itemsize
                rows = []
                for k, (key, doc) in enumerate(zip(b["row_key"].to_pylist(), b["doc_id"].to_pylist(), strict=True)):
                    first, n = int(starts[k]), int(starts[k + 1] - starts[k])
                    ends = chunk_bounds(n, cuts[lo[k] : lo[k + 1]] - first)
                    raw = [stored[first + a : first + z].tobytes() for a, z in zip([0, *ends], ends)]
                    digests = [hashlib.sha256(x).digest() for x in raw]
                    chunks = [{"seq": seq, "digest": d, "n_ids": len(x) // width, "after": n - z} for seq, (x, d, z) in enumerate(zip(raw, digests, ends))]
                    told = (key, doc, n, merkle_root(digests), chunks)
                    for x, d in zip(raw, digests):
                        new = d not in seen
                        seen.add(d)
                        if new or told[-1] is not None:
                            rows.append((*told, *((d, len(x) // width, width, press.compress(x)) if new else (None,) * 4)))
                        told = (None,) * 5
                if len(seen) > 200_000:
                    seen.clear()
                cols = list(zip(*rows)) or [()] * 9
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), _RECIPE, pa.binary(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["row_key", "doc_id", "n_tokens", "root", "chunks", "digest", "n_ids", "width", "payload"])

    return run


def running_starts(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """``rows`` with ``nth``, the rows before in ``order``, and ``start``, the sum of their ``size``, without one big task.

    Rows are dealt by range and written; two sums a partition (as many as partitions) are added up on the driver.
    """
    spark = rows.sparkSession
    dealt = staged(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ordered")
    before, n, total = [], 0, 0
    for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total")).orderBy("part").collect():
        before.append((r["part"], n, total))
        n, total = n + r["n"], total + r["total"]
    offsets = F.broadcast(spark.createDataFrame(before, "part int, n_before long, before long"))
    w = Window.partitionBy("part").orderBy(*order)
    inner = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = dealt.withColumn("inner", inner).withColumn("in_part", F.row_number().over(w) - 1).join(offsets, "part")
    return d.withColumn("nth", F.col("in_part") + F.col("n_before")).withColumn("start", F.col("inner") + F.col("before")).drop("inner", "in_part", "part", "n_before", "before")


MANIFEST = "level int, block long, n_docs long, n_tokens long, start long, root binary"


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        roots = [merkle_root([x["leaf"] for x in xs]) for xs in b["leaves"].to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b[c] for c in ("level", "block", "n_docs", "n_tokens", "start")), pa.array(roots, pa.binary())], ["level", "block", "n_docs", "n_tokens", "start", "root"])


def manifest_of(recipes: DataFrame) -> DataFrame:
    """The Merkle tree over recipes: groups of BLOCK_DOCS, level by level, each written once."""
    told = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "nth", "start", "n_tokens", F.hex("root"))
    rows = recipes.select(F.lit(-1).alias("level"), F.col("nth").alias("block"), F.lit(1).cast("long").alias("n_docs"), "n_tokens", "start", F.unhex(F.sha2(told, 256)).alias("leaf"))
    levels = []
    while True:
        up = rows.groupBy(F.col("level") + 1, F.floor(F.col("block") / BLOCK_DOCS)).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("block", "leaf"))).alias("leaves"))
        level = staged(up.toDF("level", "block", "n_docs", "n_tokens", "start", "leaves").mapInArrow(_rooted, MANIFEST), "manifest")
        levels.append(level)
        if level.count() <= 1:
            break
        rows = level.select("level", "block", "n_docs", "n_tokens", "start", F.col("root").alias("leaf"))
    tree = levels[0]
    for level in levels[1:]:
        tree = tree.union(level)
    return tree


def write_store(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Encodes ``docs`` once into staged chunk rows, then writes the three tables below ``path``."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = staged(rows.mapInArrow(_chunked(vocabulary, end_id), PART_ROWS), "chunked", codec="snappy")
    once = parts.where(F.col("payload").isNotNull()).groupBy("digest").agg(*(F.first(c).alias(c) for c in ("n_ids", "width", "payload")))
    once.write.option("compression", "none").parquet(f"{path}/chunks")
    recipes = parts.where(F.col("chunks").isNotNull()).select("row_key", "doc_id", "n_tokens", "root", "chunks")  # a document's chunks come from one task
    recipes = running_starts(recipes, ["doc_id", "row_key"], "n_tokens")
    recipes.sortWithinPartitions("doc_id", "row_key").write.parquet(f"{path}/recipes")
    manifest_of(docs.sparkSession.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def check_manifest(spark: SparkSession, path: str) -> None:
    """Raises ValueError unless the stored manifest is that of the stored recipes."""
    own, stored = manifest_of(spark.read.parquet(f"{path}/recipes")), spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    key = ["level", "block"]
    both = own.withColumn("own", F.struct(*own.columns[2:])).select(*key, "own").join(stored.withColumn("stored", F.struct(*own.columns[2:])).select(*key, "stored"), key, "full_outer")
    if bad := both.where(~F.col("own").eqNullSafe(F.col("stored"))).count():
        raise ValueError(f"{bad} rows of the manifest don't match the recipes")


# CRC-32 of byte strings as linear maps
def _raw_crc(data: bytes) -> int:
    return zlib.crc32(data, 0xFFFFFFFF) ^ 0xFFFFFFFF


@cache
def _shift_tables() -> list[np.ndarray]:
    """For each k, four tables of 256 entries that move a checksum past 2**k zero bytes; made once a worker."""
    one = np.uint64(1)
    unit = np.zeros(32, np.uint64)
    for b in range(32):  # past one byte: the register's low byte leaves through the checksum of that byte
        v = 1 << b
        unit[b] = (v >> 8) ^ (_raw_crc(bytes([v & 255])))
    byte, tables = np.arange(256, dtype=np.uint64), []
    for _ in range(40):
        t = np.zeros((4, 256), np.uint64)
        for q in range(4):
            for b in range(8):
                t[q] ^= unit[8 * q + b] * (byte >> np.uint64(b) & one)
        tables.append(t)
        unit = _apply(t, unit)
    return tables


def _apply(t: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return t[0, crc & 255] ^ t[1, crc >> 8 & 255] ^ t[2, crc >> 16 & 255] ^ t[3, crc >> 24 & 255]


def moved(crc: np.ndarray, n_bytes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Each checksum moved past its number of zero bytes."""
    crc, n_bytes = crc.astype(np.uint64), n_bytes.astype(np.int64)
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        on = (n_bytes >> k & 1) == 1
        crc[on] = _apply(tables[k], crc[on])
    return crc


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    for b in batches:
        out = []
        for d, w, p in zip(b["digest"].to_pylist(), b["width"].to_pylist(), b["payload"].to_pylist(), strict=True):
            raw = press.decompress(p, max_output_size=MOST * 4)
            if hashlib.sha256(raw).digest() != d:
                raise ValueError("a stored chunk doesn't match its digest")
            ids = np.frombuffer(raw, np.uint16 if w == 2 else np.uint32)
            out.append((d, len(ids), _raw_crc(ids.astype("<u4").tobytes())))
        cols = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int64()))], ["digest", "got", "crc"])


def _moved_past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = _shift_tables()
    for b in batches:
        crc = moved(b["crc"].to_numpy(), b["after"].to_numpy() * 4, tables).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*(b[c] for c in ("row_key", "seq", "digest", "n_ids", "got")), pa.array(crc)], ["row_key", "seq", "digest", "n_ids", "got", "crc"])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = _shift_tables()
    for b in batches:
        n = b["n_tokens"].to_numpy()
        ones = moved(np.full(len(n), 0xFFFFFFFF, np.uint64), n * 4, tables)
        crc = (b["crc"].to_numpy().astype(np.uint64) ^ ones ^ np.uint64(0xFFFFFFFF)).astype(np.int64)
        for root, ds in zip(b["root"].to_pylist(), b["digests"].to_pylist(), strict=True):
            if merkle_root(ds) != root:
                raise ValueError("a document's chunks don't match its root")
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["start"], b["n_tokens"], pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the stored files; the manifest, each chunk and each document are verified."""
    check_manifest(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "width", "payload").mapInArrow(_opened, "digest binary, got int, crc long")
    recipes = spark.read.parquet(f"{path}/recipes")
    uses = recipes.select("row_key", F.explode("chunks").alias("c")).select("row_key", "c.seq", "c.digest", "c.n_ids", "c.after")
    each = uses.join(chunks, "digest", "left").mapInArrow(_moved_past, "row_key long, seq int, digest binary, n_ids int, got int, crc long")
    docs = each.groupBy("row_key").agg(F.bit_xor("crc").alias("crc"), F.sum("got").alias("got"))
    whole = recipes.select("row_key", "doc_id", "start", "n_tokens", "root", F.col("chunks.digest").alias("digests")).join(docs, "row_key")
    whole = whole.where(F.when(F.col("got") == F.col("n_tokens"), True).otherwise(F.raise_error(F.lit("a document lacks chunks"))))
    return whole.mapInArrow(_checked, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of whole documents, put together from their chunks."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for b in batches:
            ids = [np.concatenate([np.frombuffer(press.decompress(x["payload"], max_output_size=MOST * 4), np.uint16 if x["width"] == 2 else np.uint32) for x in xs]).astype(np.int32) for xs in b["parts"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["start"], pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    uses = spark.read.parquet(f"{path}/recipes").select("row_key", "doc_id", "start", F.explode("chunks").alias("c"))
    uses = uses.join(spark.read.parquet(f"{path}/chunks"), uses["c.digest"] == F.col("digest"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("c.seq").alias("seq"), "width", "payload")))
    return uses.groupBy("row_key", "doc_id", "start").agg(parts.alias("parts")).mapInArrow(joined, "doc_id long, start long, ids array<int>")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    write_store(read(spark, sf_dir, "documents", "doc_id", "text"), path)
    return read_checked(spark, path)

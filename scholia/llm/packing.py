"""Best-fit packing by length patterns.

Method. Documents longer than a sequence are cut; the lengths of all pieces make a histogram of at most ``size`` numbers.
Patterns of two or three lengths that fill a sequence exactly are enumerated (of the triples with one longest length at most
PER_LENGTH, spread evenly over the middle lengths), their repeat counts are fitted to the histogram by non-negative least squares, rounded and limited to what is there. What is left is packed best fit, longest
first, on the histogram. The plan is a short table: runs of pieces of one length, by rank, and where they go. Pieces
get ranks within their length by salted counts, so a common length is no big task, and look their place up.

The plan's work depends on ``size`` alone; only the histogram reaches the driver.

Defined results: a null text is empty and has the end id only; rows with one doc_id are separate documents; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, staged
from .tokens import VOCABULARY, batches_by_size, coder

SIZE = 4096
END_ID = 1
#: Patterns tried for each longest length: with 4,096 lengths there are some 2.8 million triples, and the fit needs but a spread of
#: them. It bounds the plan, not the pieces: what no pattern takes is packed best fit.
PER_LENGTH = 24
ROUNDS = 150
ROWS_PER_SALT = 50_000
LEAST_SALTS = 64
PIECE = "row_key long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(vocabulary: str, end_id: int, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        code, press = coder(vocabulary), zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for b in batches_by_size(whole):
                ids, starts = code.encode(b["text"], end_id)
                n = np.diff(starts)
                pieces = -(-n // size)
                doc = np.repeat(np.arange(len(n)), pieces)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = nth * size
                length = np.minimum(size, n[doc] - start)
                raw, first = memoryview(ids.astype("<u4").tobytes()), (4 * (starts[doc] + start)).tolist()
                parts = [raw[a : a + k] for a, k in zip(first, (4 * length).tolist())]
                at = pa.array(doc)
                cols = [b["row_key"].take(at), b["doc_id"].take(at), pa.array(nth.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                names = ["row_key", "doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    stored = ids.astype(code.wide)
                    packed = [press.compress(stored[a // 4 : a // 4 + k]) for a, k in zip(first, length.tolist())]
                    cols, names = [*cols, pa.array(np.full(len(doc), stored.itemsize, np.int32)), pa.array(packed, pa.binary())], [*names, "width", "payload"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def cut_pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, end_id: int = END_ID, size: int = SIZE, with_ids: bool = True) -> DataFrame:
    """One row per piece, written once: row_key, doc_id, piece, start, length, ids_crc32 and, where asked for, its packed ids (see ``with_ids``)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return staged(rows.mapInArrow(_cut(vocabulary, end_id, size, with_ids), PIECE + (", width int, payload binary" if with_ids else "")), "pieces", codec="snappy")


def patterns(hist: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a sequence, for the lengths that occur."""
    size = len(hist) - 1
    there = np.flatnonzero(hist[:size])
    rows = []
    for a in there[there * 3 >= size].tolist():
        rest = size - a
        if rest <= a and hist[rest]:
            rows.append((a, rest, 0))
        mid = there[(there <= min(a, rest - 1)) & (2 * there >= rest)]
        mid = mid[hist[rest - mid] > 0]
        if len(mid):
            pick = mid[np.unique(np.linspace(0, len(mid) - 1, min(PER_LENGTH, len(mid))).astype(int))]
            rows += [(a, int(m), rest - int(m)) for m in pick]
    return np.array(rows, np.int64).reshape(-1, 3)


def fit(rows: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """Repeat counts that bring the patterns nearest to the histogram in least squares, none negative."""
    h = hist.astype(float).copy()
    h[0] = 0
    inside = rows > 0
    ah = (h[rows] * inside).sum(1)
    x = np.full(len(rows), 0.5)
    for _ in range(ROUNDS):  # multiplicative steps keep the counts from zero up
        use = np.bincount(rows.ravel(), np.repeat(x, 3) * inside.ravel(), len(h))
        x *= ah / np.maximum((use[rows] * inside).sum(1), 1e-9)
    return x


def plan(hist: np.ndarray) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first sequence, offset, pieces side by side), and the number of sequences."""
    size, left = len(hist) - 1, hist.astype(np.int64).copy()
    leaves: list[tuple[int, list]] = []  # sequences filled alike, and their (length, side by side)
    if left[size]:
        leaves.append((int(left[size]), [(size, 1)]))
        left[size] = 0
    rows = patterns(left)
    if len(rows):
        x = fit(rows, left)
        for k in np.argsort(-x, kind="stable"):
            n = int(round(x[k]))
            if n < 1:
                break
            lens, times = np.unique(rows[k][rows[k] > 0], return_counts=True)
            if (n := int(min(n, (left[lens] // times).min()))) > 0:
                left[lens] -= n * times
                leaves.append((n, list(zip(lens.tolist(), times.tolist()))))
    open_: dict[int, list[tuple[int, list]]] = {}
    spaces: list[int] = []  # sorted remaining spaces of open sequences

    def put(space: int, n: int, slots: list) -> None:
        if not n:
            return
        if not space:
            leaves.append((n, slots))
            return
        if space not in open_:
            open_[space] = []
            insort(spaces, space)
        open_[space].append((n, slots))

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            k = bisect_left(spaces, length)
            if k == len(spaces):
                put(size, -(-n // (size // length)), [])
                continue
            space = spaces[k]
            bins, slots = open_[space].pop()
            if not open_[space]:
                del open_[space], spaces[k]
            fit_in = space // length
            full = min(bins, n // fit_in)
            put(space - fit_in * length, full, [*slots, (length, fit_in)])
            n -= full * fit_in
            bins -= full
            if bins and n:  # fewer pieces than one more sequence takes
                put(space - n * length, 1, [*slots, (length, n)])
                n, bins = 0, bins - 1
            put(space, bins, slots)
    leaves += [x for xs in open_.values() for x in xs if x[1]]
    runs, sequence, rank = [], 0, np.zeros(size + 1, np.int64)
    for bins, slots in leaves:
        offset = 0
        for length, side in slots:
            runs.append((length, int(rank[length]), bins * side, sequence, offset, side))
            rank[length] += bins * side
            offset += length * side
        sequence += bins
    return runs, sequence


def place_pieces(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (row_key, piece, length and more) with sequence_id and offset."""
    spark = pieces.sparkSession
    hist = np.zeros(size + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``size`` rows
        hist[r["length"]] = r["count"]
    runs, _ = plan(hist)
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    sent = spark.sparkContext.broadcast(table)  # at most three runs a pattern, PER_LENGTH patterns a length

    salts = max(LEAST_SALTS, int(hist.sum()) // ROWS_PER_SALT)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row_key", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row_key", "piece")) - 1
    ranked = salted.withColumn("nth", nth).join(counts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth")).drop("salt", "before", "nth")
    names = [c for c in ranked.columns if c != "rank"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        keys = t[:, 0] << 44 | t[:, 1]
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            r = t[np.searchsorted(keys, length << 44 | rank, "right") - 1] if len(t) else np.zeros((0, 6), np.int64)
            i = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(r[:, 3] + i // r[:, 5]), pa.array(r[:, 4] + i % r[:, 5] * length)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(look, ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long"))


def with_ids(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """``placed`` with the ids of each piece, little-endian in 4 bytes each. They are packed until then, as they are shuffled."""
    both = placed.join(pieces.select("row_key", "piece", "width", "payload"), ["row_key", "piece"])
    names = [c for c in both.columns if c not in ("width", "payload")]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for b in batches:
            raw = ((w, press.decompress(p, max_output_size=4 * SIZE)) for w, p in zip(b["width"].to_pylist(), b["payload"].to_pylist()))
            ids = [np.frombuffer(r, np.uint16 if w == 2 else np.uint32).astype("<u4").tobytes() for w, r in raw]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(ids, pa.binary())], [*names, "ids"])

    return both.mapInArrow(unpack, both.select(*names).schema.add("ids", "binary"))


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves, of placed pieces with ids: sequence_id and its pieces' ids in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # pieces of one sequence: at most its length
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cut_pieces(read(spark, sf_dir, "documents", "doc_id", "text"), with_ids=False)
    return place_pieces(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: its place and its ids; ``sequences`` joins those of one sequence_id.

    Copies of a document have one doc_id and are told apart by row_key. Null texts have the end id only; null ids stay
    null; other columns of ``docs``, whatever their names, are left behind; an empty table gives no row.
    """
    pieces = cut_pieces(docs)
    return with_ids(place_pieces(pieces.drop("width", "payload")), pieces).select("row_key", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")

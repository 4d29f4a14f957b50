"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

Roles of a repaired conversation are an optional system turn, then user and assistant turns in pairs: an automaton of four
states. Each row is one of nine symbols (must go; or system, user, assistant, other, sound or truncated). The cost of
repairing all that follows, from each state, is a vector of four; less its least entry it is one of a few dozen.

Method (Four Russians). For every block of BLOCK symbols and each of these vectors a table gives the vector before the block and
what is added to it, so a pass from the end takes a block a look-up. Edits are then read from the front: the vectors inside
a block are expanded backward from the one kept at its end, and of the edits that keep the cost least the one whose letter
comes first is taken, so the audit is the least string of all cheapest ones. Forward choices alone couldn't tell ties
apart.

Conversations are sorted over all partitions and cut into segments of bounded rows and bytes. A long conversation's segments
have (min, +) matrices, from four unit vectors in the same tables; chained from the end these give each segment its vector, and
the states that it leaves for each state that it may be entered in give the state it is entered in. So only digests,
which need all bytes in order, pass a conversation through one task, as a stream.

Defined results: rows go by turn, nulls first, equal turns by role and then by the SHA-256 of the text; null role or text is a
blank; a role with another initial than s, u or a (or none) can't be kept; repeated rows are duplicates; a null conv_id is a
conversation; one without rows after damage has zeros and empty texts; an empty table gives an empty result; other columns are
neither read nor kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_GAPS, read, staged

BLOCK = 4
STATES = 4  # nothing yet, after system, after user, after assistant
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}  # (state, role): next state
GOES, PAD, N_SYMBOLS = 0, 9, 10
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 10**6
SEGMENT_ROWS, SEGMENT_BYTES = 8192, 8_000_000
ROWS_A_PART = 200_000
ROLE_NAMES = ("user", "assistant")
INITIALS = "sua"
BLANK, DUPLICATE, CUT_SHORT = 1, 2, 3
FOLLOWS = np.zeros((4, 4), bool)  # initials that may stand side by side
FOLLOWS[[1, 2, 3], [2, 3, 2]] = True
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def inserted(q: int) -> tuple[int, int]:
    """The role (0 user, 1 assistant) that an insertion adds in a state, and the state after it."""
    return (1, 3) if q == 2 else (0, 2)


def closed(w: tuple) -> tuple:
    """Costs from each state when rows may be inserted first."""
    v = list(w)
    for _ in range(STATES):
        v = [min(v[q], INSERT + v[inserted(q)[1]]) for q in range(STATES)]
    return tuple(v)


def row_choices(symbol: int, after: tuple, q: int) -> dict[str, tuple[int, int]]:
    """Edits of a row in state q: letter, (cost of it and all that follows, next state)."""
    out = {"D": (DELETE + after[q], q)}
    if symbol != GOES:
        role, late = (symbol - 1) % 4, TRUNCATED * (symbol > 4)
        if (q, role) in KEPT:
            out["K"] = (late + after[KEPT[q, role]], KEPT[q, role])
        to = inserted(q)[1]
        out["R"] = (REROLE + late + after[to], to)
    return out


def before_row(symbol: int, after: tuple) -> tuple:
    if symbol == PAD:
        return after
    return tuple(min(NEVER, x) for x in closed(tuple(min(c for c, _ in row_choices(symbol, after, q).values()) for q in range(STATES))))


def normal(v: tuple) -> tuple[tuple, int]:
    least = min(v)
    return tuple(x - least if x < NEVER else NEVER for x in v), least


class Tables:
    """Vectors by number, their transitions by symbol and by block, and the edits of a row."""

    def __init__(self) -> None:
        units = [tuple(0 if i == q else NEVER for i in range(STATES)) for q in range(STATES)]
        self.vectors, self.number = [], {}
        todo = [closed((0, NEVER, NEVER, 0)), *units]
        self.end, self.units = 0, list(range(1, STATES + 1))
        steps: list[list[tuple[tuple, int]]] = []
        for v in todo:
            self._add(v)
        while len(steps) < len(self.vectors):
            row = [normal(before_row(s, self.vectors[len(steps)])) for s in range(N_SYMBOLS)]
            steps.append(row)
            for v, _ in row:
                self._add(v)
        n = len(self.vectors)
        self.costs = np.array(self.vectors, np.int64)
        self.one = np.array([[self.number[v] for v, _ in row] for row in steps], np.int32)
        self.one_adds = np.array([[c for _, c in row] for row in steps], np.int32)
        self.block = np.repeat(np.arange(n, dtype=np.int32)[:, None], N_SYMBOLS**BLOCK, axis=1)
        self.adds = np.zeros_like(self.block)
        codes = np.arange(N_SYMBOLS**BLOCK)
        for j in range(BLOCK):  # the block's last symbol first
            s = codes // N_SYMBOLS**j % N_SYMBOLS
            self.adds += self.one_adds[self.block, s]
            self.block = self.one[self.block, s]
        self.edit = np.zeros((n, N_SYMBOLS, STATES), np.uint8)  # 3 * insertions + (0 deleted, 1 kept, 2 new role)
        self.to = np.zeros((n, N_SYMBOLS, STATES), np.uint8)
        for i, v in enumerate(self.vectors):
            for s in range(N_SYMBOLS):
                for q in range(STATES):
                    self.edit[i, s, q], self.to[i, s, q] = self._edits(s, v, q)

    def _add(self, v: tuple) -> None:
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)

    def _edits(self, s: int, after: tuple, q: int) -> tuple[int, int]:
        if s == PAD or min(before_row(s, after)) >= NEVER or before_row(s, after)[q] >= NEVER:
            return 0, q
        before, n = before_row(s, after), 0
        while True:
            found = {x: to for x, (c, to) in row_choices(s, after, q).items() if c == before[q]}
            to = inserted(q)[1]
            if "D" not in found and before[q] == INSERT + before[to]:
                n, q = n + 1, to
                continue
            letter = min(found)
            return 3 * n + "DKR".index(letter), found[letter]


@cache
def tables() -> Tables:
    return Tables()


class Segments:
    """Symbols of many segments, in padded blocks, gone through side by side."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray):
        self.sizes, self.t = sizes, tables()
        self.blocks = -(-sizes // BLOCK)
        self.first = np.cumsum(self.blocks) - self.blocks
        padded = np.full(int(self.blocks.sum()) * BLOCK, PAD, np.int64)
        starts = np.cumsum(sizes) - sizes
        self.at = np.repeat(self.first * BLOCK - starts, sizes) + np.arange(len(symbols))
        padded[self.at] = symbols
        self.symbols = padded.reshape(-1, BLOCK)
        self.codes = self.symbols @ N_SYMBOLS ** np.arange(BLOCK - 1, -1, -1)
        self.order = np.argsort(-self.blocks, kind="stable")  # with k blocks or more: the first some
        self.active = len(sizes) - np.searchsorted(np.sort(self.blocks), np.arange(1, int(self.blocks.max(initial=0)) + 1))

    def backward(self, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors (numbers) after each segment: those before it, what they add, and the vector after each block."""
        v, added, kept = after.copy(), np.zeros(len(after), np.int64), np.zeros(len(self.codes), np.int32)
        last = self.first + self.blocks - 1
        for k, n in enumerate(self.active.tolist()):
            i = self.order[:n]
            at = last[i] - k
            kept[at] = v[i]
            added[i] += self.t.adds[v[i], self.codes[at]]
            v[i] = self.t.block[v[i], self.codes[at]]
        return v, added, kept

    def forward(self, kept: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's edit and the state before it, and the state after each segment."""
        q, t = start.astype(np.int64), self.t
        edits, states = np.zeros(self.symbols.shape, np.uint8), np.zeros(self.symbols.shape, np.uint8)
        for k, n in enumerate(self.active.tolist()):
            i = self.order[:n]
            at = self.first[i] + k
            s = self.symbols[at]
            v = [kept[at]]
            for j in range(BLOCK - 1, 0, -1):
                v.append(t.one[v[-1], s[:, j]])
            now = q[i]
            for j in range(BLOCK):
                edits[at, j], states[at, j] = t.edit[v[BLOCK - 1 - j], s[:, j], now], now
                now = t.to[v[BLOCK - 1 - j], s[:, j], now].astype(np.int64)
            q[i] = now
        return edits.ravel()[self.at], states.ravel()[self.at], q


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32(conv_id:turn) % 20 deals; nulls of role and text are blanks."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds each row's first fault (BLANK, DUPLICATE, CUT_SHORT or 0), its role's place in INITIALS (0: elsewhere) and its symbol."""
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    place = F.struct("turn", "row", "copy")
    again = rows.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    bare = F.btrim("text", F.lit(WORD_GAPS))
    fault = F.when(bare == "", BLANK).when(F.col("first").isNotNull() & (place != F.col("first")), DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT_SHORT).otherwise(0)
    initial = F.when(F.col("role") == "", 0).otherwise(F.instr(F.lit(INITIALS), F.left("role", F.lit(1))))
    rows = rows.withColumn("fault", fault.cast("byte")).withColumn("initial", initial.cast("byte"))
    role = F.when(F.col("initial") == 0, 4).otherwise(F.col("initial"))
    symbol = F.when(F.col("fault").isin(BLANK, DUPLICATE), GOES).when(F.col("fault") == CUT_SHORT, role + 4).otherwise(role)
    return rows.select("conv_id", "turn", "role", "text", "copy", "row", "digest", "fault", "initial", symbol.cast("byte").alias("symbol"))


def segments(rows: DataFrame, n_rows: int) -> DataFrame:
    """One row a segment of a conversation: its texts, roles and symbols in order, and its faults counted.

    ``seg`` orders segments over all conversations; ``opens`` and ``closes`` are the first and last initial.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)["conv_id"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // ROWS_A_PART))
    order = ["conv_id", "turn", "role", "digest", "row", "copy"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None

        def closed_parts(b: pa.RecordBatch, edge: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            off = pa.array(edge, pa.int32())
            b = b.slice(0, int(edge[-1]))
            symbols = pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, off.buffers()[1], pa.py_buffer(b["symbol"].to_numpy(zero_copy_only=False).astype(np.uint8))])
            ids = pa.array(number + np.arange(len(edge) - 1))
            number += len(edge) - 1
            lists = [pa.ListArray.from_arrays(off, b[c]) for c in ("role", "text")]
            fault, initial = b["fault"].to_numpy(), b["initial"].to_numpy()
            odd = np.append(False, ~FOLLOWS[initial[:-1], initial[1:]])
            odd[edge[:-1]] = False
            counts = [pa.array(np.add.reduceat(x.astype(np.int64), edge[:-1])) for x in (fault == BLANK, fault == DUPLICATE, fault == CUT_SHORT, odd)]
            ends = [b["initial"].take(pa.array(x)) for x in (edge[:-1], edge[1:] - 1)]
            return pa.RecordBatch.from_arrays([b["conv_id"].take(pa.array(edge[:-1])), ids, *counts, *ends, symbols, *lists], ["conv_id", "seg", *COUNTS, "opens", "closes", "symbols", "roles", "texts"])

        for b in batches:
            b = b if held is None else pa.concat_batches([held, b])
            if not b.num_rows:
                continue
            conv = b["conv_id"].dictionary_encode(null_encoding="encode").indices.to_numpy()
            new = np.append(True, conv[1:] != conv[:-1])
            bytes_ = pc.binary_length(b["text"]).to_numpy().astype(np.int64)
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(new)))
            ends = np.cumsum(bytes_)
            inside = np.arange(len(new)) - np.repeat(first, size)
            mass = ends - bytes_ - np.repeat(ends[first] - bytes_[first], size)
            for x in (inside // SEGMENT_ROWS, mass // SEGMENT_BYTES):
                new[1:] |= x[1:] != x[:-1]
            edge = np.flatnonzero(new)
            if len(edge) > 1:
                yield closed_parts(b, edge)
            held = b.slice(int(edge[-1]))
        if held is not None and held.num_rows:
            yield closed_parts(held, np.array([0, held.num_rows]))

    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "role", "text", "fault", "initial", "symbol")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return ordered.mapInArrow(cut, f"conv_id {kind}, seg long, {counts}, opens byte, closes byte, symbols binary, roles array<string>, texts array<string>")


def _loaded(b: pa.RecordBatch) -> Segments:
    sizes = pc.binary_length(b["symbols"]).to_numpy().astype(np.int64)
    return Segments(np.frombuffer(b"".join(b["symbols"].to_pylist()), np.uint8), sizes)


def entered(parts: DataFrame) -> DataFrame:
    """(seg, after, start) for segments of conversations that have several: the vector after each, and the state it is entered in."""
    long = parts.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("seg").alias("last")).where("n > 1").select(F.col("conv_id").alias("c"), "last")
    kind = dict(parts.dtypes)["conv_id"]
    some = staged(parts.join(long, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "seg", "symbols"), "repair-long")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        for b in batches:
            s = _loaded(b)
            columns = []
            for u in t.units:
                v, added, _ = s.backward(np.full(len(s.sizes), u, np.int32))
                columns.append(np.minimum(t.costs[v] + added[:, None], NEVER))
            flat = np.stack(columns, axis=2).reshape(len(s.sizes), -1)  # from a state, to a state
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * STATES**2, pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["seg"], lists], ["conv_id", "seg", "costs"])

    def chained(group: pd.DataFrame) -> pd.DataFrame:
        t = tables()
        group = group.sort_values("seg", ascending=False)
        v, out = t.end, []
        for m in group["costs"]:
            out.append(v)
            v = t.number[normal(tuple(np.minimum((np.array(m).reshape(STATES, STATES) + t.costs[v]).min(axis=1), NEVER).tolist()))[0]]
        return pd.DataFrame({"seg": group["seg"], "after": out})

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _loaded(b)
            _, _, kept = s.backward(b["after"].to_numpy().astype(np.int32))
            ends = np.stack([s.forward(kept, np.full(len(s.sizes), q))[2] for q in range(STATES)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1) * STATES, pa.int32()), pa.array(ends.ravel()))
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["seg"], b["after"], lists], ["conv_id", "seg", "after", "ends"])

    def walked(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seg")
        q, out = 0, []
        for ends in group["ends"]:
            out.append(q)
            q = int(ends[q])
        return pd.DataFrame({"seg": group["seg"], "after": group["after"], "start": out})

    costs = some.mapInArrow(matrices, f"conv_id {kind}, seg long, costs array<long>")
    after = costs.groupBy("conv_id").applyInPandas(chained, "seg long, after int")
    ends = some.join(after, "seg").select("conv_id", "seg", "symbols", "after").mapInArrow(leaves, f"conv_id {kind}, seg long, after int, ends array<long>")
    return ends.groupBy("conv_id").applyInPandas(walked, "seg long, after int, start int")


def repair(parts: DataFrame) -> DataFrame:
    """Segments with their edits: (conv_id, seg, whole, audit, cost, roles, texts), the last two repaired.

    ``whole`` tells that the conversation has no other segment.
    """
    kind = dict(parts.dtypes)["conv_id"]
    known = staged(entered(parts), "repair-entered")
    last = parts.groupBy("conv_id").agg(F.max("seg").alias("seg")).select("seg", F.lit(True).alias("last"))
    given = parts.join(known, "seg", "left").join(last, "seg", "left")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        for b in batches:
            if not b.num_rows:
                continue
            s = _loaded(b)
            final = np.asarray(pc.fill_null(b["last"], False))
            _, _, kept = s.backward(pc.fill_null(b["after"], t.end).to_numpy().astype(np.int32))
            edits, states, q = s.forward(kept, pc.fill_null(b["start"], 0).to_numpy())
            # each row: its insertions and its letter; a segment that ends the conversation has a last row of insertions only
            tail = np.where(final, np.array([0, 2, 1, 0])[q], 0)
            edge = np.append(0, np.cumsum(s.sizes))
            ins, act = np.insert(edits // 3, edge[1:], tail).astype(np.int64), np.insert(edits % 3, edge[1:], 3)
            state, row = np.insert(states, edge[1:], q).astype(np.int64), np.insert(np.arange(len(edits)), edge[1:], -1)
            edge = edge + np.arange(len(edge))
            letters, stays = (act != 3).astype(np.int64), np.isin(act, (1, 2)).astype(np.int64)

            def placed(more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """Items of all rows, their insertions first: each one's row, its place there, and the first item of each segment."""
                n = ins + more
                ends = np.cumsum(n)
                of = np.repeat(np.arange(len(n)), n)
                return of, np.arange(len(of)) - (ends - n)[of], np.append(0, ends)[edge]

            of, nth, bounds = placed(letters)
            audit = np.where(nth < ins[of], ord("I"), np.frombuffer(b"DKRI", np.uint8)[act[of]]).astype(np.uint8)
            audits = pa.Array.from_buffers(pa.string(), len(s.sizes), [None, pa.array(bounds, pa.int32()).buffers()[1], pa.py_buffer(audit)])
            late = np.insert(np.frombuffer(b"".join(b["symbols"].to_pylist()), np.uint8) > 4, np.append(0, np.cumsum(s.sizes))[1:], False)
            spent = INSERT * ins + np.array([DELETE, 0, REROLE, 0])[act] + TRUNCATED * (late & (stays > 0))
            of, nth, bounds = placed(stays)
            new = nth < ins[of]
            assistant = (state[of] == 2) ^ (nth % 2 == 1)  # user and assistant take turns from the state on
            roles, texts = b["roles"].flatten(), b["texts"].flatten()
            n = len(roles)
            named = pa.concat_arrays([roles, pa.array(ROLE_NAMES, roles.type)]).take(pa.array(np.where(new | (act[of] == 2), n + assistant, row[of])))
            told = pa.concat_arrays([texts, pa.array([""], texts.type)]).take(pa.array(np.where(new, n, row[of])))
            off = pa.array(bounds, pa.int32())
            cost = np.add.reduceat(spent, edge[:-1])
            yield pa.RecordBatch.from_arrays(
                [b["conv_id"], b["seg"], pc.is_null(b["after"]), audits, pa.array(cost), pa.ListArray.from_arrays(off, named), pa.ListArray.from_arrays(off, told)],
                ["conv_id", "seg", "whole", "audit", "cost", "roles", "texts"],
            )

    return given.select("conv_id", "seg", "symbols", "roles", "texts", "after", "start", "last").mapInArrow(edit, f"conv_id {kind}, seg long, whole boolean, audit string, cost long, roles array<string>, texts array<string>")


def repaired_turns(done: DataFrame) -> DataFrame:
    """(conv_id, seg, at, role, text): the repaired rows, in the order of seg and at."""
    return done.select("conv_id", "seg", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "m")).select("conv_id", "seg", "at", F.col("m.roles").alias("role"), F.col("m.texts").alias("text"))


def chained_sha256(told: DataFrame) -> DataFrame:
    """(conv_id, digest) of rows (conv_id, seg, told): SHA-256 of each conversation's non-empty texts, joined by line feeds, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, conv, begun, out = None, None, False, []
        for b in batches:
            for c, t in zip(b["conv_id"].to_pylist(), b["told"].to_pylist()):
                if sha is None or c != conv:
                    if sha is not None:
                        out.append((conv, sha.hexdigest()))
                    sha, conv, begun = hashlib.sha256(), c, False
                if t:
                    sha.update(b"\n" * begun + t.encode())
                    begun = True
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], b["conv_id"].type), pa.array([x for _, x in out])], ["conv_id", "digest"])
                out = []
        if sha is not None:
            out.append((conv, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], b["conv_id"].type), pa.array([x for _, x in out])], ["conv_id", "digest"])

    return told.repartition("conv_id").sortWithinPartitions("conv_id", "seg").select("conv_id", "told").mapInArrow(run, f"conv_id {dict(told.dtypes)['conv_id']}, digest string")


def repair_report(turns: DataFrame) -> DataFrame:
    """Faults, edits and the digest of the repaired text for every conversation of rows (conv_id, turn, role, text), damaged first."""
    rows = staged(damaged(turns).withColumn("row", F.monotonically_increasing_id()), "repair-damaged")
    parts = staged(segments(with_faults(rows), rows.count()), "repair-segments")
    told = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    done = staged(repair(parts).withColumn("told", told).drop("roles", "texts").withColumn("digest", F.when(F.col("whole"), F.sha2("told", 256))), "repair-done")

    edges = parts.select("conv_id", *COUNTS, "opens", F.lag("closes").over(Window.partitionBy("conv_id").orderBy("seg")).alias("before"))
    joins = F.col("before").isNotNull() & ~F.array_contains(F.array(F.lit(12), F.lit(23), F.lit(32)), F.col("before") * F.lit(10) + F.col("opens"))
    counts = edges.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in COUNTS[:3]), F.sum(F.col("illegal") + joins.cast("long")).alias("illegal"))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "")
    edits = done.groupBy("conv_id").agg(F.sum("cost").alias("cost"), audit.alias("audit"), F.max("digest").alias("digest"))
    long = chained_sha256(done.where(~F.col("whole")).select("conv_id", "seg", "told")).withColumnRenamed("digest", "of_parts")
    turn = F.col("turn").cast("long")
    gaps = rows.groupBy("conv_id").agg((F.max(turn) - F.min(turn) + 1 - F.countDistinct(turn)).alias("gaps"))
    every = turns.select("conv_id").distinct()
    for df, name in ((gaps, "c1"), (counts, "c2"), (edits, "c3"), (long, "c4")):
        every = every.join(df.withColumnRenamed("conv_id", name), F.col("conv_id").eqNullSafe(F.col(name)), "left").drop(name)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.select(
        "conv_id", *(number(c) for c in ("gaps", *COUNTS, "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("of_parts", "digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def _sql_best(*choices: str) -> str:
    return f"list_sort([{', '.join(choices)}])[1]"


def _sql_edit(after: str, letter: str, cost: str, message: str | None) -> str:
    told = f"{message} || CASE WHEN {after}.t = '' THEN '' ELSE chr(10) || {after}.t END" if message else f"{after}.t"
    return f"{{'c': {after}.c + {cost}, 'a': '{letter}' || {after}.a, 't': {told}}}"


def _sql_row(q: int) -> str:
    """The best edit of a row in state q."""
    goes, late = f"(CASE WHEN fault IN ({BLANK}, {DUPLICATE}) THEN {NEVER} ELSE 0 END)", f"(CASE WHEN fault = {CUT_SHORT} THEN {TRUNCATED} ELSE 0 END)"
    role, to = inserted(q)
    kept = [
        _sql_edit(f"v{z}", "K", f"{goes} + {late} + CASE WHEN left(role, 1) = '{INITIALS[r]}' THEN 0 ELSE {NEVER} END", "role || ':' || text") for (p, r), z in KEPT.items() if p == q
    ]
    return _sql_best(_sql_edit(f"v{q}", "D", str(DELETE), None), _sql_edit(f"v{to}", "R", f"{goes} + {late} + {REROLE}", f"'{ROLE_NAMES[role]}:' || text"), *kept)


def _sql_insert(after: str, q: int) -> str:
    return _sql_edit(after, "I", str(INSERT), f"'{ROLE_NAMES[inserted(q)[0]]}:'")


_NOTHING, _BYTES = "{'c': 0, 'a': '', 't': ''}", "list_transform(string_split(key, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])"
_REST_2, _REST_3 = _sql_best("w2", _sql_insert("w3", 2)), _sql_best("w3", _sql_insert("w2", 3))
OP13_SQL = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), h AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten({_BYTES})), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x::BIGINT) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS kind FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM h WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM d
), f AS (
  SELECT conv_id, turn, role, text, i, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN bare = '' THEN {BLANK} WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN {DUPLICATE} WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN {CUT_SHORT} ELSE 0 END AS fault FROM o
), s AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate,
         count(*) FILTER (fault = {CUT_SHORT}) AS truncated, count(*) FILTER (i > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
), v AS (
  SELECT conv_id, n AS i, {_NOTHING} AS v0, {_sql_insert(f"({_sql_insert(_NOTHING, 2)})", 1)} AS v1, {_sql_insert(_NOTHING, 2)} AS v2, {_NOTHING} AS v3 FROM s
  UNION ALL
  SELECT conv_id, i, {_sql_best("w0", _sql_insert("x2", 0))}, {_sql_best("w1", _sql_insert("x2", 1))}, x2, x3 FROM (
    SELECT *, {_REST_2} AS x2, {_REST_3} AS x3 FROM (
      SELECT v.conv_id, v.i - 1 AS i, {", ".join(f"{_sql_row(q)} AS w{q}" for q in range(STATES))} FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i
    )
  )
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(v0.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM a.conv_id AND v.i = 0
"""

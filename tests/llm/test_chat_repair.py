"""Conversation repair against trying every edit, against a plain recursion for long conversations, and in small segments."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import chat_repair as R
from scholia.llm import entries

from .test_operators import folder

TURNS = "conv_id long, turn long, role string, text string"


def damaged(rows):
    for c, t, r, x in rows:
        say = lambda v: " " if v is None else str(v)
        k, r, x = zlib.crc32(f"{say(c)}:{say(t)}".encode()) % 20, say(r), say(x)
        if k:
            yield from [(c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (2 if k == 3 else 1)


def faults(rows):
    """(symbol-free) fault names of rows (turn, role, text) in order."""
    seen, out = set(), []
    for _, r, x in rows:
        bare = x.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        out.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def edits(rows, fault):
    """(cost, audit, repaired text), from the end: for each state the least of all edits."""
    step, roles = {0: "u", 1: "u", 2: "a", 3: "u"}, {"u": "user", "a": "assistant"}
    go = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    never = (10**9, "", ())

    def put(rest, letter, cost, told=None):
        return (rest[0] + cost, letter + rest[1], ((told,) if told is not None else ()) + rest[2])

    def opened(w):
        v = dict(w)
        for _ in range(4):
            v = {q: min(v[q], put(v[go[q, step[q]]], "I", 2, roles[step[q]] + ":")) for q in v}
        return v

    v = opened({0: (0, "", ()), 1: never, 2: never, 3: (0, "", ())})
    for (_, r, x), f in zip(reversed(rows), reversed(fault)):
        late, w = f == "truncated", {}
        for q in v:
            w[q] = put(v[q], "D", 3)
            if f not in ("blank", "duplicate"):
                w[q] = min(w[q], put(v[go[q, step[q]]], "R", 2 + late, f"{roles[step[q]]}:{x}"))
                if (q, r[:1]) in go:
                    w[q] = min(w[q], put(v[go[q, r[:1]]], "K", late, f"{r}:{x}"))
        v = opened(w)
    return v[0]


def wanted(rows):
    by, turns = defaultdict(list), defaultdict(set)
    for c, t, r, x in damaged(rows):
        by[c].append((t, r, x))
    out = {}
    for c in {r[0] for r in rows}:
        ordered = sorted(by[c], key=lambda m: (-1 if m[0] is None else m[0], m[1], hashlib.sha256(m[2].encode()).hexdigest()))
        fault = faults(ordered)
        known = {t for t, *_ in ordered if t is not None}
        cost, audit, told = edits(ordered, fault)
        n = Counter(fault)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(ordered, ordered[1:]))
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        out[c] = (c, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest())
    return out


def talk(seed, n, long=()):
    r = random.Random(seed)
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", None, "uncle", "Ärger"]
    said = ["Yes.", "No", "Why?", "", " \t", None, "Two. Three", "end!\n", "é. ", "long " * 30 + "."]
    rows = []
    for c in range(n):
        for t in range(r.randrange(0, 9)):
            rows.append((c, r.choice([t, t, t, t, None, t + 5]), r.choice(roles), r.choice(said) if r.random() < 0.4 else f"text {r.randrange(10**6)}{r.choice(['.', '', '?'])}"))
    for c, k in long:
        rows += [(c, t, r.choice(roles), f"text {r.randrange(k)}{r.choice(['.', '.', '', '?'])}") for t in range(k)]
    return rows + rows[:7] + [(None, 1, "user", "Hi."), (None, None, "assistant", "x"), (-5, 0, "user", "only.")]


def as_rows(df):
    return {r.conv_id: tuple(r) for r in df.collect()}


def test_recursion_equals_trying_everything():
    r = random.Random(9)
    for _ in range(60):
        rows = [(i, r.choice(["user", "assistant", "system", "tool"]), r.choice([".", "x", "", f"{i}."])) for i in range(r.randrange(0, 4))]
        fault = faults(rows)
        found = []
        for acts in itertools.product("DKua", repeat=len(rows)):
            for ins in itertools.product(range(3), repeat=len(rows) + 1):
                audit, cost, letters = "", 0, ""
                spots = []
                for i in range(len(rows) + 1):
                    audit, cost = audit + "I" * ins[i], cost + 2 * ins[i]
                    spots += ["?"] * ins[i]
                    if i < len(rows):
                        a = acts[i]
                        audit += "R" if a in "ua" else a
                        cost += 3 if a == "D" else (2 if a in "ua" else 0) + (fault[i] == "truncated")
                        if a != "D":
                            spots.append(rows[i][1][0] if a == "K" else a)
                if any(a != "D" and f in ("blank", "duplicate") for a, f in zip(acts, fault)):
                    continue
                if re.fullmatch("([s]?([u?][a?])+)?", "".join(spots)):
                    found.append((cost, audit))
        assert min(found) == edits(rows, fault)[:2]


def test_tables_agree_with_steps():
    t = R.tables()
    r = np.random.default_rng(2)
    for _ in range(50):
        s = r.integers(0, R.PAD, r.integers(1, 30))
        v, added = t.end, 0
        for x in s[::-1]:
            added, v = added + t.one_adds[v, x], t.one[v, x]
        got = R.Segments(s, np.array([len(s)])).backward(np.array([t.end], np.int32))
        assert (got[0][0], got[1][0]) == (v, added)


@pytest.mark.parametrize("rows_a_segment", [8192, 3])
def test_report(spark, monkeypatch, rows_a_segment):
    monkeypatch.setattr(R, "SEGMENT_ROWS", rows_a_segment)
    rows = talk(1, 120, [(1000, 700), (1001, 41)])
    assert as_rows(R.repair_report(spark.createDataFrame(rows, TURNS).repartition(3))) == wanted(rows)


def test_small_batches_and_bytes(spark, monkeypatch):
    monkeypatch.setattr(R, "SEGMENT_BYTES", 50)
    monkeypatch.setattr(R, "ROWS_A_PART", 40)
    rows = talk(2, 30, [(7000, 300)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert as_rows(R.repair_report(spark.createDataFrame(rows, TURNS))) == wanted(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "B."), (1, 2, "user", "C.")]
    df = spark.createDataFrame(rows, TURNS).withColumn("copy", F.lit(0)).withColumn("row", F.monotonically_increasing_id())
    done = R.repair(R.segments(R.with_faults(df), 3))
    got = [(r.role, r.text) for r in R.repaired_turns(done).orderBy("conv_id", "seg", "at").collect()]
    cost, audit, told = edits([(t, r, x) for _, t, r, x in rows], ["", "", ""])
    parts = done.orderBy("seg").collect()
    assert (sum(p.cost for p in parts), "".join(p.audit for p in parts), tuple(f"{r}:{x}" for r, x in got)) == (cost, audit, told)


def test_query_with_other_columns(spark, tmp_path):
    rows = talk(3, 40)
    d = folder(spark, tmp_path, conversations=([(*r, "x", 1) for r in rows], TURNS + ", seg string, fault long"))
    assert as_rows(entries.QUERIES["op13_chat_repair"](spark, d)) == wanted(rows)

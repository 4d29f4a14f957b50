"""Practice sessions as batch and as stream, after restarts and replays, and the event log's state."""

import random

import pytest
from pyspark.sql import functions as F

from scholia.streaming import reviews, sessions

SCHEMA = "user_id long, seq long, kind string, session_id long, exercise_ids array<long>, exercise_id long, quality int"


def start(seq, sid, ids, user=1):
    return (user, seq, "start", sid, ids, None, None)


def answer(seq, sid, ex, quality, user=1):
    return (user, seq, "answer", sid, None, ex, quality)


def status(seq, sid, kind, user=1):
    return (user, seq, kind, sid, None, None, None)


def states(df):
    return {(r.user_id, r.session_id): (r.status, r.current_index, r.mastered, r.struggling, r.updated, r.ended) for r in df.collect()}


CASES = [
    # pause, resume, two answers, done; a replayed answer and a status after the end change nothing
    ([start(1, 10, [7, 8]), status(2, 10, "paused"), answer(3, 10, 7, 5), status(4, 10, "active"), answer(5, 10, 7, 1), answer(6, 10, 7, 5), answer(7, 10, 8, 9), answer(8, 10, 8, 0), status(9, 10, "paused")],
     {(1, 10): ("completed", 2, 1, 1, 7, 7)}),
    # a start replaces the open session that changed last, paused ones too; an empty list only replaces
    ([start(1, 10, [7]), start(2, 11, [7]), status(3, 10, "paused"), start(4, 12, [1]), start(5, 13, [])],
     {(1, 10): ("replaced", 0, 0, 0, 4, 4), (1, 11): ("active", 0, 0, 0, 2, None), (1, 12): ("replaced", 0, 0, 0, 5, 5)}),
    # wrong exercise, unknown session, unknown kind, known id, an exercise listed twice
    ([start(1, 10, [7, 7, 8]), answer(2, 10, 8, 5), answer(3, 99, 7, 5), status(4, 10, "lost"), answer(5, 10, 7, 3), answer(6, 10, 7, 3), start(7, 10, [1])],
     {(1, 10): ("active", 1, 0, 0, 5, None)}),
    ([start(1, 10, [7]), status(2, 10, "abandoned"), answer(3, 10, 7, 5), status(4, 10, "active"), answer(5, 10, 7, 2)], {(1, 10): ("completed", 1, 0, 1, 5, 5)}),
]


@pytest.mark.parametrize("events, want", CASES)
def test_cases(spark, events, want):
    assert states(sessions.session_states(spark.createDataFrame(events[::-1] + events, SCHEMA))) == want


def many(seed, n):
    r = random.Random(seed)
    out, seen = [], {}
    for seq in range(n):
        u = r.randrange(12)
        sid = r.choice(seen.get(u, [0])) if r.random() < 0.7 else seen.get(u, [0])[-1]
        k = r.random()
        if k < 0.15:
            out.append(start(seq, seq, [r.randrange(3) for _ in range(r.randrange(4))], u))
            seen.setdefault(u, []).append(seq)
        elif k < 0.8:
            out.append(answer(seq, sid, r.randrange(3), r.randrange(-1, 8), u))
        else:
            out.append(status(seq, sid, r.choice(["active", "paused", "abandoned", "other"]), u))
    return out


def test_stream_equals_batch_over_restart_failure_and_replay(spark, tmp_path, monkeypatch):
    rows = many(1, 900)
    src, kept, state = (str(tmp_path / x) for x in ("src", "kept", "state"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    write = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    write(rows[:300])
    sessions.run_sessions(stream(), kept, state)
    write(rows[300:600])
    real = sessions.stream_sessions

    def broken(events):
        raise_at = F.raise_error(F.lit("lost"))
        return real(events).withColumn("status", F.when(F.col("updated") >= 0, raise_at).otherwise(F.col("status")))

    monkeypatch.setattr(sessions, "stream_sessions", broken)
    with pytest.raises(Exception, match="lost"):
        sessions.run_sessions(stream(), kept, state)
    monkeypatch.setattr(sessions, "stream_sessions", real)
    write(rows[100:700])  # some again, some new
    write(rows[600:])
    write(rows)
    sessions.run_sessions(stream(), kept, state)
    got = states(sessions.latest_states(spark.read.schema(f"{sessions.STATES}, batch int").parquet(kept)))
    # rows[600:700] came with the repeats, before the rest
    assert got == states(sessions.session_states(spark.createDataFrame(rows, SCHEMA)))


def test_latest_open(spark):
    d = sessions.session_states(spark.createDataFrame([start(1, 10, [7]), start(2, 11, [7]), status(3, 10, "active"), start(1, 5, [1], 2), answer(2, 5, 1, 4, 2)], SCHEMA))
    assert [(r.user_id, r.session_id) for r in sessions.latest_open(d).collect()] == [(1, 10)]


def test_log_looks_up_only_a_batch_s_ids(spark, tmp_path):
    """State look-ups stay level while the log grows; late repeats are ignored; a foreign log is refused."""
    src, log, state = (str(tmp_path / x) for x in ("src", "log", "state"))
    n, size = 12, 40
    for i in range(n):
        old = random.Random(i).sample(range(i * size), min(i * size, 10))
        spark.createDataFrame([(x,) for x in [*range(i * size, (i + 1) * size), *old]], "id long").coalesce(1).write.mode("append").parquet(src)
    q = reviews.append_stream(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src), log, state)
    ids = [r.id for r in spark.read.parquet(log).collect()]
    assert sorted(ids) == list(range(n * size))
    gets = [p["stateOperators"][0]["customMetrics"].get("rocksdbGetCount") for p in q.recentProgress if p["numInputRows"]]
    assert len(gets) == n and max(gets[2:]) <= 2 * gets[1]
    with pytest.raises(ValueError):
        reviews.append_stream(spark.readStream.schema("id long").parquet(src), log, str(tmp_path / "another"))

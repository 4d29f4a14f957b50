"""Practice sessions as a state machine over each user's events, as a batch or as a stream.

Events: user_id, seq, kind, session_id, exercise_ids, exercise_id, quality. Kinds:

* ``start``: the user's latest open session (active or paused) is replaced; a session begins, unless its list is empty or its id known.
* ``answer``: counts if the session is active and the exercise is the current one; an exercise answered before is a replay.
* ``active``, ``paused``, ``abandoned``: sets the status of a session that isn't completed.

Anything else changes nothing, nor does an event whose seq isn't above the user's last one. Both forms give the same states.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .reviews import use_disk_state

OPEN, SETTABLE = ("active", "paused"), ("active", "paused", "abandoned")
SESSION = "status string, exercise_ids array<long>, current_index int, mastered int, struggling int, updated long, ended long"
STATES = f"user_id long, session_id long, {SESSION}"
EVENTS = ("user_id", "seq", "kind", "session_id", "exercise_ids", "exercise_id", "quality")
FIELDS = ("status", "exercise_ids", "current_index", "mastered", "struggling", "updated", "ended")


def advance(sessions: dict[int, dict[str, Any]], e: Any) -> list[int]:
    """Applies one event to a user's sessions; the ids of those that changed."""
    s = sessions.get(e.session_id)
    if e.kind == "start":
        if s is not None:
            return []
        changed = []
        opened = [(x["updated"], i) for i, x in sessions.items() if x["status"] in OPEN]
        if opened:
            before = max(opened)[1]
            sessions[before].update(status="replaced", updated=e.seq, ended=e.seq)
            changed.append(before)
        ids = [int(x) for x in e.exercise_ids] if e.exercise_ids is not None else []
        if ids:
            sessions[e.session_id] = dict(status="active", exercise_ids=ids, current_index=0, mastered=0, struggling=0, updated=e.seq, ended=None)
            changed.append(e.session_id)
        return changed
    if s is None:
        return []
    if e.kind == "answer":
        at, ids = s["current_index"], s["exercise_ids"]
        if s["status"] != "active" or at >= len(ids) or ids[at] != e.exercise_id or e.exercise_id in ids[:at]:
            return []
        q = max(0, min(5, int(e.quality)))
        s.update(current_index=at + 1, mastered=s["mastered"] + (q >= 4), struggling=s["struggling"] + (q < 3), updated=e.seq)
        if at + 1 == len(ids):
            s.update(status="completed", ended=e.seq)
        return [e.session_id]
    if e.kind in SETTABLE and s["status"] != "completed":
        s.update(status=e.kind, updated=e.seq, ended=e.seq if e.kind == "abandoned" else s["ended"])
        return [e.session_id]
    return []


def session_states(events: DataFrame) -> DataFrame:
    """The state of every session after all events. Users stream through the tasks in order of seq; no user's events are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, last, sessions, begun = None, None, {}, False
        names = ["user_id", "session_id", *FIELDS]

        def told() -> pa.RecordBatch:
            schema = pa.schema([("user_id", pa.int64()), ("session_id", pa.int64()), ("status", pa.string()), ("exercise_ids", pa.list_(pa.int64())), *((c, pa.int32()) for c in FIELDS[2:5]), ("updated", pa.int64()), ("ended", pa.int64())])
            return pa.RecordBatch.from_pylist([dict(zip(names, (user, i, *(s[c] for c in FIELDS)))) for i, s in sessions.items()], schema)

        for b in batches:
            for values in zip(*(b[c].to_pylist() for c in EVENTS)):
                e = Row(*EVENTS)(*values)
                if not begun or e.user_id != user:
                    if sessions:
                        yield told()
                    user, last, sessions, begun = e.user_id, None, {}, True
                if last is None or e.seq > last:
                    advance(sessions, e)
                    last = e.seq
        if sessions:
            yield told()

    e = events.select(*EVENTS).where("seq is not null and session_id is not null")
    return e.repartition("user_id").sortWithinPartitions("user_id", "seq").mapInArrow(run, STATES)


class Sessions(StatefulProcessor):
    """Keeps a user's sessions by id, and the last seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getMapState("sessions", "session_id long", SESSION)
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seen = self.last.get()[0] if self.last.exists() else None
        events = pd.concat(rows)
        if seen is not None:
            events = events[events["seq"] > seen]
            if events.empty:  # a replay changes nothing and needs no sessions
                return
        sessions = {k[0]: dict(zip(FIELDS, (v[0], list(v[1]), *v[2:]))) for k, v in self.sessions.iterator()}
        changed: set[int] = set()
        events = events.sort_values("seq", kind="stable")
        for values in events[list(EVENTS)].astype(object).where(events[list(EVENTS)].notna(), None).itertuples(index=False):
            if seen is None or values.seq > seen:
                changed.update(advance(sessions, values))
                seen = int(values.seq)
        for i in changed:
            s = sessions[i]
            self.sessions.updateValue((int(i),), tuple(int(s[c]) if c in FIELDS[2:6] else s[c] if c != "ended" or s[c] is None else int(s[c]) for c in FIELDS))
        if seen is not None:
            self.last.update((int(seen),))
        out = pd.DataFrame([(key[0], i, *(sessions[i][c] for c in FIELDS)) for i in sorted(changed)], columns=["user_id", "session_id", *FIELDS])
        yield out.astype({c: "Int64" for c in ("user_id", "session_id", "updated", "ended")} | {c: "Int32" for c in FIELDS[2:5]})

    def close(self) -> None:
        pass


def stream_sessions(events: DataFrame) -> DataFrame:
    """Sessions that change in each batch of a stream of events; the state store must be one that keeps maps (RocksDB)."""
    use_disk_state(events.sparkSession)
    e = events.select(*EVENTS).where("seq is not null and session_id is not null and user_id is not null")
    return e.groupBy("user_id").transformWithStateInPandas(Sessions(), STATES, "Update", "None")


def run_sessions(events: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream of events over what there is; a batch that is run again after a failure overwrites its own folder."""

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    q = stream_sessions(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()


def latest_states(changes: DataFrame) -> DataFrame:
    """The last state of each session from the rows (with ``batch``) that ``run_sessions`` kept."""
    last = changes.groupBy("user_id", "session_id").agg(F.max_by(F.struct(*FIELDS), "batch").alias("s"))
    return last.select("user_id", "session_id", "s.*")


def latest_open(states: DataFrame) -> DataFrame:
    """Each user's open session that changed last, which the next start replaces."""
    w = Window.partitionBy("user_id").orderBy(F.desc("updated"), F.desc("session_id"))
    return states.where(F.col("status").isin(*OPEN)).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")

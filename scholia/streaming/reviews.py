"""Streams of learning events: an insert-or-ignore log, daily counts, and review state that advances by one answer.

The same functions work on batches; the batch forms are in ``scholia.operators``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scholia.sources.tables import exists

STATE = "easiness double, interval long, repetitions int, last_seq long"
OUT = "user_id long, card_id long, easiness double, interval long, repetitions int, last_seq long"


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_disk_state(spark: SparkSession) -> None:
    """State on the executors' disks with changes written to the checkpoint, so it may outgrow memory and survives lost executors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def append_stream(events: DataFrame, path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Runs a stream of events into the log at ``path``: an id is inserted once and ignored ever after, however late it comes again.

    Known ids are keyed state: a batch looks up its own ids and reads nothing of the log, however long that is. A log belongs to
    its checkpoint; one begun under another is refused, as its ids aren't known. A batch that is run again after a failure
    overwrites its own folder. The first of several rows with one id in a batch stays; null is an id like others.
    """
    spark = events.sparkSession
    if exists(spark, path) and not exists(spark, checkpoint):
        raise ValueError(f"{path} was begun under another checkpoint")
    use_disk_state(spark)

    def insert(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    q = events.dropDuplicates([key]).writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def stream_daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by day and type; a day is given out when the watermark passes it."""
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.to_date(F.col("window.start")).alias("day"), "event_type", "n")


def advance(state: tuple, quality: int) -> tuple:
    """One review on (easiness, interval, repetitions)."""
    easiness, interval, reps = state
    q = max(0, min(5, int(quality)))
    if q >= 3:
        interval, reps = (1 if reps == 0 else 6 if reps == 1 else round(interval * easiness)), reps + 1
    else:
        interval, reps = 1, 0
    return max(1.3, easiness + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)), interval, reps


def stream_reviews(reviews: DataFrame) -> DataFrame:
    """State of each (user_id, card_id) after each batch of reviews (user_id, card_id, seq, quality).

    A review whose seq isn't above the last one has been seen: a replay changes nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = tuple(state.get) if state.exists else (2.5, 1, 0, -1)
        rows = pd.concat(batches).sort_values("seq")
        cur, last = s[:3], s[3]
        for seq, q in zip(rows["seq"], rows["quality"]):
            if seq > last:
                cur, last = advance(cur, q), int(seq)
        state.update((*cur, last))
        yield pd.DataFrame([(*key, *cur, last)], columns=["user_id", "card_id", "easiness", "interval", "repetitions", "last_seq"])

    return reviews.groupBy("user_id", "card_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what there is and stops; the file sink and its log make a rerun exact."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()

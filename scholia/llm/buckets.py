"""Bucketed comparison: large buckets are split into pairs of parts, so that no task gets an unbounded group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_parts(rows: DataFrame, key: list[str], item: str, part: int) -> DataFrame:
    """Rows of buckets with two rows or more, with ``own``, ``lo`` and ``hi``, dealt and sorted by bucket and part pair.

    A bucket of more than ``part`` rows is cut by a hash of ``item``; each of its rows goes to every pair of parts that
    has its own, so that all pairs of rows meet. A pair of parts has some 2 * ``part`` rows; a bucket of n rows is copied
    n / ``part`` times, so parts are as large as a task's memory lets them be.
    """
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key, F.ceil(F.col("n") / part).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64(item, F.lit(7)), F.col("parts")).cast("int")
    met = rows.join(sizes, key).withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.withColumn("lo", F.least("own", "with")).withColumn("hi", F.greatest("own", "with")).drop("with", "parts")


def dealt(rows: DataFrame, key: list[str]) -> DataFrame:
    by = [*key, "lo", "hi"]
    return rows.repartition(*by).sortWithinPartitions(*by)


def group_bounds(t: pa.Table, key: list[str]) -> np.ndarray:
    """The first row of each group of a sorted table, and the end."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in key:
        v = t[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str], least: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end where a group ends, with the first row of each group and the end; rows come sorted by group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= least:
            t = pa.Table.from_batches(held).combine_chunks()
            at = group_bounds(t, key)
            if len(at) > 2:
                yield t.slice(0, at[-2]), at[:-1]
                held = t.slice(at[-2]).to_batches()
            else:
                held = t.to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        if t.num_rows:
            yield t, group_bounds(t, key)


def groups_in_parts(batches: Iterator[pa.RecordBatch], key: list[str], least: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray, bool, bool]]:
    """As ``whole_groups``, but a group of more than ``least`` rows comes in several tables, so memory is bounded.

    The flags tell whether a table goes on with the group of the one before, and whether its group goes on in the next.
    """
    open_, last = False, None
    for t, at in _tables(batches, key, least):
        first = tuple(t[k][0].as_py() for k in key)
        if open_ and first != last:
            open_ = False
        last = tuple(t[k][t.num_rows - 1].as_py() for k in key)
        yield t, at, open_, len(at) == 2 and t.num_rows >= least
        open_ = len(at) == 2 and t.num_rows >= least


def _tables(batches: Iterator[pa.RecordBatch], key: list[str], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end where a group ends or, within a group, after ``least`` rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        at = group_bounds(t, key)
        if len(at) > 2:
            yield t.slice(0, at[-2]), at[:-1]
            held = t.slice(at[-2]).to_batches()
        else:
            yield t, at
            held = []
    if sum(x.num_rows for x in held):
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, group_bounds(t, key)


def least_labels(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n rows the least id that pairs (a, b) of rows lead to."""
    label = ids.copy()
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            break
        label = new
    return label

"""Embedding near-duplicates by cross-polytope hashing.

Method. Equal vectors of one label are one class. A class's vector is turned by three rounds of random signs and a fast
Hadamard transform; the index and sign of its largest coordinate is one hash, and some hashes together make its bucket in one
of several tables. Each class also asks in the bucket that its nearest second choice gives (multiprobe). Classes that meet
are verified by their cosine in double precision, some hundred rows against a part at a time. A pair may meet in several buckets
and counts in the first of them alone, which each task works out from the two vectors, so links are counted without a table or
a list of all pairs; spanning links give the components. More hashes to a table are used as labels grow, to keep buckets small, and with them more tables, so that
pairs at the threshold still meet with a chance of RECALL (see ``tables_for``).

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without label or id,
have no links and are their own component; vectors of different lengths don't link; repeated rows count as vectors; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import dealt, in_parts, least_labels, whole_groups
from .common import connected_components, read

THRESHOLD = 0.93
LEAST_TABLES = 12
RECALL = 0.97
BUCKET = 32
PART = 4096
ROWS_AT_ONCE = 256  # rows that are compared with a whole part at once
PAIRS = 500_000  # linked pairs that wait to be counted, beside those of one block
SEED = 20


def _turned(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of ``x`` after three rounds of signs and a Hadamard transform; the width is a power of two."""
    for s in signs:
        x = x * s
        h = 1
        while h < x.shape[1]:
            y = x.reshape(len(x), -1, 2, h)
            x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), -1)
            h *= 2
    return x


def codes(x: np.ndarray, hashes: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row and table its bucket, and the bucket that its nearest second choice gives."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng([SEED, width]).choice([-1.0, 1.0], (tables, hashes, 3, width))
    base, probe = (np.zeros((len(x), tables), np.int64) for _ in range(2))
    for t in range(tables):
        firsts, seconds, losses = [], [], []
        for k in range(hashes):
            y = _turned(x, signs[t, k])
            two = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            v = np.take_along_axis(y, two, 1)
            swap = np.abs(v[:, 0]) < np.abs(v[:, 1])
            two[swap], v[swap] = two[swap][:, ::-1], v[swap][:, ::-1]
            c = 2 * two + (v < 0)
            firsts.append(c[:, 0])
            seconds.append(c[:, 1])
            losses.append(np.abs(v[:, 0]) - np.abs(v[:, 1]))
        least = np.argmin(losses, axis=0)
        for k in range(hashes):
            base[:, t] = base[:, t] * (2 * width) + firsts[k]
            probe[:, t] = probe[:, t] * (2 * width) + np.where(least == k, seconds[k], firsts[k])
    return base, probe


def tables_for(dim: int, hashes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Tables in which pairs of vectors at the threshold, the hardest ones, meet with a chance of ``recall``; by trial of drawn pairs."""
    rng, tried = np.random.default_rng(SEED), 16
    x, z = rng.normal(size=(2, max(200, (1 << 16) // dim), max(2, dim)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= x * (x * z).sum(1, keepdims=True)
    y = threshold * x + math.sqrt(1 - threshold * threshold) * z / np.linalg.norm(z, axis=1, keepdims=True)
    (bx, px), (by, py) = codes(x, hashes, tried), codes(y, hashes, tried)
    meet = ((bx == by) | (px == by) | (bx == py)).mean()
    return max(LEAST_TABLES, math.ceil(math.log(1 - recall) / math.log(max(1e-9, 1 - min(meet, 1 - 1e-9)))))


def _matrix(b, name: str = "embedding") -> np.ndarray:
    col = b[name]
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _hashed(hashes: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b["dim"].to_numpy()
            for d in np.unique(dims):
                rows = b.filter(pa.array(dims == d))
                base, probe = codes(_matrix(rows), hashes, tables)
                n = rows.num_rows * tables
                node = np.repeat(rows["node"].to_numpy(), tables)
                label = np.repeat(rows["label"].to_numpy(), tables)
                table = np.tile(np.arange(tables, dtype=np.int32), rows.num_rows)
                both = [np.concatenate([v, v]) for v in (node, label, np.full(n, d, np.int32), table)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, both), pa.array(np.concatenate([base.ravel(), probe.ravel()])), pa.array(np.repeat([True, False], n))], ["node", "label", "dim", "tab", "bucket", "base"])

    return run


class _Links:
    """Links of a table's rows, from pairs of rows that come in bounded numbers; hashes are worked out once a row that has a pair."""

    def __init__(self, x: np.ndarray, node: np.ndarray, copies: np.ndarray, table: np.ndarray, bucket: np.ndarray, hashes: int, tables: int):
        self.x, self.node, self.copies, self.table, self.bucket, self.hashes, self.tables = x, node, copies, table, bucket, hashes, tables
        n = len(node)
        self.links, self.rep, self.order = np.zeros(n, np.int64), np.arange(n), np.argsort(node, kind="stable")
        self.known, self.code_of, self.base, self.probe = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros((0, tables), np.int64), np.zeros((0, tables), np.int64)

    def _first_here(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs, i having the lesser node, that meet first in the bucket and table that their rows are in.

        Pairs that met in an earlier table drop out table by table, most of them after the first.
        """
        some = np.unique(np.concatenate([i, j]))
        new = some[~self.known[some]]
        if len(new):
            more = codes(self.x[new], self.hashes, self.tables)
            self.code_of[new], self.known[new] = len(self.base) + np.arange(len(new)), True
            self.base, self.probe = np.concatenate([self.base, more[0]]), np.concatenate([self.probe, more[1]])
        ci, cj, table = self.code_of[i], self.code_of[j], self.table[i]
        for t in range(int(table.max(initial=0))):
            x, y = self.base[ci, t], self.base[cj, t]
            new = (table <= t) | (x != y) & (self.probe[ci, t] != y) & (x != self.probe[cj, t])
            i, j, ci, cj, table = i[new], j[new], ci[new], cj[new], table[new]
        x, y = self.base[ci, table], self.base[cj, table]
        here = np.where(x == y, x, np.where(self.probe[ci, table] == y, y, x)) == self.bucket[i]
        return i[here], j[here]

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        swap = self.node[i] > self.node[j]
        i, j = self._first_here(np.where(swap, j, i), np.where(swap, i, j))
        if len(i):
            n = len(self.node)
            self.links += np.bincount(i, self.copies[j], n).astype(np.int64) + np.bincount(j, self.copies[i], n).astype(np.int64)
            label = least_labels(n, np.concatenate([i, np.arange(n)]), np.concatenate([j, self.rep]), self.node)
            self.rep = self.order[np.searchsorted(self.node[self.order], label)]

    def least(self) -> np.ndarray:
        """The least node that each row's pairs lead to."""
        return self.node[self.rep]


def _verified(hashes: int, tables: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["label", "dim", "tab", "bucket", "lo", "hi"]):
            dim = t["dim"].to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, dim[1:] != dim[:-1])), len(dim))
            for d0, d1 in zip(edges[:-1].tolist(), edges[1:].tolist()):  # rows of one width
                g = t.slice(d0, d1 - d0)
                node, copies, is_base, own, lo, hi, tab, bucket = (g[c].to_numpy() for c in ("node", "copies", "base", "own", "lo", "hi", "tab", "bucket"))
                x = _matrix(g)
                norm = np.linalg.norm(x, axis=1)
                found, held, n_held = _Links(x, node, copies, tab, bucket, hashes, tables), [], 0
                for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
                    if not d0 <= a < d1:
                        continue
                    a, z = a - d0, z - d0
                    r = np.arange(a, z)
                    one = lo[a] == hi[a]
                    ask, told = (r, r) if one else (r[own[a:z] == lo[a]], r[own[a:z] == hi[a]])
                    for s in range(0, len(ask), ROWS_AT_ONCE):
                        some = ask[s : s + ROWS_AT_ONCE]
                        near = x[some] @ x[told].T
                        near /= norm[some][:, None]
                        near /= norm[told]
                        i, j = np.nonzero(near >= threshold)
                        i, j = some[i], told[j]
                        ok = (is_base[i] | is_base[j]) & ((i < j) if one else (i != j)) & (node[i] != node[j])
                        held.append((i[ok], j[ok]))
                        n_held += len(held[-1][0])
                        if n_held >= PAIRS:
                            found.add(*map(np.concatenate, zip(*held)))
                            held, n_held = [], 0
                if n_held:
                    found.add(*map(np.concatenate, zip(*held)))
                links, least = found.links, found.least()
                on = (links > 0) | (least != node)
                if on.any():
                    yield pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(links[on]), pa.array(least[on])], ["node", "links", "least"])

    return run


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda v: v != 0), F.lit(False))


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of rows (vec_id, embedding, label)."""
    vectors = vectors.select("vec_id", "embedding", "label")
    good = vectors.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("embedding")).checkpoint()
    top = classes.groupBy("label", "dim").count().agg(F.max("count"), F.max("dim")).first()
    hashes, tables = 1, LEAST_TABLES
    if top[0]:
        hashes = max(1, math.ceil(math.log(max(2, top[0] / BUCKET)) / math.log(2 << max(1, (top[1] - 1).bit_length()))))
        tables = tables_for(top[1], hashes, threshold)  # more dimensions meet less often
    rows = classes.select("node", "label", "dim", "embedding").mapInArrow(_hashed(hashes, tables), f"node long, label {classes.schema['label'].dataType.simpleString()}, dim int, tab int, bucket long, base boolean")
    key = ["label", "dim", "tab", "bucket"]
    met = in_parts(rows, key, "node", PART).join(classes.select("node", "copies", "embedding"), "node")
    met = dealt(met, key).select(*key, "lo", "hi", "own", "node", "base", "copies", "embedding")
    found = met.mapInArrow(_verified(hashes, tables, threshold), "node long, links long, least long").checkpoint()
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(links, "node", "left").join(parts, "node", "left")
    named = named.select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    joined = vectors.join(named, usable(F.col("embedding")) & F.col("vec_id").isNotNull() & (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


OP6_SQL = f"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}
), r AS (
  SELECT vec_id AS v, vec_id AS m FROM embeddings UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.v
)
SELECT v AS vec_id, coalesce(n, 0)::BIGINT AS n_links, min(m) AS component_id, v = min(m) AS kept FROM r LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) c ON c.a = v GROUP BY v, n
"""

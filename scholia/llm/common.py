"""What several operators share: words, scratch tables, and connected components.

Scratch tables are Parquet under the folder named by ``spark.checkpoint.dir``, which every executor
can read, so a lost executor costs a re-run of tasks and never data. Only a local session (tests)
may lack that setting; a temporary folder is then made and set once.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAPS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-scholia-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and stops recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``fn``, even inside later lambdas."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def words(text: Column) -> Column:
    """The maximal runs of characters other than space and U+0009 to U+000D; null gives none."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_GAPS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP)),
    )


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The array of op(values up to each place), for long values from 0 and a sum or a greatest.

    An array grown by appending is copied at each step; here blocks of some root of the length are grown, so n values take
    n * sqrt(n) copies of a reference.
    """
    none = F.array().cast("array<bigint>")
    side = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values)))).cast("int")

    def grown(p: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
        step = lambda a, x: F.struct(op(a["at"], x).alias("at"), F.array_append(a["out"], op(a["at"], x)).alias("out"))
        return F.aggregate(p, zero, step, lambda a: a["out"])

    def joined(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("out"))

        def step(a: Column, b: Column) -> Column:
            return F.struct(op(a["at"], F.element_at(b, -1)).alias("at"), F.array_append(a["out"], F.transform(b, lambda v: op(a["at"], v))).alias("out"))

        return F.aggregate(blocks, zero, step, lambda a: F.flatten(a["out"]))

    blocks = F.transform(F.sequence(F.lit(0), F.size(values) - 1, side), lambda i: grown(F.slice(values, i + 1, side)))
    return F.when(F.size(values) == 0, none).otherwise(joined(blocks))


BLOCK_CHARS = 1024


def text_blocks(text: Column) -> Column:
    """The text in pieces of BLOCK_CHARS characters, from which ``cut`` takes stretches without a walk from the text's start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start to end (from 0, end exclusive) of a text in blocks."""
    first = F.floor(start / BLOCK_CHARS)
    near = F.slice(blocks, (first + 1).cast("int"), (F.floor(end / BLOCK_CHARS) - first + 1).cast("int"))
    return F.substring(F.array_join(near, ""), (start - first * BLOCK_CHARS + 1).cast("int"), (end - start).cast("int"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph with long-valued columns ``a`` and ``b``.

    Alternates large-star and small-star steps until the edges stay the same; each node then hangs on
    the smallest node of its component. Every step is a map-side combined minimum and an equi-join
    that Spark may split on skew; no neighbourhood is gathered. Each round is written to the shared
    folder. Rounds grow with the logarithm of the longest path; they go on until nothing changes. Nodes come only from edges; the root itself is included.
    """
    spark = edges.sparkSession
    shared_dir(spark)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())

    def star(both: DataFrame, least: DataFrame, keep: Column) -> DataFrame:
        return both.join(least, "u").where(keep)

    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    seen = mark(cur)
    while seen[0]:
        # large star: every larger neighbour moves to the least of the closed neighbourhood
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = star(both, least, F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every smaller neighbour, and the node, move to the least of them
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u"), F.col("m")))
        cur = small.where("a <> b").distinct().checkpoint()
        now = mark(cur)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(cur.select(F.col("b"), F.col("b")).distinct())

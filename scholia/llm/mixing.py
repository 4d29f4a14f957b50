"""Mixing sources to target weights by hash-threshold histograms.

Method. A document's size is its number of words, its place a 48-bit hash of its id. Each source has a target;
whole multiples of the source are taken as full repeats, the rest by a threshold: the documents whose hash lies
below it are taken once more. Sizes are summed by source and the top 12 bits of the hash, running sums find the
bucket in which the budget ends, and only that bucket is summed again by the next 12 bits, four times in all; the
last bucket is one hash value, taken if that comes nearer to the target. Nothing is sorted but 4096 sums a source,
larger budgets take supersets of smaller ones, and reruns agree.

Targets share SHARE times all sizes by weight, but stop at CAP times a source's size; the excess is shared again by
weight among the rest until none is above. Sources sorted by cap over weight give this in one pass.

Defined results: null text has size 0; the null source is the last one; rows with one id, or with null ids, are taken
alike; a source without words has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, n_words, read, staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BITS, LEVELS = 12, 4
BROADCAST_SOURCES = 20_000


def place(key: Column) -> Column:
    """48 bits of the key's MD5, as a long from 0."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) of rows (source, size). One row per source is ordered in one window."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    by = by.select("*", weight.cast("double").alias("w"), (F.col("source_size") * CAP).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(all_rows) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    by = by.withColumn("level", level)
    # the first source, by cap over weight, that stays below its cap sets the level of all that follow
    settled = F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(all_rows)["level"]
    return by.select("source", "source_size", F.when(settled.isNull() | (settled * F.col("w") >= F.col("cap")), F.col("cap").cast("double")).otherwise(settled * F.col("w")).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, full, below): take each document ``full`` times, and once more if its place < below."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    state = targets.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    state = state.withColumn("below", F.when(F.col("rest") > 0, F.lit(1 << (BITS * LEVELS))).otherwise(F.lit(0)).cast("long"))
    state = state.withColumn("found", F.col("rest") > 0).checkpoint()
    for level in range(1, LEVELS + 1):
        width = 1 << (BITS * (LEVELS - level))
        edge = state.where("found").select(F.col("source").alias("s"), "rest", F.floor(F.col("below") / (width << BITS)).alias("outer"))
        here = F.col("source").eqNullSafe(F.col("s"))
        inside = here if level == 1 else here & (F.floor(F.col("place") / (width << BITS)) == F.col("outer"))
        near = sized.join(_small(edge), inside)
        sums = near.groupBy("source", F.floor(F.col("place") / width).alias("bucket")).agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        # the bucket in which the budget ends, and what lies before it
        ends = sums.withColumn("upto", upto).where("upto > rest").groupBy("source").agg(F.min(F.struct("bucket", "size", "upto")).alias("e"))
        state = state.join(_small(ends.select(F.col("source").alias("s"), "e")), here, "left")
        left = F.col("rest") - (F.col("e.upto") - F.col("e.size"))
        nearer = F.lit(level == LEVELS) & (F.col("e.upto") - F.col("rest") < left)
        hit = F.col("e").isNotNull()
        state = state.select(
            "source", "source_size", "target", "full",
            F.when(hit, left).otherwise(F.col("rest")).alias("rest"),
            F.when(hit, F.col("e.bucket") * width + F.when(nearer, 1).otherwise(0)).otherwise(F.col("below")).alias("below"),
            (hit & (left > 0)).alias("found"),
        ).checkpoint()
    return state.select("source", "source_size", "target", "full", "below")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table of one row per source after counting it; else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def limited(sized: DataFrame, source: str, at: str, limits: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows with a source and a place, with added columns, whose names are returned: source_size, target, copies."""
    key, full, below, source_size, target, copies = (fresh(sized, n) for n in ("mix_source", "mix_full", "mix_below", "source_size", "target", "copies"))
    limits = _small(limits.select(F.col("source").alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("full").alias(full), F.col("below").alias(below)))
    out = sized.join(limits, F.col(source).eqNullSafe(F.col(key)), "left").withColumn(copies, F.col(full) + F.when(F.col(at) < F.col(below), 1).otherwise(0))
    return out.drop(key, full, below), [source_size, target, copies]


def _limits(slim: DataFrame) -> DataFrame:
    return thresholds(slim, source_targets(slim).checkpoint())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    slim = staged(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), place(F.col("doc_id")).alias("place")), "mix")  # words are counted once
    out, (source_size, target, copies) = limited(slim, "source", "place", _limits(slim))
    return out.select("doc_id", "size", F.col(source_size).alias("source_size"), F.col(target).alias("target"), (F.col("size") * F.col(copies)).alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    Null texts have size 0; rows with null or equal ids are taken alike, which goes for exact copies too; the null source is
    the last one; columns of any name are kept as they are; an empty table gives an empty one.
    """
    at = fresh(docs, "mix_place")
    placed = docs.withColumn(at, place(F.col("doc_id")))
    slim = staged(placed.select("source", n_words(F.col("text")).alias("size"), F.col(at).alias("place")), "mix")
    out, (*_, copies) = limited(placed, "source", at, _limits(slim))
    nth = fresh(out, "nth")
    return out.withColumn(nth, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).select(*docs.columns)


def mixing_sql(table: str) -> str:
    """Common table expressions that end in ``mixed``: all columns of ``table``, size, source_size, target, taken."""
    return rf"""
sized AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {BITS * LEVELS // 4}))::BIGINT AS place FROM {table}
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, [{', '.join(f'{w}.0' for w in WEIGHTS)}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY source
), cap AS (
  SELECT *, source_size * {CAP} AS cap FROM src
), lev AS (
  SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM cap WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), tgt AS (
  SELECT source AS s, source_size, CASE WHEN l IS NULL OR l * w >= cap THEN cap::DOUBLE ELSE l * w END AS target
  FROM lev, (SELECT min_by(level, cap / w) FILTER (level * w < cap) AS l FROM lev)
), part AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS fulls FROM sized JOIN tgt ON source IS NOT DISTINCT FROM s
), cum AS (
  SELECT *, target - fulls * source_size AS rest, sum(size) OVER (PARTITION BY source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY source, place) AS own FROM part
), mixed AS (
  SELECT *, size * (fulls + CASE WHEN rest > 0 AND (upto <= rest OR upto - rest < rest - (upto - own)) THEN 1 ELSE 0 END)::BIGINT AS taken FROM cum
)"""


OP8_SQL = f"WITH {mixing_sql('documents')} SELECT doc_id, size, source_size, target, taken FROM mixed"

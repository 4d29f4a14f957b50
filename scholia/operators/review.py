"""Spaced repetition, mistakes and study progress over many learners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.review import sm2_fold


def sm2_replay(reviews: DataFrame, clamp: bool = True) -> DataFrame:
    """State of each (user_id, card_id) after its reviews in order of (ts, event_id)."""
    hist = F.array_sort(F.collect_list(F.struct("ts", "event_id", "quality")))
    s = reviews.groupBy("user_id", "card_id").agg(sm2_fold(hist, clamp).alias("s"), F.max("day").alias("last_review"), F.count(F.lit(1)).alias("n_reviews"))
    due = F.date_add("last_review", F.greatest(F.lit(1), F.col("s.interval").cast("int")))
    return s.select("user_id", "card_id", "s.easiness", "s.interval", "s.repetitions", "last_review", due.alias("next_review"), "n_reviews")


def due_reviews(cards: DataFrame, as_of: str, limit: int = 5, subject: str = "", chapter: str = "", tree: dict[str, list[str]] | None = None) -> DataFrame:
    """Cards due by the day, of a subject or a chapter where asked for, least easiness first, at most ``limit`` a user."""
    if subject:
        cards = cards.where(subject_match(F.col("subject"), subject, tree or {}))
    if chapter:
        cards = cards.where(F.contains("chapter", F.lit(chapter)))
    w = Window.partitionBy("user_id").orderBy("easiness", "card_id")
    return cards.where(F.col("next_review") <= F.lit(as_of).cast("date")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def sr_stats(cards: DataFrame, as_of: str) -> DataFrame:
    mastered = F.col("interval") >= 21
    return cards.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("next_review") <= F.lit(as_of).cast("date")).alias("due"),
        F.count_if(mastered).alias("mastered"), F.count_if(~mastered).alias("learning"),
    )


def weekly_schedule(cards: DataFrame, as_of: str) -> DataFrame:
    """For each of seven days the cards due by then: counts by day offset, then a running sum."""
    offset = F.greatest(F.datediff("next_review", F.lit(as_of).cast("date")), F.lit(0))
    per = cards.select("user_id", offset.alias("offset")).where("offset < 7").groupBy("user_id", "offset").count()
    days = per.select("user_id").distinct().withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(6))))
    run = F.sum(F.coalesce("count", F.lit(0))).over(Window.partitionBy("user_id").orderBy("offset"))
    return days.join(per, ["user_id", "offset"], "left").select("user_id", F.date_add(F.lit(as_of).cast("date"), F.col("offset")).alias("day"), run.alias("due"))


def counts_by(df: DataFrame, keys: dict[str, Column], by: list[str]) -> DataFrame:
    """Long form (by, kind, value, n) of several counts in one pass over ``df``."""
    both = F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in keys.items()))
    return df.select(*by, F.explode(both).alias("x")).groupBy(*by, "x.kind", "x.value").count().select(*by, "kind", "value", F.col("count").alias("n"))


def mistake_stats(mistakes: DataFrame, as_of: str, by: list[str]) -> DataFrame:
    """Long form (by, kind, value, n): all, due by ``as_of``, causes, tags and names of linked concepts together, difficulties.

    mistakes: ``by``, next_review, and arrays mistake_types, tags, linked (names); null and blank ones don't count.
    """
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    many = lambda kind, c: F.transform(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x) != ""), lambda x: one(kind, F.trim(x)))
    due = F.when(F.col("next_review") <= F.lit(as_of).cast("date"), F.array(one("due", F.lit("due")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    rows = F.concat(F.array(one("all", F.lit("all")), one("difficulty", F.col("difficulty"))), due, many("cause", "mistake_types"), many("tag", "tags"), many("tag", "linked"))
    return mistakes.select(*by, F.explode(rows).alias("x")).groupBy(*by, "x.kind", "x.value").agg(F.count("*").alias("n"))


def weak_points(mistakes: DataFrame, top_n: int = 10) -> DataFrame:
    """Tags as knowledge points, then causes, most frequent first."""
    c = counts_by(mistakes, {"point": F.col("tag"), "cause": F.col("mistake_type")}, ["user_id"])
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), F.desc("kind"), "value")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def quiz_stats(quiz: DataFrame) -> DataFrame:
    right = F.count_if("correct")
    return quiz.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), right.alias("right"), F.round(100.0 * right / F.count(F.lit(1)), 1).alias("accuracy"),
        F.countDistinct(F.when(~F.col("correct"), F.col("chapter"))).alias("weak_chapters"),
    )


def weak_chapters(quiz: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("wrong"), "chapter")
    return quiz.where("not correct").groupBy("user_id", "chapter").agg(F.count(F.lit(1)).alias("wrong")).withColumn("rank", F.row_number().over(w))


def study_streak(days: DataFrame, as_of: str, most: int = 365) -> DataFrame:
    """Days in a row back from ``as_of``: a day belongs to the run if its distance equals its rank."""
    d = days.where((F.col("day") <= F.lit(as_of).cast("date")) & (F.col("day") > F.date_sub(F.lit(as_of).cast("date"), most))).select("user_id", "day").distinct()
    back, rank = F.datediff(F.lit(as_of).cast("date"), "day"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day"))) - 1
    run = d.withColumn("on", back == rank).groupBy("user_id").agg(F.count_if("on").alias("streak"))
    return days.select("user_id").distinct().join(run, "user_id", "left").select("user_id", F.coalesce("streak", F.lit(0)).alias("streak"))


def chapter_progress(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id", "chapter").agg(F.max("day").alias("last_review"), F.count(F.lit(1)).alias("review_count"))


def latest_context(rows: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` rows of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def subject_match(value: Column, selected: str, tree: dict[str, list[str]]) -> Column:
    """Whether a record's subject falls under ``selected``: a parent takes its children, old records hold a child only."""
    selected = selected.strip().strip("/")
    if not selected:
        return F.lit(True)
    v = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "^/+|/+$", "")
    parent, _, child = selected.partition("/")
    if child:
        hit = (v == selected) | (v == child)
    else:
        # a bare child name also takes the records that hold its whole path
        hit = (v == selected) | F.startswith(v, F.lit(f"{selected}/")) | v.isin(*tree.get(selected, [""])) | F.endswith(v, F.lit(f"/{selected}"))
    return (v != "") & hit


def normalise_subject(value: Column, tree: dict[str, list[str]]) -> Column:
    """``parent/child``; a bare child gets its parent where only one has it."""
    v = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "^/+|/+$", "")
    owners: dict[str, list[str]] = {}
    for p, cs in tree.items():
        for c in cs:
            owners.setdefault(c, []).append(p)
    out = v
    for c, ps in owners.items():
        if len(ps) == 1 and c not in tree:
            out = F.when(v == c, f"{ps[0]}/{c}").otherwise(out)
    return F.when(v == "", "").otherwise(out)


def orphan_subjects(used: DataFrame, tree: dict[str, list[str]]) -> DataFrame:
    """Subjects in use that the catalogue lacks."""
    known = [*tree, *(f"{p}/{c}" for p, cs in tree.items() for c in cs)]
    return used.groupBy("subject").count().where(~F.col("subject").isin(known)).select("subject", F.col("count").alias("n"))

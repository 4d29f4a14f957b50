"""Spaced-repetition arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the start and the floor of easiness, the first two intervals
START_EASINESS, LEAST_EASINESS, FIRST, SECOND = 2.5, 1.3, 1, 6


def sm2_fold(history: Column, clamp: bool = True) -> Column:
    """State (easiness, interval, repetitions) after an ordered array of structs with a ``quality`` field."""
    start = F.struct(F.lit(START_EASINESS).alias("easiness"), F.lit(FIRST).cast("long").alias("interval"), F.lit(0).alias("repetitions"))

    def step(s: Column, r: Column) -> Column:
        q = F.least(F.greatest(r["quality"], F.lit(0)), F.lit(5)) if clamp else r["quality"]
        miss = F.lit(5) - q
        grown = F.when(s["repetitions"] == 0, FIRST).when(s["repetitions"] == 1, SECOND).otherwise(F.rint(s["interval"] * s["easiness"]))
        return F.struct(
            F.greatest(F.lit(LEAST_EASINESS), s["easiness"] + 0.1 - miss * (F.lit(0.08) + miss * 0.02)).alias("easiness"),
            F.when(q >= 3, grown).otherwise(FIRST).cast("long").alias("interval"),
            F.when(q >= 3, s["repetitions"] + 1).otherwise(0).alias("repetitions"),
        )

    return F.aggregate(history, start, step)


def quality_from_score(score: Column, out_of: Column) -> Column:
    """0 to 5 from a share of points; without a positive total the score is taken as the share."""
    share = F.when(out_of > 0, score / out_of).otherwise(score)
    return F.when(share >= 0.9, 5).when(share >= 0.8, 4).when(share >= 0.6, 3).when(share >= 0.4, 2).when(share >= 0.2, 1).otherwise(0)


def quality_from_rating(rating: Column, variant: str = "feedback") -> Column:
    """Quality of a thumbs rating; the feedback loop and the pipeline node map it differently."""
    marks = {"feedback": {2: 1, 1: 0}, "node": {2: 2, 1: 1}}[variant]
    out = rating
    for k, v in marks.items():
        out = F.when(rating == k, v).otherwise(out)
    return out

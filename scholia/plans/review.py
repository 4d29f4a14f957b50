"""Queries on spaced repetition, mistakes and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import review as fr
from scholia.operators import review as op
from scholia.sources import study
from scholia.sources.study import AS_OF, with_study

from .registry import query

TREE = {"exact": ["src1", "src2"], "human": ["src3", "src4", "src2"]}

CARDS_SQL = f"""{with_study("reviews", recursive=True)}, r AS (
  SELECT *, greatest(0, least(5, quality)) AS q, row_number() OVER (PARTITION BY user_id, card_id ORDER BY ts, event_id) AS n FROM reviews
), f AS (
  SELECT user_id, card_id, 0::BIGINT AS n, 2.5::DOUBLE AS e, 1::BIGINT AS i, 0 AS reps FROM r GROUP BY user_id, card_id
  UNION ALL
  SELECT f.user_id, f.card_id, r.n, greatest(1.3::DOUBLE, e + 0.1::DOUBLE - (5 - q) * (0.08::DOUBLE + (5 - q) * 0.02::DOUBLE)),
         CASE WHEN q < 3 OR reps = 0 THEN 1 WHEN reps = 1 THEN 6 ELSE round_even(i * e, 0)::BIGINT END, CASE WHEN q >= 3 THEN reps + 1 ELSE 0 END
  FROM f JOIN r ON r.user_id = f.user_id AND r.card_id = f.card_id AND r.n = f.n + 1
), cards AS (
  SELECT f.user_id, f.card_id, e AS easiness, i AS "interval", reps AS repetitions, l.last_review, (l.last_review + greatest(1, i)::INT)::DATE AS next_review, l.n_reviews
  FROM f JOIN (SELECT user_id, card_id, max(day) AS last_review, count(*) AS n_reviews FROM r GROUP BY ALL) l ON l.user_id = f.user_id AND l.card_id = f.card_id AND l.n_reviews = f.n
)"""


def cards(spark, sf_dir):
    return op.sm2_replay(study.reviews(spark, sf_dir))


@query(CARDS_SQL + """ SELECT user_id, card_id, round(easiness, 4) AS easiness, "interval", repetitions, strftime(last_review, '%Y-%m-%d') AS last_review, strftime(next_review, '%Y-%m-%d') AS next_review, n_reviews FROM cards""")
def sr1_sm2_replay(spark, sf_dir):
    c = cards(spark, sf_dir)
    return c.select("user_id", "card_id", F.round("easiness", 4).alias("easiness"), "interval", "repetitions", F.col("last_review").cast("string").alias("last_review"), F.col("next_review").cast("string").alias("next_review"), "n_reviews")


@query(with_study("quiz") + """ SELECT event_id, CASE WHEN score / 100 >= 0.9 THEN 5 WHEN score / 100 >= 0.8 THEN 4 WHEN score / 100 >= 0.6 THEN 3 WHEN score / 100 >= 0.4 THEN 2 WHEN score / 100 >= 0.2 THEN 1 ELSE 0 END AS quality,
  CASE score % 3 WHEN 2 THEN 1 WHEN 1 THEN 0 ELSE score % 3 END AS feedback, score % 3 AS node FROM quiz""")
def sr2_quality_from_score(spark, sf_dir):
    r = F.col("score") % 3
    return study.quiz(spark, sf_dir).select("event_id", fr.quality_from_score(F.col("score"), F.lit(100)).alias("quality"), fr.quality_from_rating(r).alias("feedback"), fr.quality_from_rating(r, "node").alias("node"))


@query(CARDS_SQL + f""" SELECT user_id, card_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY easiness, card_id) AS rank FROM cards WHERE next_review <= DATE '{AS_OF}' AND card_id % 3 = 1 AND card_id >= 4) WHERE rank <= 5""")
def sr3_due_of_subject(spark, sf_dir):
    """Of the cards of one subject and of chapters named 2."""
    c = cards(spark, sf_dir).withColumn("subject", F.element_at(F.array(F.lit("math/a"), F.lit("a"), F.lit("physics")), (F.col("card_id") % 3 + 1).cast("int")))
    c = c.withColumn("subject", F.when(F.col("subject") == "math/a", "art").otherwise(F.col("subject"))).withColumn("chapter", F.when(F.col("card_id") >= 4, "chapter 2").otherwise("chapter 1"))
    return op.due_reviews(c, AS_OF, subject="math/a", chapter="2").select("user_id", "card_id", "rank")


@query(CARDS_SQL + f""" SELECT user_id, card_id, rank, round(easiness, 4) AS easiness FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY easiness, card_id) AS rank FROM cards WHERE next_review <= DATE '{AS_OF}') WHERE rank <= 5""")
def sr3_due_reviews(spark, sf_dir):
    return op.due_reviews(cards(spark, sf_dir), AS_OF).select("user_id", "card_id", "rank", F.round("easiness", 4).alias("easiness"))


@query(CARDS_SQL + f""" SELECT user_id, count(*) AS total, count(*) FILTER (next_review <= DATE '{AS_OF}') AS due, count(*) FILTER ("interval" >= 21) AS mastered, count(*) FILTER ("interval" < 21) AS learning FROM cards GROUP BY user_id""")
def sr4_sr_stats(spark, sf_dir):
    return op.sr_stats(cards(spark, sf_dir), AS_OF)


@query(CARDS_SQL + f""", d AS (SELECT user_id, greatest(next_review - DATE '{AS_OF}', 0) AS o FROM cards), u AS (SELECT DISTINCT user_id FROM d WHERE o < 7)
SELECT u.user_id, strftime(DATE '{AS_OF}' + g.o::INT, '%Y-%m-%d') AS day, count(d.o) AS due FROM u CROSS JOIN (SELECT unnest(range(7)) AS o) g LEFT JOIN d ON d.user_id = u.user_id AND d.o <= g.o GROUP BY ALL""")
def sr5_weekly_schedule(spark, sf_dir):
    return op.weekly_schedule(cards(spark, sf_dir), AS_OF).select("user_id", F.col("day").cast("string").alias("day"), "due")


@query(with_study("mistakes") + """ SELECT user_id, kind, value, count(*) AS n FROM (
  SELECT user_id, 'all' AS kind, 'all' AS value FROM mistakes UNION ALL SELECT user_id, 'cause', mistake_type FROM mistakes UNION ALL SELECT user_id, 'tag', tag FROM mistakes UNION ALL SELECT user_id, 'difficulty', difficulty::VARCHAR FROM mistakes) GROUP BY ALL""")
def sr6_mistake_stats(spark, sf_dir):
    return op.counts_by(study.mistakes(spark, sf_dir), {"all": F.lit("all"), "cause": F.col("mistake_type"), "tag": F.col("tag"), "difficulty": F.col("difficulty")}, ["user_id"])


@query(with_study("mistakes", "exposures") + f""", l AS (SELECT id, user_id, list_distinct(list(concept)) AS linked FROM mistakes m JOIN (SELECT user_id AS u, day AS d, concept FROM exposures WHERE confidence >= 0.9 AND weak) e ON u = user_id AND d = m.day GROUP BY ALL),
m AS (SELECT mistakes.*, linked, day + difficulty * 5 AS next_review FROM mistakes LEFT JOIN l USING (id, user_id))
SELECT user_id, kind, value, count(*) AS n FROM (SELECT user_id, 'all' AS kind, 'all' AS value FROM m UNION ALL SELECT user_id, 'due', 'due' FROM m WHERE next_review <= DATE '{AS_OF}' UNION ALL SELECT user_id, 'cause', mistake_type FROM m
  UNION ALL SELECT user_id, 'tag', tag FROM m UNION ALL SELECT user_id, 'tag', unnest(linked) FROM m UNION ALL SELECT user_id, 'difficulty', difficulty::VARCHAR FROM m) GROUP BY ALL""")
def sr6_due_and_linked(spark, sf_dir):
    """A mistake's linked concepts are those that its user was sure about and weak at on its day."""
    m = study.mistakes(spark, sf_dir)
    e = study.exposures(spark, sf_dir).where("confidence >= 0.9 and weak").select(F.col("user_id").alias("u"), F.col("day").alias("d"), "concept")
    linked = m.join(e, (F.col("u") == F.col("user_id")) & (F.col("d") == F.col("day"))).groupBy("id", "user_id").agg(F.collect_set("concept").alias("linked"))
    m = m.join(linked, ["id", "user_id"], "left").withColumn("next_review", F.expr("date_add(day, difficulty * 5)")).withColumn("mistake_types", F.array("mistake_type")).withColumn("tags", F.array("tag"))
    return op.mistake_stats(m, AS_OF, ["user_id"])


@query(with_study("mistakes") + """ SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, kind DESC, value) AS rank FROM (
  SELECT user_id, kind, value, count(*) AS n FROM (SELECT user_id, 'point' AS kind, tag AS value FROM mistakes UNION ALL SELECT user_id, 'cause', mistake_type FROM mistakes) GROUP BY ALL)) WHERE rank <= 10""")
def sr7_weak_points(spark, sf_dir):
    return op.weak_points(study.mistakes(spark, sf_dir))


@query(with_study("quiz") + """ SELECT user_id, count(*) AS total, count(*) FILTER (correct) AS "right", round(100.0::DOUBLE * count(*) FILTER (correct) / count(*), 1) AS accuracy, count(DISTINCT chapter) FILTER (NOT correct) AS weak_chapters FROM quiz GROUP BY user_id""")
def sr8_quiz_stats(spark, sf_dir):
    return op.quiz_stats(study.quiz(spark, sf_dir))


@query(with_study("quiz") + """ SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY wrong DESC, chapter) AS rank FROM (SELECT user_id, chapter, count(*) AS wrong FROM quiz WHERE NOT correct GROUP BY ALL)""")
def sr8_weak_chapters(spark, sf_dir):
    return op.weak_chapters(study.quiz(spark, sf_dir))


@query(with_study("learning_events") + """, d AS (SELECT DISTINCT user_id, day FROM learning_events WHERE day <= DATE '2024-01-20'),
r AS (SELECT *, DATE '2024-01-20' - day AS back, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) - 1 AS n FROM d)
SELECT u.user_id, count(r.day) AS streak FROM (SELECT DISTINCT user_id FROM learning_events) u LEFT JOIN r ON r.user_id = u.user_id AND back = n GROUP BY u.user_id""")
def sr9_study_streak(spark, sf_dir):
    return op.study_streak(study.learning_events(spark, sf_dir).select("user_id", "day"), "2024-01-20")


@query(with_study("quiz") + """ SELECT user_id, chapter, strftime(max(day), '%Y-%m-%d') AS last_review, count(*) AS review_count FROM quiz GROUP BY ALL""")
def sr10_chapter_progress(spark, sf_dir):
    return op.chapter_progress(study.quiz(spark, sf_dir)).withColumn("last_review", F.col("last_review").cast("string"))


@query(with_study("quiz") + """ SELECT user_id, event_id, chapter, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM quiz) WHERE rank <= 10""")
def sr10_latest_quiz(spark, sf_dir):
    return op.latest_context(study.quiz(spark, sf_dir)).select("user_id", "event_id", "chapter", "score", "rank")


@query("""SELECT doc_id, CASE WHEN source IN ('src1') THEN 'exact/src1' WHEN source IN ('src3', 'src4') THEN 'human/' || source ELSE source END AS subject,
  source IN ('exact', 'src1', 'src2') AS in_exact, source IN ('src3', 'human/src3') AS in_child FROM documents""")
def su1_subject_match(spark, sf_dir):
    s = F.col("source")
    return study.table(spark, sf_dir, "documents").select("doc_id", fr_normal(s).alias("subject"), op.subject_match(s, "exact", TREE).alias("in_exact"), op.subject_match(s, "human/src3", TREE).alias("in_child"))


def fr_normal(s):
    return op.normalise_subject(s, TREE)


@query("""SELECT source AS subject, count(*) AS n FROM documents WHERE source NOT IN ('exact', 'human', 'src1', 'exact/src1') GROUP BY source""")
def su1_orphan_subjects(spark, sf_dir):
    return op.orphan_subjects(study.table(spark, sf_dir, "documents").select(F.col("source").alias("subject")), {"exact": [], "human": [], "src1": []})

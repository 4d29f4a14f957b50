"""Queries on learning events, concept memory and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.operators import learning as op
from scholia.operators import review as rv
from scholia.sources import study
from scholia.sources.study import AS_OF, with_study

from .registry import query
from .review import CARDS_SQL, cards

DAYS = f"floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({{}})) / 86400000000)::BIGINT"
STATE_SQL = """, state AS (
  SELECT user_id, concept, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS exposure_count, max(confidence) AS max_confidence, bool_or(weak) AS weak, max(ts) FILTER (weak) AS weak_since FROM exposures GROUP BY ALL)"""
CREVIEWS_SQL = """, creviews AS (SELECT user_id, 'k' || exercise_id AS concept, ts, event_id, quality FROM practice_log),
marks AS (SELECT user_id, concept, ts, event_id, true AS weak FROM exposures WHERE weak UNION ALL SELECT user_id, concept, ts, event_id, quality <= 2 FROM creviews WHERE quality <= 2 OR quality = 5),
reviewed AS (
  SELECT s.user_id, s.concept, s.first_seen, s.last_seen, s.exposure_count, coalesce(l.weak, false) AS weak, coalesce(r.mastery, 0) AS mastery, coalesce(r.review_count, 0) AS review_count, r.last_reviewed
  FROM state s LEFT JOIN (SELECT user_id, concept, max_by(weak, (ts, event_id)) AS weak FROM marks GROUP BY ALL) l USING (user_id, concept)
  LEFT JOIN (SELECT user_id, concept, max(quality) FILTER (quality >= 4) AS mastery, count(*) AS review_count, max(ts) AS last_reviewed FROM creviews GROUP BY ALL) r USING (user_id, concept))"""
BASE = with_study("exposures", "practice_log", "mistakes", "learning_events") + STATE_SQL + CREVIEWS_SQL


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _creviews(spark, sf_dir):
    return study.practice_log(spark, sf_dir).select("user_id", F.concat(F.lit("k"), "exercise_id").alias("concept"), "ts", "event_id", "quality")


def _state(spark, sf_dir):
    e = study.exposures(spark, sf_dir)
    return op.apply_reviews(op.concept_state(e), e, _creviews(spark, sf_dir))


SUBJECTS = {"math": ["algebra"], "physics": ["optics"]}


@query(with_study("learning_events") + " SELECT id, event_type, user_id, CASE id % 2 WHEN 0 THEN 'math/algebra' ELSE 'physics' END AS subject, 'k' || k || ',' || event_type AS concepts FROM learning_events WHERE id % 3 <> 0")
def le1_append_events(spark, sf_dir):
    """Events twice over, with bare subjects and names with blanks and repeats."""
    k = F.concat(F.lit("k"), "k")
    e = study.learning_events(spark, sf_dir).withColumn("subject", F.when(F.col("id") % 2 == 0, " algebra").otherwise("/physics/"))
    e = e.withColumn("concepts", F.array(F.concat(k, F.lit(" ")), F.lit("  "), k, F.col("event_type")))
    return op.append_events(e.union(e), e.where("id % 3 = 0"), tree=SUBJECTS).select("id", "event_type", "user_id", "subject", F.array_join("concepts", ",").alias("concepts"))


@query("WITH n AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[ ]+'), lambda x: trim(x)), lambda x: x <> '') AS ns FROM documents) SELECT doc_id, md5(array_to_string(list_filter(ns, lambda x, i: list_position(ns, x) = i)[1:20], ',')) AS names FROM n")
def le1_clean_names(spark, sf_dir):
    d = study.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(F.array_join(op.clean_names(F.split("text", "[ ]+")), ",")).alias("names"))


@query(with_study("learning_events") + " SELECT user_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS rank FROM learning_events WHERE event_type = 'error') WHERE rank <= 20")
def le2_recent_events(spark, sf_dir):
    return op.recent_events(study.learning_events(spark, sf_dir), "error").select("user_id", "id", "rank")


@query(with_study("learning_events") + " SELECT user_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS rank FROM learning_events WHERE k % 3 = 1) WHERE rank <= 20")
def le2_recent_of_book(spark, sf_dir):
    e = study.learning_events(spark, sf_dir).withColumn("book", F.concat(F.lit("b"), F.col("k") % 3))
    return op.recent_events(e, book="b1").select("user_id", "id", "rank")


@query(with_study("exposures") + " SELECT event_id, user_id, concept FROM exposures WHERE confidence >= 0.85 AND event_id % 2 = 0")
def le3_strict_by_alias(spark, sf_dir):
    """Questions that don't name the concept; every other exposure has an alias that they name, the rest a generic one."""
    alias = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("What is "), F.lit("?"))).otherwise(F.array(F.lit("method"), F.lit(" ")))
    e = study.exposures(spark, sf_dir).withColumn("question", F.lit("what is this method")).withColumn("source", F.lit("view")).withColumn("aliases", alias)
    return op.strict_exposures(e).select("event_id", "user_id", "concept")


@query(with_study("exposures") + " SELECT event_id, user_id, concept FROM exposures WHERE confidence >= 0.85 AND (contains(lower(question), lower(concept)) OR source = 'error')")
def le3_strict_exposures(spark, sf_dir):
    return op.strict_exposures(study.exposures(spark, sf_dir)).select("event_id", "user_id", "concept")


@query(BASE + """ SELECT user_id, concept, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, exposure_count, max_confidence, weak, weak_reason, sources, chapters, aliases FROM state LEFT JOIN (SELECT user_id, concept, max_by(source, (ts, event_id)) FILTER (weak) AS weak_reason FROM exposures GROUP BY ALL) USING (user_id, concept)
 LEFT JOIN (SELECT user_id, concept, array_to_string(list(source ORDER BY o), ',') AS sources FROM (SELECT user_id, concept, source, min((ts, event_id)) AS o FROM exposures GROUP BY ALL) GROUP BY ALL) USING (user_id, concept)
 LEFT JOIN (SELECT user_id, concept, array_to_string(list(chapter ORDER BY o)[1:20], ',') AS chapters FROM (SELECT user_id, concept, event_id % 30 AS chapter, min((ts, event_id)) AS o FROM exposures GROUP BY ALL) GROUP BY ALL) USING (user_id, concept)
 LEFT JOIN (SELECT user_id, concept, array_to_string(list(alias ORDER BY o, alias)[1:20], ',') AS aliases FROM (SELECT user_id, concept, alias, min((ts, event_id)) AS o FROM (SELECT *, unnest([concept, source]) AS alias FROM exposures) GROUP BY ALL) GROUP BY ALL) USING (user_id, concept)""")
def le4_concept_state(spark, sf_dir):
    e = study.exposures(spark, sf_dir).withColumn("chapter", (F.col("event_id") % 30).cast("string")).withColumn("aliases", F.array("concept", "source"))
    lists = [F.array_join(c, ",").alias(n) for c, n in (("sources", "sources"), ("chapters", "chapters"), ("all_aliases", "aliases"))]
    return op.concept_state(e).select("user_id", "concept", _stamp("first_seen").alias("first_seen"), _stamp("last_seen").alias("last_seen"), "exposure_count", "max_confidence", "weak", "weak_reason", *lists)


@query(BASE + " SELECT user_id, concept, weak, mastery, review_count, strftime(last_reviewed, '%Y-%m-%d %H:%M:%S') AS last_reviewed FROM reviewed")
def le5_apply_concept_reviews(spark, sf_dir):
    return _state(spark, sf_dir).select("user_id", "concept", "weak", "mastery", "review_count", _stamp("last_reviewed").alias("last_reviewed"))


@query(BASE + " SELECT user_id, concept FROM reviewed WHERE weak AND (user_id, concept) IN (SELECT (user_id, concept) FROM exposures WHERE weak AND (contains(question, 'what is') OR source = 'error'))")
def le6_effective_weak(spark, sf_dir):
    return op.effective_weak(_state(spark, sf_dir), study.exposures(spark, sf_dir)).select("user_id", "concept")


FORGOTTEN_SQL = f"""SELECT user_id, concept, days, row_number() OVER (PARTITION BY user_id ORDER BY days DESC, concept) AS rank FROM (SELECT *, {DAYS.format('last_seen')} AS days FROM reviewed) WHERE exposure_count >= {{}} AND days >= {{}}"""


@query(BASE + f" SELECT * FROM ({FORGOTTEN_SQL.format(2, 7)}) WHERE rank <= 3")
def le7_forgotten(spark, sf_dir):
    return op.forgotten(_state(spark, sf_dir), AS_OF).select("user_id", "concept", "days", "rank")


@query(BASE + " SELECT * FROM (SELECT user_id, concept, exposure_count, row_number() OVER (PARTITION BY user_id ORDER BY exposure_count DESC, concept) AS rank FROM state) WHERE rank <= 12")
def le7_frequent(spark, sf_dir):
    return op.frequent(_state(spark, sf_dir)).select("user_id", "concept", "exposure_count", "rank")


QUEUE_SQL = f""", queue AS (SELECT * FROM (SELECT user_id, concept, CASE WHEN o.grp = 0 THEN 'weak' ELSE 'forgotten' END AS reason, row_number() OVER (PARTITION BY user_id ORDER BY o.grp, o.k, concept) AS rank FROM (
  SELECT user_id, concept, min({{'grp': grp, 'k': k}}) AS o FROM (
    SELECT user_id, concept, 0 AS grp, -{DAYS.format('last_seen')} AS k FROM reviewed WHERE weak
    UNION ALL SELECT user_id, concept, 1, -days FROM ({FORGOTTEN_SQL.format(2, 3)}) WHERE rank <= 5) GROUP BY ALL)
  WHERE (user_id, concept) NOT IN (SELECT (user_id, concept) FROM reviewed WHERE last_reviewed::DATE = DATE '{AS_OF}')) WHERE rank <= 5)"""


@query(BASE + QUEUE_SQL + " SELECT * FROM queue")
def le8_review_queue(spark, sf_dir):
    return op.review_queue(_state(spark, sf_dir), AS_OF)


@query(BASE + f""", t AS (SELECT user_id, list(concept ORDER BY r) AS top12 FROM (SELECT user_id, concept, row_number() OVER (PARTITION BY user_id ORDER BY exposure_count DESC, concept) AS r FROM state) WHERE r <= 12 GROUP BY user_id),
b AS (SELECT user_id, array_to_string(list_sort(list(source || ':' || n)), ',') AS by_source FROM (SELECT user_id, source, count(*) AS n FROM exposures GROUP BY ALL) GROUP BY user_id),
c AS (SELECT user_id, count(*) AS concepts, count(*) FILTER (s.max_confidence >= 0.85) AS strict, sum(r.exposure_count)::BIGINT AS exposures, count(*) FILTER (r.weak) AS weak, count(*) FILTER (r.exposure_count >= 2 AND {DAYS.format('r.last_seen')} >= 7) AS forgotten FROM reviewed r JOIN state s USING (user_id, concept) GROUP BY user_id)
SELECT c.*, array_to_string(top12[1:3], ',') AS top3, array_to_string(top12, ',') AS top12, by_source FROM c JOIN t USING (user_id) JOIN b USING (user_id)""")
def le8_memory_stats(spark, sf_dir):
    d = op.memory_stats(_state(spark, sf_dir), AS_OF, study.exposures(spark, sf_dir))
    return d.select("user_id", "concepts", "strict", "exposures", "weak", "forgotten", *(F.array_join(c, ",").alias(c) for c in ("top3", "top12", "by_source")))


@query(BASE + """, e AS (SELECT * FROM exposures WHERE event_id % 2 = 0), n AS (SELECT * FROM exposures x WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = x.user_id AND e.day = x.day AND e.question = x.question))
SELECT * FROM (SELECT user_id, strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (kind = 'qa') AS qa, count(*) FILTER (kind = 'mistake') AS mistakes, count(*) AS total, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rank
  FROM (SELECT user_id, day, CASE WHEN source = 'error' THEN 'mistake' ELSE 'qa' END AS kind FROM e UNION ALL SELECT user_id, day, 'qa' FROM n) GROUP BY user_id, day) WHERE rank <= 14""")
def le9_daily_activity(spark, sf_dir):
    e = study.exposures(spark, sf_dir)
    return op.daily_activity(e.where("event_id % 2 = 0"), e.select("user_id", "day", "question")).withColumn("day", F.col("day").cast("string"))


@query(BASE + f" SELECT * FROM (SELECT user_id, strftime(day, '%Y-%m-%d') AS day, concept, count(*) AS count, row_number() OVER (PARTITION BY user_id, day ORDER BY count(*) DESC, concept) AS rank FROM exposures WHERE day >= DATE '{AS_OF}' - 120 GROUP BY user_id, day, concept) WHERE rank <= 8")
def le9_daily_concepts(spark, sf_dir):
    return op.daily_concepts(study.exposures(spark, sf_dir), AS_OF).withColumn("day", F.col("day").cast("string"))


@query(BASE + f" SELECT * FROM (SELECT user_id, source AS book_id, strftime(day, '%Y-%m-%d') AS day, concept, count(*) AS count, row_number() OVER (PARTITION BY user_id, source, day ORDER BY count(*) DESC, concept) AS rank FROM exposures WHERE day >= DATE '{AS_OF}' - 120 GROUP BY user_id, source, day, concept) WHERE rank <= 8")
def le9_daily_book_concepts(spark, sf_dir):
    e = study.exposures(spark, sf_dir).withColumnRenamed("source", "book_id")
    return op.daily_concepts(e, AS_OF, by=("user_id", "book_id")).withColumn("day", F.col("day").cast("string"))


@query(BASE + """, q AS (SELECT user_id, source, question, max(ts) AS latest, bool_or(weak) AS weak, count(DISTINCT concept) AS concepts FROM exposures GROUP BY ALL),
ev AS (SELECT user_id, CASE k % 2 WHEN 0 THEN 'what is k' || k ELSE 'about k' || k END AS question, max(ts) AS latest FROM learning_events WHERE id % 3 = 0 GROUP BY ALL),
a AS (SELECT * FROM q UNION ALL SELECT user_id, 'qa', question, latest, false, 0 FROM ev WHERE (user_id, question) NOT IN (SELECT (user_id, question) FROM exposures)),
m AS (SELECT a.user_id, a.question, min(m.id) AS mistake_id FROM (SELECT DISTINCT user_id, question FROM a) a JOIN mistakes m ON m.user_id = a.user_id AND contains(lower(m.question_text), lower(a.question)) GROUP BY ALL)
SELECT a.user_id, CASE WHEN m.mistake_id IS NOT NULL THEN 'mistake' ELSE source END AS source, a.question, strftime(latest, '%Y-%m-%d %H:%M:%S') AS latest, weak, concepts, m.mistake_id FROM a LEFT JOIN m ON m.user_id = a.user_id AND m.question = a.question""")
def le10_question_timeline(spark, sf_dir):
    """Events ask about even numbers as exposures do, and about odd ones in words that only mistakes have."""
    k = F.col("k")
    e = study.learning_events(spark, sf_dir).where("id % 3 = 0").select("user_id", "ts", F.concat(F.when(k % 2 == 0, "what is k").otherwise("about k"), k).alias("question"))
    return op.question_timeline(study.exposures(spark, sf_dir), study.mistakes(spark, sf_dir), e).select("user_id", "source", "question", _stamp("latest").alias("latest"), "weak", "concepts", "mistake_id")


@query(BASE + f""", related AS (SELECT user_id, tag AS concept, least(count(*), 50) AS related FROM mistakes GROUP BY ALL),
top AS (SELECT user_id, concept FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY exposure_count DESC, concept) AS r FROM state) WHERE r <= 12),
names AS (SELECT user_id, concept FROM reviewed WHERE weak UNION SELECT * FROM top UNION SELECT user_id, concept FROM related),
x AS (SELECT n.user_id, n.concept, coalesce(exposure_count, 0) AS n,
  (CASE WHEN weak THEN 45 ELSE 0 END + CASE WHEN related > 0 THEN 30 + 4 * related ELSE 0 END + CASE WHEN {DAYS.format('last_seen')} >= 7 THEN least(30, {DAYS.format('last_seen')}) ELSE 0 END
   + CASE WHEN exposure_count >= 2 THEN least(15, exposure_count * 2) ELSE 0 END + CASE WHEN last_reviewed IS NULL THEN 8 WHEN {DAYS.format('last_reviewed')} >= 7 THEN least(20, {DAYS.format('last_reviewed')}) ELSE 0 END
   + CASE WHEN EXISTS (SELECT 1 FROM exposures e WHERE e.user_id = n.user_id AND e.concept = n.concept AND e.question <> '') THEN 4 ELSE 0 END)::BIGINT AS priority
  FROM names n LEFT JOIN reviewed USING (user_id, concept) LEFT JOIN related USING (user_id, concept) WHERE coalesce(last_reviewed::DATE <> DATE '{AS_OF}', true))
SELECT user_id, concept, priority, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, n DESC, concept) AS rank FROM x) WHERE rank <= 8 AND priority > 0""")
def le11_concept_review_plan(spark, sf_dir):
    return op.review_plan(_state(spark, sf_dir), study.mistakes(spark, sf_dir), study.exposures(spark, sf_dir), AS_OF).select("user_id", "concept", "priority", "rank")


@query(BASE + f""", m AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'no name here' ELSE question_text END AS q FROM mistakes), counted AS (SELECT user_id, tag AS concept FROM m UNION SELECT user_id, mistake_type FROM m),
top AS (SELECT user_id, concept FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY exposure_count DESC, concept) AS r FROM state) WHERE r <= 12),
names AS (SELECT user_id, concept FROM reviewed WHERE weak UNION SELECT * FROM top UNION SELECT * FROM counted), related AS (SELECT n.user_id, n.concept, least(count(*), 50) AS related FROM names n JOIN m ON m.user_id = n.user_id AND contains(q, concept) GROUP BY ALL),
x AS (SELECT n.user_id, n.concept, coalesce(exposure_count, 0) AS n,
  (CASE WHEN weak THEN 45 ELSE 0 END + CASE WHEN related > 0 THEN 30 + 4 * related WHEN (n.user_id, n.concept) IN (SELECT (user_id, concept) FROM counted) THEN 25 ELSE 0 END + CASE WHEN {DAYS.format('last_seen')} >= 7 THEN least(30, {DAYS.format('last_seen')}) ELSE 0 END
   + CASE WHEN exposure_count >= 2 THEN least(15, exposure_count * 2) ELSE 0 END + CASE WHEN last_reviewed IS NULL THEN 8 WHEN {DAYS.format('last_reviewed')} >= 7 THEN least(20, {DAYS.format('last_reviewed')}) ELSE 0 END
   + CASE WHEN EXISTS (SELECT 1 FROM exposures e WHERE e.user_id = n.user_id AND e.concept = n.concept AND e.question <> '') THEN 4 ELSE 0 END)::BIGINT AS priority
  FROM names n LEFT JOIN reviewed USING (user_id, concept) LEFT JOIN related USING (user_id, concept) WHERE coalesce(last_reviewed::DATE <> DATE '{AS_OF}', true))
SELECT user_id, concept, priority, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, n DESC, concept) AS rank FROM x) WHERE rank <= 8 AND priority > 0""")
def le11_plan_by_containment(spark, sf_dir):
    """Mistakes are related by what their texts contain; a third of them name nothing, so their tags and causes only count."""
    m = study.mistakes(spark, sf_dir).withColumn("q", F.when(F.col("id") % 3 == 0, "no name here").otherwise(F.col("question_text")))
    return op.review_plan(_state(spark, sf_dir), m, study.exposures(spark, sf_dir), AS_OF, texts=["q"]).select("user_id", "concept", "priority", "rank")


@query(CARDS_SQL + ", exposures AS (" + study.STUDY_SQL["exposures"][1] + "), practice_log AS (" + study.STUDY_SQL["practice_log"][1] + "), mistakes AS (" + study.STUDY_SQL["mistakes"][1] + ")" + STATE_SQL + CREVIEWS_SQL + QUEUE_SQL + f""",
due AS (SELECT user_id, card_id::VARCHAR AS item, row_number() OVER (PARTITION BY user_id ORDER BY easiness, card_id) AS rank FROM cards WHERE next_review <= DATE '{AS_OF}'),
wp AS (SELECT user_id, value AS item, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, kind DESC, value) AS rank FROM (SELECT user_id, kind, value, count(*) AS n FROM (SELECT user_id, 'point' AS kind, tag AS value FROM mistakes UNION ALL SELECT user_id, 'cause', mistake_type FROM mistakes) GROUP BY ALL)),
a AS (SELECT user_id, 'due' AS kind, item, (101 - rank)::INT AS priority FROM due WHERE rank <= 5 UNION ALL SELECT user_id, 'concept', concept, (71 - rank)::INT FROM queue WHERE rank <= 8 UNION ALL SELECT user_id, 'weak_point', item, (51 - rank)::INT FROM wp WHERE rank <= 8)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, kind, item) AS rank FROM a) WHERE rank <= 8""")
def le12_combined_plan(spark, sf_dir):
    due = rv.due_reviews(cards(spark, sf_dir), AS_OF).withColumn("item", F.col("card_id"))
    queue = op.review_queue(_state(spark, sf_dir), AS_OF).withColumn("item", F.col("concept"))
    return op.combined_plan(due, queue, rv.weak_points(study.mistakes(spark, sf_dir)).withColumn("item", F.col("value")))


@query(BASE + f""", r AS (SELECT user_id, 'mistake' AS kind, tag AS value FROM mistakes WHERE day >= DATE '{AS_OF}' - 14 UNION ALL SELECT user_id, 'practice', exercise_id::VARCHAR FROM practice_log WHERE day >= DATE '{AS_OF}' - 14 UNION ALL SELECT user_id, 'exposure', concept FROM exposures WHERE day >= DATE '{AS_OF}' - 14
  UNION ALL SELECT user_id, 'question', 'what is k' || k FROM learning_events WHERE event_type = 'view' AND day >= DATE '{AS_OF}' - 14),
c AS (SELECT user_id, kind, value, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY n DESC, value) AS r FROM c),
o AS (SELECT user_id, coalesce(sum(n) FILTER (kind = 'mistake'), 0)::BIGINT AS new_mistakes, count(*) FILTER (kind = 'practice') AS practised, count(*) FILTER (kind = 'practice' AND n >= 2) AS reviewed, coalesce(sum(n) FILTER (kind = 'exposure'), 0)::BIGINT AS exposures, coalesce(sum(n) FILTER (kind = 'question'), 0)::BIGINT AS questions,
  coalesce(string_agg(value, ',' ORDER BY r) FILTER (kind = 'exposure' AND r <= 10), '') AS top_concepts, coalesce(string_agg(value, ',' ORDER BY r) FILTER (kind = 'mistake' AND r <= 8), '') AS weak_points FROM k GROUP BY user_id)
SELECT *, CASE WHEN new_mistakes > 0 THEN 'review mistakes' WHEN practised = 0 THEN 'practise' ELSE 'go on' END AS suggestion FROM o""")
def le13_weekly_report(spark, sf_dir):
    asked = study.learning_events(spark, sf_dir).where("event_type = 'view'").select("user_id", "day", F.concat(F.lit("what is k"), "k").alias("question"))
    r = op.weekly_report(study.mistakes(spark, sf_dir), study.practice_log(spark, sf_dir), study.exposures(spark, sf_dir), asked, AS_OF, 14)
    lists = {c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",") for c in ("top_concepts", "weak_points")}
    return r.withColumns(lists)


TALK_SQL = r"""WITH c AS (SELECT *, CASE turn % 3 WHEN 0 THEN ['math', 'src1', 'physics', 'art'][conv_id % 4 + 1] ELSE ' ' END AS subject, CASE turn % 4 WHEN 1 THEN 'book ' || conv_id % 7 ELSE '' END AS book_name, conv_id * 1000 + turn AS created_at, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations),
ix AS (SELECT conv_id, coalesce(nullif(substr(trim(regexp_replace(min_by(text, turn) FILTER (role = 'user' AND back <= 40), '[ \t\n\r]+', ' ', 'g')), 1, 36), ''), '新会话') AS title, count(*) AS messages, count(*) FILTER (role = 'user') AS questions, count(*) FILTER (back <= 40) AS kept,
  coalesce(min_by(subject, back) FILTER (trim(subject) <> '' AND back <= 40), '') AS subject, coalesce(min_by(book_name, back) FILTER (trim(book_name) <> '' AND back <= 40), '') AS book_name, max_by(created_at, back) FILTER (back <= 40) AS created_at, min_by(created_at, back) AS updated_at FROM c GROUP BY conv_id)"""


def _talk(spark, sf_dir):
    """Turns that name a subject or a book now and then."""
    i, t = F.col("conv_id"), F.col("turn")
    subjects = F.array(*map(F.lit, ("math", "src1", "physics", "art")))
    return study.table(spark, sf_dir, "conversations").withColumns({
        "subject": F.when(t % 3 == 0, F.element_at(subjects, (i % 4 + 1).cast("int"))).otherwise(" "), "book_name": F.when(t % 4 == 1, F.concat(F.lit("book "), i % 7)).otherwise(""), "created_at": i * 1000 + t})


@query(TALK_SQL + " SELECT * FROM ix")
def le14_conversation_index(spark, sf_dir):
    return op.conversation_index(_talk(spark, sf_dir))


@query(TALK_SQL + " SELECT conv_id, title, updated_at FROM ix WHERE subject IN ('math', 'src1') ORDER BY updated_at DESC, conv_id DESC LIMIT 20")
def le14_newest_conversations(spark, sf_dir):
    """The newest conversations on a subject or one below it."""
    return op.conversation_index(_talk(spark, sf_dir), subject="math", tree={"math": ["src1"]}, limit=20).select("conv_id", "title", "updated_at")


@query(BASE + " SELECT conv_id AS owner, 'chat_qa' AS event_type, turn::VARCHAR AS ref FROM conversations WHERE role = 'user' UNION ALL SELECT DISTINCT user_id, 'concept_exposure', concept FROM exposures WHERE confidence >= 0.85 UNION ALL SELECT DISTINCT user_id, 'concept_candidates', '' FROM exposures WHERE confidence < 0.85")
def le18_qa_events(spark, sf_dir):
    return op.qa_events(study.table(spark, sf_dir, "conversations"), study.exposures(spark, sf_dir))


@query(BASE + f""", old AS (SELECT user_id, concept FROM ({FORGOTTEN_SQL.format(1, 5)}) WHERE rank <= 3), rare AS (SELECT user_id, concept FROM reviewed WHERE exposure_count <= 2)
SELECT event_id, user_id, concept, (user_id, concept) IN (SELECT (user_id, concept) FROM old) AS forgotten, (user_id, concept) IN (SELECT (user_id, concept) FROM rare) AS rare FROM exposures
WHERE source = 'view' AND ((user_id, concept) IN (SELECT (user_id, concept) FROM old) OR (user_id, concept) IN (SELECT (user_id, concept) FROM rare))""")
def le19_learning_reminders(spark, sf_dir):
    return op.learning_reminders(study.exposures(spark, sf_dir).where("source = 'view'"), _state(spark, sf_dir), AS_OF)

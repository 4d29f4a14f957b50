"""Queries on exercises."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import questions as q
from scholia.operators import exercises as op
from scholia.sources import study
from scholia.sources.study import with_study
from scholia.streaming import sessions

from .registry import query

# documents as import texts: every other one has its lines numbered, some with options
TEXTS_SQL = r"""texts AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i || '. ' || x || CASE WHEN i % 3 = 0 THEN ' A. x B. y C. z' WHEN i % 3 = 1 THEN ' prove lim (1) and (2) =' ELSE '' END), chr(10)) ELSE text END AS text FROM documents)"""


def _texts(spark, sf_dir):
    tail = lambda i: F.when((i + 1) % 3 == 0, " A. x B. y C. z").when((i + 1) % 3 == 1, " prove lim (1) and (2) =").otherwise("")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, tail(i)))
    return study.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.array_join(lines, "\n")).otherwise(F.col("text")).alias("text"))


def _n(pattern: str, x: str = "block") -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _hits(needles, x="low") -> str:
    return " + ".join(f"contains({x}, '{n.lower()}')::INT" for n in needles)


BLOCKS_SQL = rf"""t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g')) AS t FROM texts),
m AS (SELECT doc_id, string_split(regexp_replace(t, '({q.QUESTION_START})', chr(1) || '\1', 'g'), chr(1)) AS a, regexp_split_to_array(t, '\n\s*\n') AS b FROM t),
c AS (SELECT doc_id, list_filter(list_transform(a[2:], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 4) AS a, list_filter(list_transform(b, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 1) AS b FROM m),
x AS (SELECT doc_id, len(a) > 0 AS numbered, (CASE WHEN len(a) > 0 THEN a ELSE b END)[1:200] AS x FROM c),
blocks AS (SELECT doc_id, numbered, unnest(x) AS block, (generate_subscripts(x, 1) - 1)::INT AS pos FROM x),
scored AS (SELECT *, lower(block) AS low, round(greatest(0.05::DOUBLE, least(0.98::DOUBLE, round(0.25::DOUBLE + CASE WHEN numbered THEN 0.35::DOUBLE ELSE 0.15::DOUBLE END + CASE WHEN length(block) >= 30 THEN 0.1::DOUBLE ELSE -0.12::DOUBLE END
  + CASE WHEN {_n(q.OPTION)} >= 3 THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN {_n(q.SUBQUESTION)} > 0 THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN {_n(q.QUESTION_START)} > 1 THEN 0.18::DOUBLE ELSE 0 END
  - CASE WHEN length(block) > 2500 THEN 0.18::DOUBLE ELSE 0 END - CASE WHEN {_n(q.MARKER)} = 0 THEN 0.08::DOUBLE ELSE 0 END, 6))), 2) AS split_confidence FROM blocks)"""


@query(f"WITH {TEXTS_SQL}, {BLOCKS_SQL} SELECT doc_id, pos, block, numbered FROM blocks")
def ex3_split_questions(spark, sf_dir):
    return op.split_questions(_texts(spark, sf_dir)).select("doc_id", "pos", "block", "numbered")


@query(f"WITH {TEXTS_SQL}, {BLOCKS_SQL} SELECT doc_id, pos, split_confidence FROM scored")
def ex4_score_split(spark, sf_dir):
    return op.score_split(op.split_questions(_texts(spark, sf_dir))).select("doc_id", "pos", "split_confidence")


_TYPE = f"CASE WHEN {_n(q.OPTION)} >= 3 THEN '{q.CHOICE}' " + " ".join(f"WHEN ({_hits(ks)}) > 0 THEN '{t}'" for t, ks in q.TYPES) + f" WHEN {_n(q.SUBQUESTION)} >= 2 THEN '{q.COMPOSITE}' ELSE '{q.UNKNOWN}' END"
_TAGS = "list_transform(list_sort(list_filter([" + ", ".join(f"{{'s': -({_hits(ks)}), 'i': {i}, 'c': '{c}'}}" for i, (c, ks) in enumerate(q.CONCEPT_WORDS)) + "], lambda x: x.s < 0)), lambda x: x.c)[1:5]"


@query(f"""WITH {TEXTS_SQL}, {BLOCKS_SQL}, a AS (SELECT *, {_TYPE} AS type, {_TAGS} AS tags,
  greatest(1, least(5, 2 + (length(block) > 180)::INT + ({_n(q.SUBQUESTION)} >= 2)::INT + ({_n(q.MATH)} > 0)::INT + (({_hits(q.HARD)}) > 0)::INT)) AS difficulty FROM scored),
b2 AS (SELECT *, 0.25::DOUBLE + CASE WHEN type <> '{q.UNKNOWN}' THEN 0.25::DOUBLE ELSE 0 END + least(0.3::DOUBLE, 0.12::DOUBLE * len(tags)) + CASE WHEN length(block) >= 30 THEN 0.1::DOUBLE ELSE 0 END AS raw FROM a),
c2 AS (SELECT *, round(least(0.95::DOUBLE, greatest(0.05::DOUBLE, round(CASE WHEN split_confidence > 0 THEN raw * 0.75::DOUBLE + split_confidence * 0.25::DOUBLE ELSE raw END, 6))), 2) AS confidence FROM b2)
SELECT doc_id, pos, type, array_to_string(tags, ',') AS tags, difficulty, confidence, confidence < 0.65 OR len(tags) = 0 OR type = '{q.UNKNOWN}' OR split_confidence < 0.55 AS needs_review FROM c2""")
def ex5_analyse_candidates(spark, sf_dir):
    d = op.analyse_candidates(op.score_split(op.split_questions(_texts(spark, sf_dir))))
    return d.select("doc_id", "pos", "type", F.array_join("tags", ",").alias("tags"), "difficulty", "confidence", "needs_review")


@query(rf"""WITH {TEXTS_SQL}, {BLOCKS_SQL}, n AS (SELECT *, try_cast(nullif(regexp_extract(block, '^\s*(?:第\s*)?(\d{{1,9}})\s*(?:题|[\.、．\)])', 1), '') AS INT) AS number FROM blocks),
ans AS (SELECT doc_id, number, max_by(block, pos) AS answer FROM n WHERE number IS NOT NULL AND pos % 2 = 0 GROUP BY ALL)
SELECT n.doc_id, n.pos, n.number, answer IS NULL AS missing, length(answer) AS answer_chars FROM n LEFT JOIN ans ON ans.doc_id = n.doc_id AND ans.number = n.number""")
def ex6_attach_answers(spark, sf_dir):
    b = op.split_questions(_texts(spark, sf_dir))
    return op.attach_answers(b, b.where("pos % 2 = 0").select("doc_id", "pos", F.col("block").alias("text"))).select("doc_id", "pos", "number", "missing", F.length("answer").alias("answer_chars"))


FP_SQL = f"CASE WHEN regexp_replace(lower(question_text), '{q.SPACES}', '', 'g') <> '' THEN sha256(regexp_replace(lower(question_text), '{q.SPACES}', '', 'g')) END"


@query(with_study("exercises") + f" SELECT exercise_id, {FP_SQL} AS fp FROM exercises")
def ex7_fingerprint(spark, sf_dir):
    return study.exercises(spark, sf_dir).select("exercise_id", q.fingerprint(F.col("question_text")).alias("fp"))


@query(with_study("exercises") + f", f AS (SELECT *, {FP_SQL} AS fp FROM exercises), o AS (SELECT fp, min_by(exercise_id, (created_sec, exercise_id)) AS duplicate_of FROM f WHERE exercise_id % 2 = 0 AND fp IS NOT NULL GROUP BY fp) SELECT exercise_id, duplicate_of FROM f LEFT JOIN o USING (fp) WHERE exercise_id % 2 = 1")
def ex8_mark_duplicates(spark, sf_dir):
    e = study.exercises(spark, sf_dir)
    return op.mark_duplicates(e.where("exercise_id % 2 = 1"), e.where("exercise_id % 2 = 0")).select("exercise_id", "duplicate_of")


@query(with_study("exercises") + f""", f AS (SELECT *, {FP_SQL} AS fp FROM exercises), o AS (SELECT fp, min(exercise_id) AS d FROM f WHERE exercise_id % 2 = 0 AND fp IS NOT NULL GROUP BY fp)
SELECT exercise_id, coalesce(d, CASE WHEN fp IS NOT NULL AND first <> exercise_id THEN first END) AS duplicate_of FROM (SELECT *, min(exercise_id) OVER (PARTITION BY book_id, coalesce(fp, exercise_id::VARCHAR)) AS first FROM f WHERE exercise_id % 2 = 1) LEFT JOIN o USING (fp)""")
def ex9_import_batch(spark, sf_dir):
    e = study.exercises(spark, sf_dir)
    return op.import_batch(e.where("exercise_id % 2 = 1"), e.where("exercise_id % 2 = 0")).select("exercise_id", "duplicate_of")


@query(with_study("exercises") + " SELECT exercise_id, status FROM exercises WHERE book_id NOT IN ('src1', 'src2')")
def ex10_rollback_batch(spark, sf_dir):
    e = study.exercises(spark, sf_dir)
    batches = e.groupBy(F.col("book_id").alias("id")).agg(F.collect_list("exercise_id").alias("exercise_ids"))
    return op.rollback_batch(e, batches, ["src1", "src2"]).select("exercise_id", "status")


TREE = {"math": ["src1", "src2", "src3"], "physics": ["src4", "src5"]}


@query(with_study("exercises") + " SELECT exercise_id, book_id FROM exercises WHERE list_contains(tags, 'en') AND status = 'practicing' AND book_id IN ('math', 'src1', 'src2', 'src3') AND contains(exercise_id::VARCHAR, '1') AND (contains(lower(question_text), 'the') OR contains(lower(book_id), 'the') OR contains(lower(tags[1]), 'the')) ORDER BY created_sec DESC, exercise_id DESC LIMIT 50")
def ex11_filter_records(spark, sf_dir):
    e = study.exercises(spark, sf_dir).withColumn("subject", F.col("book_id")).withColumn("chapter", F.col("exercise_id").cast("string"))
    return op.filter_records(e, ["question_text", "book_id"], "en", "practicing", "THE", "math", "1", TREE).select("exercise_id", "book_id")


@query(with_study("exercises") + " SELECT book_id, kind, value, count(*) AS n FROM (SELECT book_id, 'status' AS kind, status AS value FROM exercises UNION ALL SELECT book_id, 'tag', tags[1] FROM exercises UNION ALL SELECT book_id, 'all', 'all' FROM exercises) GROUP BY ALL")
def ex12_exercise_stats(spark, sf_dir):
    from scholia.operators.review import counts_by

    return counts_by(study.exercises(spark, sf_dir), {"status": F.col("status"), "tag": F.get("tags", F.lit(0)), "all": F.lit("all")}, ["book_id"])


PSTATE_SQL = with_study("practice_log") + """, ps AS (SELECT *, CASE WHEN last_quality >= 4 THEN 'mastered' WHEN last_quality >= 3 THEN 'practicing' ELSE 'needs_review' END AS status FROM (
  SELECT user_id, exercise_id, max_by(quality, (ts, event_id)) AS last_quality, count(*) AS practice_count, max(ts) AS last_practiced FROM practice_log GROUP BY ALL))"""


@query(PSTATE_SQL + " SELECT user_id, exercise_id, last_quality, practice_count, status FROM ps")
def ex13_practice_state(spark, sf_dir):
    return op.practice_state(study.practice_log(spark, sf_dir)).select("user_id", "exercise_id", "last_quality", "practice_count", "status")


@query(PSTATE_SQL + " SELECT user_id, exercise_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE status WHEN 'needs_review' THEN 0 WHEN 'practicing' THEN 1 ELSE 3 END, practice_count, last_practiced, exercise_id) AS rank FROM ps) WHERE rank <= 10")
def ex14_select_practice(spark, sf_dir):
    return op.select_practice(op.practice_state(study.practice_log(spark, sf_dir))).select("user_id", "exercise_id", "rank")


@query(PSTATE_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, sel AS (SELECT user_id, exercise_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE status WHEN 'needs_review' THEN 0 WHEN 'practicing' THEN 1 ELSE 3 END, practice_count, last_practiced, exercise_id) AS rank FROM ps),
ses AS (SELECT user_id, list(exercise_id ORDER BY rank) AS ids FROM sel WHERE rank <= 5 GROUP BY user_id), an AS (SELECT user_id, exercise_id, event_id, quality, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM practice_log),
walk AS (SELECT an.user_id, an.exercise_id, event_id, quality, i, ids, (an.exercise_id = ids[1])::INT AS step, an.exercise_id = ids[1] AS ok FROM an JOIN ses USING (user_id) WHERE i = 1
  UNION ALL SELECT a.user_id, a.exercise_id, a.event_id, a.quality, a.i, w.ids, w.step + coalesce(a.exercise_id = w.ids[w.step + 1], false)::INT, coalesce(a.exercise_id = w.ids[w.step + 1], false) FROM walk w JOIN an a ON a.user_id = w.user_id AND a.i = w.i + 1)
SELECT user_id AS session_id, exercise_id, event_id AS seq, quality, ok AS accepted, step AS current_index, step = len(ids) AS completed FROM walk""")
def ex15_session_progress(spark, sf_dir):
    log = study.practice_log(spark, sf_dir).withColumn("session_id", F.col("user_id"))
    sessions = op.select_practice(op.practice_state(study.practice_log(spark, sf_dir)), 5).groupBy(F.col("user_id").alias("session_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "exercise_id"))), lambda x: x["exercise_id"].cast("long")).alias("exercise_ids"))
    return op.session_progress(sessions, log.select("session_id", F.col("exercise_id").cast("long").alias("exercise_id"), F.col("event_id").alias("seq"), "quality"))


# a user's sessions as a list that each event maps to the next one
SESSIONS_SQL = with_study("session_events", recursive=True) + """, ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i FROM session_events WHERE session_id IS NOT NULL),
walk AS (SELECT DISTINCT user_id, 0::BIGINT AS i, []::STRUCT(id BIGINT, status VARCHAR, ids INT[], at_ INT, mastered INT, struggling INT, updated BIGINT, ended BIGINT)[] AS ss FROM ev
  UNION ALL SELECT user_id, i, CASE
    WHEN kind = 'start' THEN list_transform(ss, lambda x: CASE WHEN x.id = open_id THEN struct_pack(id := x.id, status := 'replaced', ids := x.ids, at_ := x.at_, mastered := x.mastered, struggling := x.struggling, updated := seq, ended := seq) ELSE x END) || [struct_pack(id := session_id, status := 'active', ids := exercise_ids, at_ := 0, mastered := 0, struggling := 0, updated := seq, ended := NULL::BIGINT)]
    WHEN kind = 'answer' THEN list_transform(ss, lambda x: CASE WHEN x.id = session_id AND x.status = 'active' AND x.ids[x.at_ + 1] = exercise_id THEN struct_pack(id := x.id, status := CASE WHEN x.at_ = 2 THEN 'completed' ELSE 'active' END, ids := x.ids, at_ := x.at_ + 1, mastered := x.mastered + (quality >= 4)::INT, struggling := x.struggling + (quality < 3)::INT, updated := seq, ended := CASE WHEN x.at_ = 2 THEN seq ELSE x.ended END) ELSE x END)
    ELSE list_transform(ss, lambda x: CASE WHEN x.id = session_id AND x.status <> 'completed' THEN struct_pack(id := x.id, status := kind, ids := x.ids, at_ := x.at_, mastered := x.mastered, struggling := x.struggling, updated := seq, ended := CASE WHEN kind = 'abandoned' THEN seq ELSE x.ended END) ELSE x END) END
  FROM (SELECT e.*, ss, list_sort(list_transform(list_filter(ss, lambda x: x.status IN ('active', 'paused')), lambda x: [x.updated, x.id]), 'DESC')[1][2] AS open_id FROM walk w JOIN ev e ON e.user_id = w.user_id AND e.i = w.i + 1)),
st AS (SELECT user_id, s.id AS session_id, s.status AS status, s.at_ AS current_index, s.mastered AS mastered, s.struggling AS struggling, s.updated AS updated, s.ended AS ended FROM (SELECT user_id, unnest(ss) AS s FROM walk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1))"""


@query(SESSIONS_SQL + " SELECT * FROM st")
def ex15_session_states(spark, sf_dir):
    return sessions.session_states(study.session_events(spark, sf_dir)).drop("exercise_ids")


@query(SESSIONS_SQL + " SELECT user_id, session_id, status, updated FROM st WHERE status IN ('active', 'paused') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated DESC, session_id DESC) = 1")
def ex15_latest_session(spark, sf_dir):
    return sessions.latest_open(sessions.session_states(study.session_events(spark, sf_dir))).select("user_id", "session_id", "status", "updated")


@query(with_study("practice_log") + " SELECT user_id, 100 AS total, count(*) AS answered, greatest(0, 100 - count(*)) AS remaining, count(*) FILTER (quality >= 4) AS mastered, count(*) FILTER (quality < 3) AS struggling, round(avg(quality), 2) AS mean_quality FROM practice_log GROUP BY user_id")
def ex16_session_summary(spark, sf_dir):
    return op.session_summary(study.practice_log(spark, sf_dir), 100)


@query(with_study("practice_log") + " SELECT DISTINCT 'ps_' || substr(sha256('book' || chr(31) || user_id || chr(31) || exercise_id), 1, 16) AS id, user_id AS session_id, exercise_id FROM practice_log WHERE quality < 3 AND exercise_id >= 10")
def ex17_exercise_to_mistake(spark, sf_dir):
    log = study.practice_log(spark, sf_dir).select(F.lit("book").alias("book_id"), F.col("user_id").alias("session_id"), "exercise_id", "quality")
    return op.exercise_to_mistake(log, op.exercise_to_mistake(log.where("exercise_id < 10")))


@query(with_study("practice_log") + " SELECT DISTINCT 'ps_' || substr(sha256('book' || chr(31) || user_id || chr(31) || exercise_id), 1, 16) AS id, 'q' || exercise_id AS question_text, 'old q' || exercise_id AS known_text FROM practice_log WHERE quality < 3 AND exercise_id < 5")
def ex17_mistake_conflicts(spark, sf_dir):
    """Answers under known ids: exercises below 5 were stored with another text, those below 10 with the same."""
    log = study.practice_log(spark, sf_dir).select(F.lit("book").alias("book_id"), F.col("user_id").alias("session_id"), "exercise_id", "quality", F.concat(F.lit("q"), "exercise_id").alias("question_text"))
    known = op.exercise_to_mistake(log.where("exercise_id < 10")).withColumn("question_text", F.when(F.col("exercise_id") < 5, F.concat(F.lit("old "), "question_text")).otherwise(F.col("question_text")))
    return op.mistake_conflicts(op.exercise_to_mistake(log), known)


@query(with_study("mistakes") + " SELECT id AS origin_id, question_text, 'needs_review' AS status FROM mistakes WHERE id % 4 <> 0")
def ex18_mistake_to_exercise(spark, sf_dir):
    m = study.mistakes(spark, sf_dir)
    return op.mistake_to_exercise(m, m.where("id % 4 = 0").select(F.lit("mistake").alias("origin_type"), F.col("id").alias("origin_id"))).select("origin_id", "question_text", "status")


# every seventh chunk begins as an example, every eleventh as a numbered problem; titles by the chapter's number; two providers in some books
BOOK_SQL = with_study("chunks") + r""", bk AS (SELECT book_id, chapter, chunk_index, chunk_id, page_idx, ['definition', 'theorem', 'example', 'exercise', 'reference'][chunk_index % 5 + 1] AS role,
  CASE WHEN chunk_index % 7 = 0 THEN '例 3 ' || content WHEN chunk_index % 11 = 0 THEN '12、' || content ELSE content END AS content, ['一 习题', '前 言', 'text', '目次'][chapter::INT % 4 + 1] AS title, CASE WHEN book_id LIKE '%1' THEN chunk_index % 2 ELSE 2 END AS provider FROM chunks),
kept AS (SELECT *, contains(title, '习题') AS exercises, regexp_matches(content, '(^|\n)\s*(?:例\s*\d|例题|习题|练习|复习题|思考题|\d+[-\.、）)]|\(\d+\)|（\d+）)') AS problem, regexp_matches(content, '(^|\n)\s*例\s*\d|(^|\n)\s*例题') AS example FROM bk WHERE trim(content) <> '')"""
EARLIEST_SQL = """ SELECT chunk_id, page FROM (SELECT *, page_idx + 1 AS page, row_number() OVER (PARTITION BY book_id, content ORDER BY chapter, chunk_index) AS nth FROM (SELECT * FROM kept WHERE {0} QUALIFY provider = min(provider) OVER (PARTITION BY book_id))) WHERE nth = 1"""


def _book(spark, sf_dir):
    i, content = F.col("chunk_index"), F.col("content")
    roles = F.array(*map(F.lit, ("definition", "theorem", "example", "exercise", "reference")))
    titles = F.array(*map(F.lit, ("一 习题", "前 言", "text", "目次")))
    return study.chunks(spark, sf_dir).withColumns({
        "role": F.element_at(roles, i % 5 + 1), "content": F.when(i % 7 == 0, F.concat(F.lit("例 3 "), content)).when(i % 11 == 0, F.concat(F.lit("12、"), content)).otherwise(content),
        "title": F.element_at(titles, F.col("chapter").cast("int") % 4 + 1), "provider": F.when(F.col("book_id").endswith("1"), i % 2).otherwise(2)})


@query(BOOK_SQL + EARLIEST_SQL.format("NOT (title IN ('前 言', '目次')) AND (role IN ('example', 'exercise') OR problem OR exercises)"))
def ex1_extract_textbook_exercises(spark, sf_dir):
    return op.extract_textbook_exercises(_book(spark, sf_dir), "exercise_sections").select("chunk_id", "page")


@query(BOOK_SQL + EARLIEST_SQL.format("NOT (title IN ('前 言', '目次')) AND (role = 'example' OR example)"))
def ex1_extract_examples(spark, sf_dir):
    return op.extract_textbook_exercises(_book(spark, sf_dir), "examples").select("chunk_id", "page")


@query(BOOK_SQL + EARLIEST_SQL.format("NOT (title IN ('前 言', '目次')) AND problem AND page_idx BETWEEN 0 AND 2 AND contains(chapter, '1')"))
def ex1_extract_problems(spark, sf_dir):
    """Problems on the pages and in the chapters asked for."""
    return op.extract_textbook_exercises(_book(spark, sf_dir), "other", 1, 3, "1").select("chunk_id", "page")


@query(BOOK_SQL + EARLIEST_SQL.format("true"))
def ex1_extract_all_pages(spark, sf_dir):
    return op.extract_textbook_exercises(_book(spark, sf_dir)).select("chunk_id", "page")


@query(with_study("chunks") + r" SELECT chunk_id, CASE WHEN chunk_index % 3 = 0 THEN page_idx + 1 WHEN chunk_index % 3 = 1 THEN chapter::INT ELSE chunk_index END AS page FROM chunks")
def ex2_page_of(spark, sf_dir):
    c, i = study.chunks(spark, sf_dir), F.col("chunk_index") % 3
    return c.select("chunk_id", op.page_of(F.when(i == 0, F.col("page_idx")).otherwise(-1), F.when(i == 1, F.concat(F.lit("scan_"), "chapter", F.lit(".md"))), F.concat(F.lit("p. "), "chunk_index")).alias("page"))

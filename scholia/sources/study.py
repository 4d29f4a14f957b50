"""Study tables derived from the base tables: chunks, concepts, reviews, mistakes and the rest.

Each function takes (spark, sf_dir). STUDY_SQL states the same rules in SQL for cross-checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AS_OF = "2024-01-31"
CONCEPT_DOCS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each non-blank line of a document: book = source, chapter = document, five lines a page."""
    return _lines(table(spark, sf_dir, "documents"))


def _lines(documents: DataFrame, *more: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    d = documents.select("source", F.col("doc_id").cast("string").alias("chapter"), *more, F.posexplode(lines).alias("pos", "content"))
    return d.select(
        F.col("source").alias("book_id"), "chapter", F.concat_ws("_", "chapter", "pos").alias("chunk_id"),
        F.col("pos").cast("int").alias("chunk_index"), F.floor(F.col("pos") / 5).cast("int").alias("page_idx"), "content", *more,
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages a section."""
    c = chunks(spark, sf_dir).groupBy("book_id", "chapter", F.floor(F.col("page_idx") / 2).cast("int").alias("section_no")).agg(F.count(F.lit(1)))
    return c.select("book_id", "chapter", "section_no", (F.col("section_no") * 2).alias("start_page"), (F.col("section_no") * 2 + 1).alias("end_page"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and whether others have the same id (``again``): only their words may be the same rows twice."""
    d = table(spark, sf_dir, "documents")
    again = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id", F.lit(True).alias("again"))
    return d.join(F.broadcast(again), "doc_id", "left").withColumn("again", F.coalesce("again", F.col("doc_id").isNull()))


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, and whether other documents have the same id (``again``)."""
    return _lines(_documents(spark, sf_dir), "again")


def _once(rows: DataFrame) -> DataFrame:
    """Distinct rows, where those that aren't ``again`` are so already and needn't be shuffled."""
    return rows.where("not again").drop("again").union(rows.where("again").drop("again").distinct())


def _words6(text: str) -> Column:
    """The distinct lower-case ASCII words of six letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{6,}"), F.lit(0)))


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word that CONCEPT_DOCS documents or more have; the id follows from the word."""
    w = _documents(spark, sf_dir).select(F.col("doc_id").alias("chapter"), "again", F.explode(_words6("text")).alias("word"))
    df = _once(w).groupBy("word").agg(F.count("chapter").alias("n")).where(F.col("n") >= CONCEPT_DOCS)
    return df.select(F.concat(F.lit("c"), F.substring(F.md5("word"), 1, 12)).alias("concept_id"), F.col("word").alias("canonical_name"), F.array(F.col("word"), F.concat("word", F.lit("s"))).alias("aliases"))


def occurrences(spark: SparkSession, sf_dir: str, known: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """Where a chunk has a concept's name as a word; the role is by position in the page. ``known`` concepts needn't be worked out
    again; ``where`` keeps those of some chunks."""
    c = (concepts(spark, sf_dir) if known is None else known).select("concept_id", "canonical_name")
    lines = _lines(_documents(spark, sf_dir), "again")
    w = _once((lines if where is None else lines.where(where)).select("book_id", "chapter", "chunk_index", "again", F.explode(_words6("content")).alias("word")))
    roles = F.array(*map(F.lit, ("definition", "theorem", "example", "exercise", "reference")))
    i = F.col("chunk_index")
    return w.join(c, w["word"] == c["canonical_name"]).select(
        "concept_id", "canonical_name", "book_id", "chapter", F.concat_ws("_", "chapter", i).alias("chunk_id"), "chunk_index", F.floor(i / 5).cast("int").alias("page_idx"), F.element_at(roles, i % 5 + 1).alias("role"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part depends on the next part of its order."""
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    d = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source_id"), nxt.alias("target_id"), F.col("l_orderkey").alias("evidence"))
    return d.where("target_id is not null and source_id <> target_id").select("source_id", F.lit("depends_on").alias("relation"), "target_id", "evidence")


def _events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events")
    if kind:
        e = e.where(F.col("event_type") == kind)
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("day", F.to_date("ts"))


def exercises(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("new", "practicing", "needs_review", "mastered"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("exercise_id"), F.col("source").alias("book_id"), F.col("text").alias("question_text"),
        F.col("doc_id").alias("created_sec"), status.alias("status"), F.array("lang").alias("tags"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "purchase").select("user_id", (F.col("k") % 10).alias("card_id"), "ts", "day", "event_id", (F.floor("value") % 6).cast("int").alias("quality"))


def practice_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "click").select("user_id", F.col("k").alias("exercise_id"), "ts", "day", "event_id", (F.floor("value") % 6).cast("int").alias("quality"))


def quiz(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.least(F.floor("value"), F.lit(100)).cast("int")
    return _events(spark, sf_dir, "view").select("user_id", (F.col("k") % 10).alias("chapter"), "ts", "day", "event_id", score.alias("score"), (score >= 60).alias("correct"))


def mistakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("concept", "calculation", "reading", "method", "other")))
    n = (F.col("event_id") % 5 + 1).cast("int")
    return _events(spark, sf_dir, "error").select(
        F.col("event_id").alias("id"), "user_id", "ts", "day", F.concat(F.lit("k"), "k").alias("tag"), F.element_at(kinds, n).alias("mistake_type"), n.alias("difficulty"),
        F.concat(F.lit("question about k"), "k").alias("question_text"),
    )


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        "event_id", "user_id", F.concat(F.lit("k"), "k").alias("concept"), "ts", "day", (F.lit(0.5) + (F.col("event_id") % 50) / 100).alias("confidence"),
        (F.col("event_type") == "error").alias("weak"), F.col("event_type").alias("source"), F.concat(F.lit("what is k"), "k").alias("question"),
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases start a session of three exercises; clicks answer in it; views, errors and sign-ups set the status of the last session or, for some, of the first."""
    e = _events(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("event_id")
    started = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    last, first = F.last(started, True).over(w), F.first(started, True).over(w)
    kind = F.when(F.col("event_type") == "purchase", "start").when(F.col("event_type") == "click", "answer").when(F.col("event_type") == "error", "paused").when((F.col("event_type") == "signup") & (F.col("k") % 3 == 0), "abandoned").otherwise("active")
    ids = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: ((F.col("k") + i) % 3).cast("long"))
    return e.select(
        "user_id", F.col("event_id").alias("seq"), kind.alias("kind"), F.when((kind == "active") & (F.col("k") % 5 == 0), first).otherwise(last).alias("session_id"),
        F.when(kind == "start", ids).alias("exercise_ids"), (F.col("k") % 3).cast("long").alias("exercise_id"), (F.floor("value") % 6).cast("int").alias("quality"),
    )


def learning_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("event_id").alias("id"), "event_type", "ts", "day", "user_id", "props", "k", "value")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("event_id").alias("request_id"), "user_id", "ts", F.col("event_type").alias("stage"), F.col("value").alias("ms"))


def pages_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and paragraphs of the raw pages, in order."""
    tags = F.regexp_extract_all("html", F.lit("<(h1|p)>([^<]*)"), F.lit(0))
    d = table(spark, sf_dir, "pages").select("page_id", F.posexplode(tags).alias("pos", "raw"))
    return d.select("page_id", "pos", F.when(F.col("raw").startswith("<h1>"), "title").otherwise("text").alias("type"), F.regexp_replace("raw", "^<(h1|p)>", "").alias("text"))


_EVENTS = "(SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(ts AS DATE) AS day FROM events)"
STUDY_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "chunks": ((), """SELECT source AS book_id, doc_id::VARCHAR AS chapter, doc_id || '_' || pos AS chunk_id, pos::INT AS chunk_index, (pos // 5)::INT AS page_idx, content
        FROM (SELECT source, doc_id, unnest(ls) AS content, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT source, doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents))"""),
    "sections": (("chunks",), "SELECT DISTINCT book_id, chapter, page_idx // 2 AS section_no, page_idx // 2 * 2 AS start_page, page_idx // 2 * 2 + 1 AS end_page FROM chunks"),
    "queries": ((), "SELECT item_id AS query_id, text FROM benchmark"),
    "words6": (("chunks",), "SELECT *, unnest(regexp_extract_all(lower(content), '[a-z]{6,}')) AS word FROM chunks"),
    "concepts": (("words6",), f"""SELECT 'c' || substr(md5(word), 1, 12) AS concept_id, word AS canonical_name, [word, word || 's'] AS aliases
        FROM (SELECT word FROM words6 GROUP BY word HAVING count(DISTINCT chapter) >= {CONCEPT_DOCS})"""),
    "occurrences": (("words6", "concepts"), """SELECT DISTINCT concept_id, canonical_name, book_id, chapter, chunk_id, chunk_index, page_idx, ['definition', 'theorem', 'example', 'exercise', 'reference'][chunk_index % 5 + 1] AS role
        FROM words6 JOIN concepts ON word = canonical_name"""),
    "relations": ((), """SELECT source_id, 'depends_on' AS relation, target_id, evidence FROM (SELECT l_partkey AS source_id, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS target_id, l_orderkey AS evidence FROM lineitem)
        WHERE target_id IS NOT NULL AND source_id <> target_id"""),
    "exercises": ((), "SELECT doc_id AS exercise_id, source AS book_id, text AS question_text, doc_id AS created_sec, ['new', 'practicing', 'needs_review', 'mastered'][doc_id % 4 + 1] AS status, [lang] AS tags FROM documents"),
    "reviews": ((), f"SELECT user_id, k % 10 AS card_id, ts, day, event_id, floor(value)::INT % 6 AS quality FROM {_EVENTS} WHERE event_type = 'purchase'"),
    "practice_log": ((), f"SELECT user_id, k AS exercise_id, ts, day, event_id, floor(value)::INT % 6 AS quality FROM {_EVENTS} WHERE event_type = 'click'"),
    "quiz": ((), f"SELECT user_id, k % 10 AS chapter, ts, day, event_id, least(floor(value), 100)::INT AS score, least(floor(value), 100) >= 60 AS correct FROM {_EVENTS} WHERE event_type = 'view'"),
    "mistakes": ((), f"SELECT event_id AS id, user_id, ts, day, 'k' || k AS tag, ['concept', 'calculation', 'reading', 'method', 'other'][event_id % 5 + 1] AS mistake_type, (event_id % 5 + 1)::INT AS difficulty, 'question about k' || k AS question_text FROM {_EVENTS} WHERE event_type = 'error'"),
    "exposures": ((), f"SELECT event_id, user_id, 'k' || k AS concept, ts, day, 0.5::DOUBLE + (event_id % 50) / 100::DOUBLE AS confidence, event_type = 'error' AS weak, event_type AS source, 'what is k' || k AS question FROM {_EVENTS}"),
    "session_events": ((), f"""SELECT user_id, event_id AS seq, kind, CASE WHEN kind = 'active' AND k % 5 = 0 THEN first_one ELSE last_one END AS session_id, CASE WHEN kind = 'start' THEN [k % 3, (k + 1) % 3, (k + 2) % 3] END AS exercise_ids, k % 3 AS exercise_id, floor(value)::INT % 6 AS quality
        FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN 'start' WHEN event_type = 'click' THEN 'answer' WHEN event_type = 'error' THEN 'paused' WHEN event_type = 'signup' AND k % 3 = 0 THEN 'abandoned' ELSE 'active' END AS kind,
        last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS last_one, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS first_one
        FROM {_EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""),
    "learning_events": ((), f"SELECT event_id AS id, event_type, ts, day, user_id, props, k, value FROM {_EVENTS}"),
    "traces": ((), "SELECT event_id AS request_id, user_id, ts, event_type AS stage, value AS ms FROM events"),
    "pages_items": ((), """SELECT page_id, pos, CASE WHEN raw LIKE '<h1>%' THEN 'title' ELSE 'text' END AS type, regexp_replace(raw, '^<(h1|p)>', '') AS text
        FROM (SELECT page_id, unnest(r) AS raw, generate_subscripts(r, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '<(h1|p)>([^<]*)') AS r FROM pages))"""),
}


def with_study(*names: str, recursive: bool = False) -> str:
    """``WITH`` and the named study tables, with what they need, in order."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in STUDY_SQL[n][0]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS ({STUDY_SQL[n][1]})" for n in order)

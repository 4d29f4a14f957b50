"""Queries that write files and read them back, and streams over the event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.sources import study, tables
from scholia.sources.study import with_study
from scholia.streaming import reviews as st
from scholia.streaming import sessions

from .registry import query
from .exercises import SESSIONS_SQL
from .review import CARDS_SQL

PAGES_A_FILE = 100


@query("SELECT page_id % 50 AS book, count(*) AS items, sum(length(trim(text)))::BIGINT AS chars FROM (" + study.STUDY_SQL["pages_items"][1] + ") WHERE trim(text) <> '' GROUP BY 1")
def io1_read_ocr_content(spark, sf_dir):
    """Page items written as JSON arrays, one a run of at most PAGES_A_FILE pages of a book, then read as OCR content."""
    i = study.pages_items(spark, sf_dir).where(F.trim("text") != "").withColumn("book", F.col("page_id") % 50).withColumn("run", F.floor(F.col("page_id") / (50 * PAGES_A_FILE)))
    path = tables.scratch(spark, "ocr-content")
    listed = F.array_sort(F.collect_list(F.struct("page_id", "pos", "type", "text")))
    js = i.groupBy("book", "run").agg(F.to_json(F.transform(listed, lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text"), x["pos"].alias("page_idx")))).alias("value"))
    js.repartition("book", "run").write.partitionBy("book", "run").text(path)
    d = tables.read_ocr_content(spark, path)
    return d.groupBy("book").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("text")).alias("chars"))


@query("SELECT source, count(*) AS lines, sum(length(trim(x)))::BIGINT AS chars FROM (SELECT source, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE trim(x) <> '' GROUP BY source")
def io2_read_ocr_middle(spark, sf_dir):
    """Documents as page trees, a file each (a line a span; every other line in a nested block), flattened again."""
    d = study.table(spark, sf_dir, "documents").withColumn("row", F.monotonically_increasing_id())
    span = lambda x: F.array(F.struct(F.array(F.struct(x.alias("content"))).alias("spans")))
    none = F.array().cast("array<struct<spans:array<struct<content:string>>>>")
    block = lambda x, i: F.struct(F.lit("text").alias("type"), F.when(i % 2 == 0, span(x)).otherwise(none).alias("lines"), F.when(i % 2 == 1, F.array(F.struct(F.lit("list").alias("type"), span(x).alias("lines")))).alias("blocks"))
    page = F.struct(F.lit(0).alias("page_idx"), F.transform(F.split("text", "\n"), block).alias("para_blocks"))
    path = tables.scratch(spark, "ocr-middle")
    d.select("source", F.to_json(F.struct(F.array(page).alias("pdf_info"))).alias("value")).write.partitionBy("source").option("lineSep", "\n").text(path)
    b = tables.read_ocr_middle(spark, path, whole_files=False)
    return b.groupBy("source").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


@query(with_study("chunks") + " SELECT chunk_id, book_id, CASE chunk_index % 2 WHEN 0 THEN 'derivation' ELSE 'reference' END AS role, -1 AS page_idx, 1.0::DOUBLE AS rag_priority, length(content) AS chars FROM chunks")
def io3_read_chunk_jsonl(spark, sf_dir):
    c, path = study.chunks(spark, sf_dir), tables.scratch(spark, "chunk-lines")
    c.select("chunk_id", F.col("content").alias("text"), F.when(F.col("chunk_index") % 2 == 0, "formula").otherwise("text").alias("role"), "book_id").write.json(path)
    return tables.read_chunk_jsonl(spark, path).select("chunk_id", "book_id", "role", "page_idx", "rag_priority", F.length("text").alias("chars"))


@query("SELECT count(*) AS lines, sum(length(x))::BIGINT AS chars FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents) WHERE x <> ''")
def io4_read_markdown(spark, sf_dir):
    path = tables.scratch(spark, "markdown")
    study.table(spark, sf_dir, "documents").select(F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("value")).write.text(path)
    return tables.read_markdown(spark, path).where("text <> ''").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


@query(with_study("chunks") + " SELECT chunk_id, book_id, length(content) AS chars FROM chunks WHERE book_id = 'src5'")
def io5_write_read_table(spark, sf_dir):
    path = tables.scratch(spark, "chunks")
    tables.write_table(study.chunks(spark, sf_dir), path, "book_id")
    return tables.read_table(spark, path).where("book_id = 'src5'").select("chunk_id", "book_id", F.length("content").alias("chars"))


def _event_stream(spark, sf_dir, files_a_batch=None):
    schema = study.table(spark, sf_dir, "events").schema
    path = tables.scratch(spark, "events")
    study.table(spark, sf_dir, "events").write.parquet(path)
    s = spark.readStream.schema(schema)
    s = (s.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else s).parquet(path)
    return s.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")


@query("SELECT event_id AS id, user_id, event_type FROM events")
def st1_stream_events(spark, sf_dir):
    """The events twice over, as two streams into one log: each id is there once."""
    path = tables.scratch(spark, "log")
    e = _event_stream(spark, sf_dir, 1).select("id", "user_id", "event_type")
    st.append_stream(e.union(_event_stream(spark, sf_dir, 1).select("id", "user_id", "event_type")), path, tables.scratch(spark, "state"))
    return spark.read.parquet(path).drop("batch")


@query("SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL HAVING ts::DATE < (SELECT max(ts)::DATE - 1 FROM events)".replace("GROUP BY ALL HAVING ts::DATE <", "WHERE ts::DATE <") + " GROUP BY ALL")
def st2_stream_daily_counts(spark, sf_dir):
    """Days that the watermark, a day behind the newest event, has passed."""
    path = tables.scratch(spark, "days")
    st.run_to_table(st.stream_daily_counts(_event_stream(spark, sf_dir)), path, tables.scratch(spark, "state"))
    return spark.read.schema("day date, event_type string, n long").parquet(path).withColumn("day", F.col("day").cast("string"))


@query(CARDS_SQL + ' SELECT user_id, card_id, round(easiness, 4) AS easiness, "interval", repetitions FROM cards')
def st3_stream_reviews(spark, sf_dir):
    """Review state from the stream of purchases, the last row of each card."""
    e = _event_stream(spark, sf_dir).where("event_type = 'purchase'")
    r = e.select("user_id", (F.get_json_object("props", "$.k").cast("long") % 10).alias("card_id"), F.col("id").alias("seq"), (F.floor("value") % 6).cast("int").alias("quality"))
    path = tables.scratch(spark, "cards")

    def keep(batch, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(path)

    q = st.stream_reviews(r).writeStream.outputMode("update").option("checkpointLocation", tables.scratch(spark, "state")).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    d = spark.read.schema(f"{st.OUT}, batch int").parquet(path)
    last = d.groupBy("user_id", "card_id").agg(F.max_by(F.struct("easiness", "interval", "repetitions"), "batch").alias("s"))
    return last.select("user_id", "card_id", F.round("s.easiness", 4).alias("easiness"), "s.interval", "s.repetitions")


@query(SESSIONS_SQL + " SELECT * FROM st")
def st3_stream_sessions(spark, sf_dir):
    """Session states from a stream in three batches, the last of which brings all events again."""
    e, path = tables.written(study.session_events(spark, sf_dir).where("session_id is not null"), "session-events"), tables.scratch(spark, "session-batches")
    half = (e.agg(F.max("seq")).first()[0] or 0) // 2
    kept, state = tables.scratch(spark, "sessions"), tables.scratch(spark, "state")
    for part in (e.where(F.col("seq") <= half), e.where(F.col("seq") > half), e):  # a run takes all files that came since the one before
        part.write.mode("append").parquet(path)
        sessions.run_sessions(spark.readStream.schema(e.schema).parquet(path), kept, state)
    return sessions.latest_states(spark.read.schema(f"{sessions.STATES}, batch int").parquet(kept)).drop("exercise_ids")

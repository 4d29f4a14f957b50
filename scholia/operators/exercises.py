"""Exercises: import, duplicates, practice sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import questions as q
from scholia.sources.tables import written

from .review import subject_match

MARK = "\x01"


def split_questions(texts: DataFrame, limit: int = 200) -> DataFrame:
    """(doc_id, pos, block, numbered): a text is cut at question numbers or, without any, at blank lines."""
    t = F.trim(F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"[ \t]+", " "))
    marked = F.split(F.regexp_replace(t, f"({q.QUESTION_START})", f"{MARK}$1"), MARK)
    clean = lambda xs, least: F.filter(F.transform(xs, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) >= least)
    numbered = clean(F.slice(marked, F.lit(2), F.greatest(F.size(marked) - 1, F.lit(0))), 4)
    d = texts.select("doc_id", numbered.alias("a"), clean(F.split(t, r"\n\s*\n"), 1).alias("b"))
    d = d.select("doc_id", (F.size("a") > 0).alias("numbered"), F.slice(F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("b")), 1, limit).alias("x"))
    return d.select("doc_id", "numbered", F.posexplode("x").alias("pos", "block"))


def score_split(blocks: DataFrame) -> DataFrame:
    """Adds ``split_confidence``, and the block's ``marks`` for what else reads them."""
    d = blocks.withColumn("marks", q.marks(F.col("block")))
    return d.withColumn("split_confidence", q.split_confidence(F.col("block"), F.col("numbered"), F.col("marks")))


def analyse_candidates(blocks: DataFrame) -> DataFrame:
    """Type, tags, difficulty, confidence and whether a model or a person should look at the candidate."""
    t, m = F.col("block"), F.col("marks")
    d = blocks if "marks" in blocks.columns else blocks.withColumn("marks", q.marks(t))
    d = d.withColumn("type", q.question_type(t, m)).withColumn("tags", q.concept_tags(t)).withColumn("difficulty", q.difficulty(t, m))
    raw = F.lit(0.25) + F.when(F.col("type") != q.UNKNOWN, 0.25).otherwise(0.0) + F.least(F.lit(0.3), 0.12 * F.size("tags")) + F.when(F.length(t) >= 30, 0.1).otherwise(0.0)
    mixed = F.when(F.col("split_confidence") > 0, raw * 0.75 + F.col("split_confidence") * 0.25).otherwise(raw)
    d = d.withColumn("confidence", F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.round(mixed, 6))), 2))
    needs = (F.col("confidence") < 0.65) | (F.size("tags") == 0) | (F.col("type") == q.UNKNOWN) | ((F.col("split_confidence") > 0) & (F.col("split_confidence") < 0.55))
    issues = F.array_compact(F.array(
        F.when(F.length(t) < 12, "short"), F.when(m["starts"] > 1, "several"),
        F.when((F.col("split_confidence") > 0) & (F.col("split_confidence") < 0.55), "boundary"), F.when(F.size("tags") == 0, "no_tags"),
    ))
    return d.withColumn("needs_review", needs).withColumn("issues", issues).drop("marks")


def question_number(text: Column) -> Column:
    """The explicit number at the start, or null."""
    n = F.regexp_extract(text, r"^\s*(?:第\s*)?(\d{1,9})\s*(?:题|[\.、．\)])", 1)
    return F.when(n != "", n.cast("int"))


def attach_answers(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (doc_id, pos, text) joined by explicit number; of repeated numbers the last answer holds."""
    a = answers.withColumn("number", question_number(F.col("text"))).where("number is not null").groupBy("doc_id", "number").agg(F.max_by("text", "pos").alias("answer"))
    c = candidates.withColumn("number", question_number(F.col("block")))
    return c.join(a, ["doc_id", "number"], "left").withColumn("missing", F.col("answer").isNull())


def mark_duplicates(candidates: DataFrame, bank: DataFrame) -> DataFrame:
    """``duplicate_of``: the oldest bank row with the same fingerprint. Blank texts are no one's duplicate."""
    oldest = bank.withColumn("fp", q.fingerprint(F.col("question_text"))).where("fp is not null").groupBy("fp").agg(F.min_by("exercise_id", F.struct("created_sec", "exercise_id")).alias("duplicate_of"))
    c = candidates.withColumn("fp", q.fingerprint(F.col("question_text")))
    blank = c.where("fp is null").withColumn("duplicate_of", F.lit(None).cast("long"))
    return c.where("fp is not null").join(oldest, "fp", "left").unionByName(blank)


def import_batch(records: DataFrame, bank: DataFrame) -> DataFrame:
    """Each record with the id of its first holder, in the bank or earlier in the batch; null means accepted."""
    marked = mark_duplicates(records, bank)
    marked = written(marked.select(*records.columns, "fp", "duplicate_of"), "marked")  # each text is read and hashed once
    first = marked.where("fp is not null").groupBy("book_id", "fp").agg(F.min("exercise_id").alias("first"))
    out = marked.join(first, ["book_id", "fp"], "left")
    return out.withColumn("duplicate_of", F.coalesce("duplicate_of", F.when(F.col("first") != F.col("exercise_id"), F.col("first")))).drop("first")


def rollback_batch(bank: DataFrame, batches: DataFrame, ids: list) -> DataFrame:
    """The bank without the exercises of the given batches (id, exercise_ids)."""
    gone = batches.where(F.col("id").isin(ids)).select(F.explode("exercise_ids").alias("exercise_id"))
    return bank.join(gone, "exercise_id", "left_anti")


def filter_records(df: DataFrame, texts: list[str], tag: str | None = None, status: str | None = None, keyword: str = "", subject: str = "", chapter: str = "", tree: dict[str, list[str]] | None = None, limit: int = 50) -> DataFrame:
    """Newest first; the keyword may stand in any of the text columns or in a tag, in either case; subjects as ``subject_match`` takes them."""
    if tag:
        df = df.where(F.array_contains("tags", tag))
    if status:
        df = df.where(F.col("status") == status)
    if subject:
        df = df.where(subject_match(F.col("subject"), subject, tree or {}))
    if chapter:
        df = df.where(F.contains(F.lower("chapter"), F.lit(chapter.lower())))
    if keyword:
        k = keyword.lower()
        hit = F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(k)))
        for t in texts:
            hit = hit | F.coalesce(F.contains(F.lower(t), F.lit(k)), F.lit(False))
        df = df.where(hit)
    return df.orderBy(F.desc("created_sec"), F.desc("exercise_id")).limit(limit)


def practice_state(log: DataFrame) -> DataFrame:
    """Status from the last answer; number and last time."""
    last = F.greatest(F.lit(0), F.least(F.lit(5), F.max_by("quality", F.struct("ts", "event_id"))))
    s = log.groupBy("user_id", "exercise_id").agg(last.alias("last_quality"), F.count(F.lit(1)).alias("practice_count"), F.max("ts").alias("last_practiced"))
    return s.withColumn("status", F.when(F.col("last_quality") >= 4, "mastered").when(F.col("last_quality") >= 3, "practicing").otherwise("needs_review"))


def select_practice(state: DataFrame, n: int = 10, seed: int | None = None) -> DataFrame:
    """What to practise next: by status, fewest practices, oldest; a seed shuffles by hash instead."""
    rank = F.when(F.col("status") == "needs_review", 0).when(F.col("status") == "practicing", 1).when(F.col("status") == "mastered", 3).otherwise(2)
    order = [rank, "practice_count", "last_practiced", "exercise_id"] if seed is None else [F.xxhash64("exercise_id", F.lit(seed)), "exercise_id"]
    w = Window.partitionBy("user_id").orderBy(*order)
    return state.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, min(n, 200)))


PROGRESS = "session_id long, exercise_id long, seq long, quality int, accepted boolean, current_index int, completed boolean"


def session_progress(sessions: DataFrame, answers: DataFrame) -> DataFrame:
    """Replays answers (session_id, exercise_id, seq, quality) over sessions (session_id, exercise_ids).

    An answer counts if it is for the current exercise of the list; any other one, a replay too, changes nothing.
    """
    both = answers.join(sessions, "session_id").select("session_id", "exercise_id", "seq", "quality", "exercise_ids")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        ids, at, rows = list(pdf["exercise_ids"].iloc[0]), 0, []
        for r in pdf.itertuples():
            ok = at < len(ids) and r.exercise_id == ids[at]
            at += ok
            rows.append((r.session_id, r.exercise_id, r.seq, r.quality, ok, at, at == len(ids)))
        return pd.DataFrame(rows, columns=["session_id", "exercise_id", "seq", "quality", "accepted", "current_index", "completed"])

    return both.groupBy("session_id").applyInPandas(replay, PROGRESS)


def session_summary(answers: DataFrame, total: int) -> DataFrame:
    q_ = F.col("quality")
    return answers.groupBy("user_id").agg(
        F.lit(total).alias("total"), F.count(F.lit(1)).alias("answered"), F.greatest(F.lit(0), F.lit(total) - F.count(F.lit(1))).alias("remaining"),
        F.count_if(q_ >= 4).alias("mastered"), F.count_if(q_ < 3).alias("struggling"), F.round(F.avg("quality"), 2).alias("mean_quality"),
    )


def exercise_to_mistake(answers: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One mistake for each missed (session, exercise), with a stable id; those already known are left out (see ``mistake_conflicts``)."""
    key = F.concat_ws("\x1f", F.col("book_id"), F.col("session_id").cast("string"), F.col("exercise_id").cast("string"))
    m = answers.where("quality < 3").select(F.concat(F.lit("ps_"), F.substring(F.sha2(key, 256), 1, 16)).alias("id"), "session_id", "exercise_id", *(c for c in ("question_text",) if c in answers.columns)).dropDuplicates(["id"])
    return m.join(known.select("id"), "id", "left_anti") if known is not None else m


def mistake_conflicts(new: DataFrame, known: DataFrame) -> DataFrame:
    """New mistakes whose id is known with another text: an error that the caller must settle before they are stored."""
    k = known.select("id", F.col("question_text").alias("known_text"))
    return new.join(k, "id").where(~F.col("question_text").eqNullSafe(F.col("known_text"))).select("id", "question_text", "known_text")


def mistake_to_exercise(mistakes: DataFrame, bank: DataFrame) -> DataFrame:
    """Mistakes as exercises to review, unless an exercise has that origin."""
    m = mistakes.select(F.col("id").alias("origin_id"), F.lit("mistake").alias("origin_type"), "question_text", F.lit("needs_review").alias("status"))
    return m.join(bank.select("origin_type", "origin_id"), ["origin_type", "origin_id"], "left_anti")


def page_of(page_idx: Column, source_file: Column, source_ref: Column) -> Column:
    """One-based page: the index if known, else a number in the file name, else in the reference."""
    n = lambda c: F.when(F.regexp_extract(c, r"(\d{1,9})\D*$", 1) != "", F.regexp_extract(c, r"(\d{1,9})\D*$", 1).cast("int"))
    return F.coalesce(F.when(page_idx >= 0, page_idx + 1), n(source_file), n(source_ref))


# fixed values: what problems and examples begin with, and titles of exercise sections and of pages before the text
PROBLEM = r"(^|\n)\s*(?:例\s*\d|例题|习题|练习|复习题|思考题|\d+[-\.、）)]|\(\d+\)|（\d+）)"
EXAMPLE = r"(^|\n)\s*例\s*\d|(^|\n)\s*例题"
EXERCISE_TITLES = ("习题", "练习", "复习题", "思考题")
FRONT_TITLES = ("目录", "前言", "版权", "CIP", "图书在版编目")
CONTENTS_TITLE, CONTENTS_HEAD = "目次", 600


def _has_any(c: Column, parts) -> Column:
    return F.coalesce(F.greatest(*(F.contains(c, F.lit(p)) for p in parts), F.lit(False)), F.lit(False))


def _compact(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x{3000}]+", "")


def front_matter(title: Column, text: Column) -> Column:
    """Contents, preface and imprint: by the title, or by a list of the first two chapters at the text's beginning."""
    t, head = _compact(title), _compact(F.substring(text, 1, CONTENTS_HEAD))
    listed = F.contains(head, F.lit("目录")) & _has_any(head, ("第一章", "第1章")) & _has_any(head, ("第二章", "第2章"))
    return (t == CONTENTS_TITLE) | _has_any(t, FRONT_TITLES) | F.coalesce(listed, F.lit(False))


def extract_textbook_exercises(chunks: DataFrame, mode: str = "all_pages", first: int | None = None, last: int | None = None, chapter: str = "") -> DataFrame:
    """Chunks that hold exercises: by chapter and pages, then by role, text or section; one row for each text of a book, the earliest.

    chunks: book_id, chapter, chunk_index, chunk_id, page_idx, role, content and, where there are such, ``title`` (of the section)
    and ``provider`` (a number: of each book only the rows of its least provider that has any count). ``mode``: all_pages takes
    every text, examples what is or looks like an example, exercise_sections also exercises, problems and all of exercise
    sections, other what looks like a problem. A chunk without a chapter is in every chapter, one without a page in no range.
    """
    title = F.col("title") if "title" in chunks.columns else F.lit("")
    d = chunks.where(F.trim("content") != "").withColumn("page", F.when(F.col("page_idx") >= 0, F.col("page_idx") + 1))
    if chapter:
        c = _compact(F.col("chapter"))
        d = d.where((c == "") | F.contains(c, F.regexp_replace(F.lit(chapter), r"[\s\x{3000}]+", "")))
    if first is not None:
        d = d.where(F.col("page").between(first, last if last is not None else first))
    if mode != "all_pages":
        role, text = F.lower(F.trim(F.coalesce("role", F.lit("")))), F.col("content")
        taken = {
            "examples": (role == "example") | text.rlike(EXAMPLE),
            "exercise_sections": role.isin("exercise", "example") | text.rlike(PROBLEM) | _has_any(_compact(title), EXERCISE_TITLES),
        }.get(mode, text.rlike(PROBLEM))
        d = d.where(taken & ~front_matter(F.coalesce(F.when(_compact(title) != "", title), "chapter"), text))
    if "provider" in chunks.columns:
        best = d.groupBy("book_id").agg(F.min("provider").alias("best")).withColumnRenamed("book_id", "own")
        d = d.join(best, d["book_id"].eqNullSafe(best["own"]) & (d["provider"] == best["best"])).drop("own", "best")
    earliest = d.groupBy("book_id", "content").agg(F.min(F.struct("chapter", "chunk_index", "chunk_id", "page_idx", "page", "role")).alias("f"))
    return earliest.select("book_id", "content", "f.*")

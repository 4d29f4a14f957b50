"""Learning events, concept memory, plans and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mentions import names_in
from .review import normalise_subject, subject_match


def _day(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def full_days(as_of: str, ts: Column) -> Column:
    """Elapsed full days from ``ts`` to the start of ``as_of``."""
    return F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000)


def clean_names(names: Column, most: int = 20) -> Column:
    """Trimmed, non-empty, distinct in order, at most ``most``."""
    return F.slice(F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")), 1, most)


def append_events(new: DataFrame, log: DataFrame, key: str = "id", tree: dict[str, list[str]] | None = None) -> DataFrame:
    """The new events whose id the log lacks, one row per id; subjects in full, concept names clean, where there are such columns."""
    if "subject" in new.columns:
        new = new.withColumn("subject", normalise_subject(F.col("subject"), tree or {}))
    if "concepts" in new.columns:
        new = new.withColumn("concepts", clean_names(F.col("concepts")))
    return new.dropDuplicates([key]).join(log.select(key), key, "left_anti")


def recent_events(log: DataFrame, event_type: str | None = None, limit: int = 20, **equal: str) -> DataFrame:
    """A user's newest events, of a type and of columns (book, subject) with given values where asked for."""
    for c, v in {"event_type": event_type, **equal}.items():
        if v:
            log = log.where(F.col(c) == v)
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id"))
    return log.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


# fixed values: aliases that name nothing by themselves
GENERIC = ("方法", "步骤", "迭代", "迭代步骤", "程序框图", "原理", "过程", "算法", "约束", "优化", "优化方法", "最优化方法", "问题", "条件", "method", "step", "steps", "algorithm")


def strict_exposures(exposures: DataFrame, least: float = 0.85) -> DataFrame:
    """Confident exposures whose question names the concept, or an alias that isn't generic; those from mistakes are exempt of the naming."""
    q = F.lower("question")
    named = F.contains(q, F.lower("concept"))
    if "aliases" in exposures.columns:
        named = named | F.coalesce(F.exists("aliases", lambda a: (F.trim(a) != "") & ~F.trim(a).isin(*GENERIC) & F.contains(q, F.lower(F.trim(a)))), F.lit(False))
    return exposures.where((F.col("confidence") >= least) & (named | (F.col("source") == "error")))


def concept_state(exposures: DataFrame, most: int = 20) -> DataFrame:
    """Per user and concept: first and last seen, number, weak flag with its time and reason, and, each in order of appearance,
    the distinct sources and, where there are such columns, chapters, subjects and aliases, ``most`` of each.

    For these lists only a value's first row counts, so a group collects no more than its distinct values.
    """
    keys = ["user_id", "concept"]
    base = exposures.groupBy(*keys).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("exposure_count"), F.max("confidence").alias("max_confidence"),
        F.bool_or("weak").alias("weak"), F.max(F.when(F.col("weak"), F.col("ts"))).alias("weak_since"), F.max_by("source", F.when(F.col("weak"), F.struct("ts", "event_id"))).alias("weak_reason"),
    )
    for c, many in (("source", "sources"), ("chapter", "chapters"), ("subject", "subjects"), ("aliases", "all_aliases")):
        if c in exposures.columns:
            v = exposures.select(*keys, "ts", "event_id", (F.explode(c) if c == "aliases" else F.col(c)).alias("v")).where("v <> ''")
            v = v.groupBy(*keys, "v").agg(F.min(F.struct("ts", "event_id")).alias("o"))
            v = v.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("o", "v"))).where(F.col("r") <= most)
            base = base.join(v.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias(many)), keys, "left")
    return base


def apply_reviews(state: DataFrame, exposures: DataFrame, reviews: DataFrame) -> DataFrame:
    """Mastery is the best quality from 4 up; the last decisive event settles the weak flag.

    Weak exposures and reviews of quality 2 or less set it, quality 5 clears it.
    """
    marks = exposures.where("weak").select("user_id", "concept", "ts", "event_id", F.lit(True).alias("weak")).union(
        reviews.where("quality <= 2 or quality = 5").select("user_id", "concept", "ts", "event_id", (F.col("quality") <= 2).alias("weak")))
    last = marks.groupBy("user_id", "concept").agg(F.max_by("weak", F.struct("ts", "event_id")).alias("weak_now"))
    seen = reviews.groupBy("user_id", "concept").agg(F.max(F.when(F.col("quality") >= 4, F.col("quality"))).alias("mastery"), F.count(F.lit(1)).alias("review_count"), F.max("ts").alias("last_reviewed"))
    keys = ["user_id", "concept"]
    return state.join(last, keys, "left").join(seen, keys, "left").withColumn("weak", F.coalesce("weak_now", F.lit(False))).drop("weak_now").fillna(0, ["mastery", "review_count"])


def effective_weak(state: DataFrame, exposures: DataFrame, confused: str = "what is") -> DataFrame:
    """Weak concepts, unless all that speaks for it are questions without a phrase of confusion."""
    told = exposures.where(F.col("weak") & (F.contains("question", F.lit(confused)) | (F.col("source") == "error"))).select("user_id", "concept").distinct()
    return state.where("weak").join(told, ["user_id", "concept"], "left_semi")


def forgotten(state: DataFrame, as_of: str, days: int = 7, min_count: int = 2, limit: int = 3) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("days"), "concept")
    old = state.withColumn("days", full_days(as_of, F.col("last_seen"))).where((F.col("exposure_count") >= min_count) & (F.col("days") >= days))
    return old.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def frequent(state: DataFrame, limit: int = 12) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("exposure_count"), "concept")
    return state.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def review_queue(state: DataFrame, as_of: str, limit: int = 5) -> DataFrame:
    """Weak concepts first, then the long forgotten, each once, without those reviewed on the day."""
    weak = state.where("weak").select("user_id", "concept", F.lit(0).alias("grp"), (-full_days(as_of, F.col("last_seen"))).alias("k"))
    old = forgotten(state, as_of, 3, 2, limit).select("user_id", "concept", F.lit(1).alias("grp"), (-F.col("days")).alias("k"))
    both = weak.union(old).groupBy("user_id", "concept").agg(F.min(F.struct("grp", "k")).alias("o"))
    if "last_reviewed" in state.columns:
        both = both.join(state.where(F.to_date("last_reviewed") == _day(as_of)).select("user_id", "concept"), ["user_id", "concept"], "left_anti")
    w = Window.partitionBy("user_id").orderBy("o.grp", "o.k", "concept")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("user_id", "concept", F.when(F.col("o.grp") == 0, "weak").otherwise("forgotten").alias("reason"), "rank")


def memory_stats(state: DataFrame, as_of: str, exposures: DataFrame | None = None, least: float = 0.85) -> DataFrame:
    """Numbers of a user's memory, the three and twelve concepts met most, and exposures by source where they are given."""
    counts = state.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("concepts"), F.count_if(F.col("max_confidence") >= least).alias("strict"), F.sum("exposure_count").alias("exposures"), F.count_if("weak").alias("weak"),
        F.count_if((F.col("exposure_count") >= 2) & (full_days(as_of, F.col("last_seen")) >= 7)).alias("forgotten"),
    )
    top = frequent(state, 12).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "concept"))), lambda x: x["concept"]).alias("top12"))
    out = counts.join(top, "user_id", "left").withColumn("top3", F.slice("top12", 1, 3))
    if exposures is not None:
        by = exposures.groupBy("user_id", "source").count().groupBy("user_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "source", "count"))).alias("by_source"))
        out = out.join(by, "user_id", "left")
    return out


def daily_activity(exposures: DataFrame, events: DataFrame, latest: int = 14) -> DataFrame:
    """Per user and day the exposures from questions and mistakes, and events that no exposure of the day has."""
    new = events.join(exposures.select("user_id", "day", "question"), ["user_id", "day", "question"], "left_anti").select("user_id", "day", F.lit("qa").alias("kind"))
    old = exposures.select("user_id", "day", F.when(F.col("source") == "error", "mistake").otherwise("qa").alias("kind"))
    c = old.union(new).groupBy("user_id", "day").agg(F.count_if(F.col("kind") == "qa").alias("qa"), F.count_if(F.col("kind") == "mistake").alias("mistakes"), F.count(F.lit(1)).alias("total"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day")))).where(F.col("rank") <= latest)


def daily_concepts(exposures: DataFrame, as_of: str, days: int = 120, top: int = 8, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """The concepts met most often on each day; ``by`` may add the book."""
    c = exposures.where(F.col("day") >= F.date_sub(_day(as_of), days)).groupBy(*by, "day", "concept").count()
    w = Window.partitionBy(*by, "day").orderBy(F.desc("count"), "concept")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def question_timeline(exposures: DataFrame, mistakes: DataFrame, events: DataFrame) -> DataFrame:
    """Questions by source: latest time, weak, number of concepts; questions of events (user_id, question, ts) that no exposure
    has are added. A question that stands in the text of a mistake of its user takes that mistake's id and source, the least."""
    q = exposures.groupBy("user_id", "source", "question").agg(F.max("ts").alias("latest"), F.bool_or("weak").alias("weak"), F.countDistinct("concept").alias("concepts"))
    new = events.join(exposures.select("user_id", "question"), ["user_id", "question"], "left_anti").groupBy("user_id", "question").agg(F.max("ts").alias("latest"))
    q = q.unionByName(new.select("user_id", F.lit("qa").alias("source"), "question", "latest", F.lit(False).alias("weak"), F.lit(0).cast("long").alias("concepts")))
    found = names_in(mistakes.select("user_id", "id", F.lower("question_text").alias("low")), "low", q.select(F.lower("question").alias("low")), "low", ["user_id", "id"])
    m = found.groupBy("user_id", F.col("name").alias("low")).agg(F.min("id").alias("mistake_id"))
    return q.withColumn("low", F.lower("question")).join(m, ["user_id", "low"], "left").drop("low").withColumn("source", F.when(F.col("mistake_id").isNotNull(), "mistake").otherwise(F.col("source")))


def mistakes_naming(names: DataFrame, mistakes: DataFrame, texts: list[str], most: int = 50) -> DataFrame:
    """(user_id, concept, related): how many of a user's mistakes have a name of theirs (user_id, concept) in any of ``texts``.

    Texts and names meet on their user; equal texts of a user are counted first and looked through once.
    """
    t = mistakes.select("user_id", F.concat_ws("\n", *texts).alias("said")).groupBy("user_id", "said").count()
    hit = names.select("user_id", "concept").where(F.length("concept") > 0).distinct().join(t, "user_id").where(F.contains("said", "concept"))
    return hit.groupBy("user_id", "concept").agg(F.least(F.sum("count"), F.lit(most)).alias("related"))


def review_plan(state: DataFrame, mistakes: DataFrame, exposures: DataFrame, as_of: str, limit: int = 8, texts: list[str] | None = None) -> DataFrame:
    """Priorities from weakness, related mistakes, time unseen, exposures and reviews; the best ``limit`` a user.

    A mistake is related by its tag, or, with ``texts``, if a concept's name stands in one of these columns. Then a concept that no
    text names but that the mistakes' tags or causes count has 25 points instead.
    """
    keys = ["user_id", "concept"]
    tagged = mistakes.groupBy("user_id", F.col("tag").alias("concept")).agg(F.least(F.count(F.lit(1)), F.lit(50)).alias("related"))
    top = frequent(state, 12).select(*keys)
    names = state.where("weak").select(*keys).union(top)
    if texts is None:
        related, counted = tagged, tagged.select(*keys).limit(0).withColumn("counted", F.lit(True))
        names = names.union(related.select(*keys)).distinct()
    else:
        counted = mistakes.select("user_id", F.col("tag").alias("concept")).union(mistakes.select("user_id", "mistake_type")).where("concept is not null").distinct().withColumn("counted", F.lit(True))
        names = names.union(counted.select(*keys)).distinct()
        related = mistakes_naming(names, mistakes, texts)
    asked = exposures.where("question <> ''").select(*keys).distinct().withColumn("asked", F.lit(4))
    x = names.join(state, keys, "left").join(related, keys, "left").join(counted, keys, "left").join(asked, keys, "left")
    unseen, since = full_days(as_of, F.col("last_seen")), full_days(as_of, F.col("last_reviewed"))
    x = x.where(F.coalesce(F.to_date("last_reviewed") != _day(as_of), F.lit(True)))
    n = F.coalesce("exposure_count", F.lit(0))
    priority = (
        F.when(F.coalesce("weak", F.lit(False)), 45).otherwise(0) + F.when(F.col("related") > 0, 30 + 4 * F.col("related")).when(F.col("counted"), 25).otherwise(0)
        + F.when(unseen >= 7, F.least(F.lit(30), unseen)).otherwise(0) + F.when(n >= 2, F.least(F.lit(15), n * 2)).otherwise(0)
        + F.when(F.col("last_reviewed").isNull(), 8).when(since >= 7, F.least(F.lit(20), since)).otherwise(0) + F.coalesce("asked", F.lit(0))
    )
    w = Window.partitionBy("user_id").orderBy(F.desc("priority"), F.desc("n"), "concept")
    return x.withColumn("priority", priority.cast("long")).withColumn("n", n).withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= limit) & (F.col("priority") > 0))


def combined_plan(due: DataFrame, queue: DataFrame, weak: DataFrame, limit: int = 8) -> DataFrame:
    """Due cards, concepts and weak points, ranked (user_id, item, rank) each, merged by falling priority."""
    parts = [(due, "due", 100), (queue, "concept", 70), (weak, "weak_point", 50)]
    rows = [d.where(F.col("rank") <= limit).select("user_id", F.lit(k).alias("kind"), F.col("item").cast("string").alias("item"), (F.lit(p + 1) - F.col("rank")).cast("int").alias("priority")) for d, k, p in parts]
    w = Window.partitionBy("user_id").orderBy(F.desc("priority"), "kind", "item")
    return rows[0].union(rows[1]).union(rows[2]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def weekly_report(mistakes: DataFrame, practice: DataFrame, exposures: DataFrame, conversations: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Counts of each user's last days (held within 1 and 31), the ten concepts met most and the eight weakest tags.

    Days of all inputs stand in one column. ``reviewed`` counts practised exercises answered twice or more in these days,
    ``questions`` the user's turns in conversations.
    """
    start = F.date_sub(_day(as_of), max(1, min(days, 31)))
    at = lambda d, k, v: d.where(F.col("day") >= start).select("user_id", F.lit(k).alias("kind"), v.cast("string").alias("value"))
    rows = at(mistakes, "mistake", F.col("tag")).union(at(practice, "practice", F.col("exercise_id"))).union(at(exposures, "exposure", F.col("concept"))).union(at(conversations, "question", F.col("question")))
    c = rows.groupBy("user_id", "kind", "value").count()
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("count"))), F.lit(0))
    r = c.groupBy("user_id").agg(
        of("mistake").alias("new_mistakes"), F.count_if(F.col("kind") == "practice").alias("practised"), F.count_if((F.col("kind") == "practice") & (F.col("count") >= 2)).alias("reviewed"),
        of("exposure").alias("exposures"), of("question").alias("questions"),
    )
    w = Window.partitionBy("user_id", "kind").orderBy(F.desc("count"), "value")
    top = c.where("kind in ('exposure', 'mistake')").withColumn("r", F.row_number().over(w)).where((F.col("r") <= 8) | (F.col("kind") == "exposure") & (F.col("r") <= 10))
    listed = lambda k, name: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("r", "value")))), lambda x: x["value"]).alias(name)
    r = r.join(top.groupBy("user_id").agg(listed("exposure", "top_concepts"), listed("mistake", "weak_points")), "user_id", "left")
    return r.withColumn("suggestion", F.when(F.col("new_mistakes") > 0, "review mistakes").when(F.col("practised") == 0, "practise").otherwise("go on"))


UNTITLED = "新会话"  # fixed value: the title of a conversation whose first question is missing or blank


def conversation_index(turns: DataFrame, most: int = 40, title: int = 36, subject: str = "", book: str = "", tree: dict[str, list[str]] | None = None, limit: int | None = None) -> DataFrame:
    """Conversations by their last ``most`` messages: title (the first question there), counts, last subject and book, first and last time.

    turns: conv_id, turn, role, text and, where there are such, subject, book_name, created_at; of these the last that isn't blank
    counts, of created_at the first too. ``subject`` (as ``subject_match`` takes it) and ``book`` keep those alike; ``limit`` gives
    the newest ones only, newest first. A conversation without a subject or book has an empty one.
    """
    have = set(turns.columns)
    d = turns.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))))
    kept, user = F.col("back") <= most, F.col("role") == "user"
    asked = kept & user
    words = F.trim(F.regexp_replace(F.min_by(F.when(asked, F.col("text")), F.when(asked, F.col("turn"))), r"[ \t\n\r]+", " "))
    said = lambda c: kept & (F.trim(F.col(c).cast("string")) != "")
    last = lambda c: F.min_by(F.when(said(c), F.col(c)), F.when(said(c), F.col("back")))
    more = [F.coalesce(last(c), F.lit("")).alias(c) for c in ("subject", "book_name") if c in have]
    if "created_at" in have:
        more += [F.max_by(F.when(said("created_at"), F.col("created_at")), F.when(said("created_at"), F.col("back"))).alias("created_at"), last("created_at").alias("updated_at")]
    g = d.groupBy("conv_id").agg(
        F.coalesce(F.when(words != "", F.substring(words, 1, title)), F.lit(UNTITLED)).alias("title"), F.count(F.lit(1)).alias("messages"), F.count_if(user).alias("questions"), F.count_if(kept).alias("kept"), *more)
    if subject and "subject" in have:
        g = g.where(subject_match(F.col("subject"), subject, tree or {}))
    if book and "book_name" in have:
        g = g.where(F.col("book_name") == book)
    if limit is None:
        return g
    newest = [F.desc("updated_at")] if "created_at" in have else []
    return g.orderBy(*newest, F.desc("conv_id")).limit(max(1, min(limit, 200)))


def qa_events(turns: DataFrame, exposures: DataFrame) -> DataFrame:
    """For each question one event, one for each strict concept, and one if some link isn't strict."""
    qa = turns.where("role = 'user'").select(F.col("conv_id").alias("owner"), F.lit("chat_qa").alias("event_type"), F.col("turn").cast("string").alias("ref"))
    strict = F.col("confidence") >= 0.85
    one = exposures.where(strict).select("user_id", F.lit("concept_exposure"), "concept").distinct()
    rest = exposures.where(~strict).select("user_id", F.lit("concept_candidates"), F.lit("")).distinct()
    return qa.union(one).union(rest)


def learning_reminders(answers: DataFrame, state: DataFrame, as_of: str) -> DataFrame:
    """Concepts of an answer that are among the user's three longest forgotten (5 days), or were seen twice at most."""
    old = forgotten(state, as_of, 5, 1, 3).select("user_id", "concept", F.lit(True).alias("old"))
    rare = state.where("exposure_count <= 2").select("user_id", "concept", F.lit(True).alias("rare"))
    keys = ["user_id", "concept"]
    hit = answers.select("event_id", *keys).join(old, keys, "left").join(rare, keys, "left").where("old or rare")
    return hit.select("event_id", *keys, F.coalesce("old", F.lit(False)).alias("forgotten"), F.coalesce("rare", F.lit(False)).alias("rare"))

"""Measures of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point_recall(cases: DataFrame, hits: DataFrame, k: int = 20) -> DataFrame:
    """cases: query_id, points, answerable; hits: query_id, rank, text. Recall needs all points, point recall counts them."""
    top = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("hs"))
    d = cases.join(top, "query_id", "left").withColumn("hs", F.coalesce("hs", F.array().cast("array<struct<rank:int,text:string>>")))
    all_text = F.array_join(F.transform("hs", lambda h: h["text"]), "\n")
    found = F.size(F.filter("points", lambda p: F.contains(all_text, p)))
    first = F.array_min(F.transform(F.filter("hs", lambda h: F.forall("points", lambda p: F.contains(h["text"], p))), lambda h: h["rank"]))
    empty = (F.size("hs") == 0).cast("double")
    share = F.when(F.size("points") > 0, found / F.size("points")).otherwise(0.0)
    return d.select(
        "query_id", F.when(F.col("answerable"), (found == F.size("points")).cast("double")).otherwise(empty).alias("recall"),
        F.round(F.when(F.col("answerable"), share).otherwise(empty), 6).alias("point_recall"), F.round(F.when(F.col("answerable"), F.coalesce(1.0 / first, F.lit(0.0))).otherwise(empty), 6).alias("reciprocal"),
    )


def chunk_metrics(samples: DataFrame, hits: DataFrame, cutoffs=(1, 3, 5)) -> DataFrame:
    """samples: query_id, gold, forbidden, pages; hits: query_id, rank, chunk_id, page_idx. Without gold all is null."""
    top = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "page_idx"))).alias("hs"))
    d = samples.join(top, "query_id", "left").withColumn("ids", F.coalesce(F.transform("hs", lambda h: h["chunk_id"]), F.array().cast("array<string>"))).withColumn("seen_pages", F.coalesce(F.transform("hs", lambda h: h["page_idx"]), F.array().cast("array<int>")))
    has = F.size("gold") > 0
    at = F.array_min(F.filter(F.transform("gold", lambda g: F.array_position("ids", g)), lambda p: p > 0))
    cut = lambda k: F.size(F.array_intersect(F.slice("ids", 1, k), "gold"))
    cols = []
    for k in cutoffs:
        cols += [F.when(has, (cut(k) > 0).cast("double")).alias(f"hit_{k}"), F.when(has, F.round(cut(k) / F.size("gold"), 6)).alias(f"recall_{k}")]
    return d.select("query_id", *cols, F.when(has, F.round(F.coalesce(1.0 / at, F.lit(0.0)), 6)).alias("mrr"), F.size(F.array_intersect("ids", "forbidden")).alias("forbidden"), F.arrays_overlap("seen_pages", "pages").alias("page_hit"))


def share(tokens: Column, of: Column) -> Column:
    """Part of the distinct ``tokens`` that ``of`` has; none give null."""
    t = F.array_distinct(tokens)
    return F.when(F.size(t) > 0, F.round(F.size(F.array_intersect(t, of)) / F.size(t), 6))


def overlap_tokens(text: Column) -> Column:
    """Latin words and single CJK characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+|[\x{4e00}-\x{9fff}]"), F.lit(0))


def context_quality(samples: DataFrame, hits: DataFrame, top_k: int = 5) -> DataFrame:
    """Coverage of the question's tokens and of the expected terms by the first hits, and whether the chapter is among them."""
    h = F.array_sort(F.collect_list(F.struct("rank", "text", "chapter")))
    top = hits.where(F.col("rank") <= top_k).groupBy("query_id").agg(h.alias("hs"))
    d = samples.join(top, "query_id", "left")
    text = F.coalesce(F.array_join(F.transform("hs", lambda x: x["text"]), "\n"), F.lit(""))
    terms = F.size(F.filter("terms", lambda t: F.contains(F.lower(text), F.lower(t))))
    return d.select("query_id", share(overlap_tokens(F.col("text")), overlap_tokens(text)).alias("coverage"), F.when(F.size("terms") > 0, F.round(terms / F.size("terms"), 6)).alias("term_coverage"),
                    F.coalesce(F.array_contains(F.transform("hs", lambda x: x["chapter"]), F.col("chapter")), F.lit(False)).alias("chapter_hit"))


def answer_quality(rows: DataFrame) -> DataFrame:
    """rows: id, answer, context, reference. Token overlap of the answer with both."""
    a = overlap_tokens(F.col("answer"))
    return rows.select("id", share(a, overlap_tokens(F.col("context"))).alias("in_context"), share(a, overlap_tokens(F.col("reference"))).alias("in_reference"))


STATUSES = ("ok", "error", "skipped")


def summarise(rows: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Means over all rows and for each value of ``by``; nulls don't count. With a column ``status`` its values are counted, with
    ``latency_ms`` its mean is given."""
    more = []
    if "status" in rows.columns:
        more += [F.count_if(F.col("status") == x).alias(f"status_{x}") for x in STATUSES]
    if "latency_ms" in rows.columns:
        more.append(F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"))
    return rows.rollup(by).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in metrics), *more)


def ir_measures(qrels: DataFrame, run: DataFrame) -> DataFrame:
    """R@1, 3, 5, 10, RR@10 and nDCG@3, 5, 10 with binary gain; queries without gold are left out."""
    n = qrels.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("n_gold"))
    j = run.join(qrels.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    d = n.join(j, "query_id", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))
    gain = lambda r: 1 / F.log2(r + 1.0)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, r: s + gain(r))
    cols = [F.round(F.size(F.filter("ranks", lambda r: r <= k)) / F.col("n_gold"), 6).alias(f"r_{k}") for k in (1, 3, 5, 10)]
    cols += [F.round(total(F.filter("ranks", lambda r: r <= k)) / total(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_gold").cast("int")))), 6).alias(f"ndcg_{k}") for k in (3, 5, 10)]
    return d.select("query_id", *cols, F.round(F.coalesce(1.0 / F.array_min(F.filter("ranks", lambda r: r <= 10)), F.lit(0.0)), 6).alias("rr_10"))


def bootstrap_golden(concepts: DataFrame, occurrences: DataFrame, n: int = 40, roles=("definition", "theorem", "example", "exercise")) -> DataFrame:
    """One question for each (concept, role), from the concept's first occurrence with that role, else its first at all."""
    order = F.struct("book_id", "chapter", "chunk_index", "chunk_id")
    o = occurrences.groupBy("concept_id", "role").agg(F.min_by("chunk_id", order).alias("chunk_id"))
    any_ = occurrences.groupBy("concept_id").agg(F.min_by("chunk_id", order).alias("any_id"))
    want = concepts.select("concept_id", "canonical_name", F.posexplode(F.array(*map(F.lit, roles))).alias("role_no", "role"))
    d = want.join(o, ["concept_id", "role"], "left").join(any_, "concept_id")
    return d.select("role_no", "role", "canonical_name", F.coalesce("chunk_id", "any_id").alias("chunk_id")).orderBy("role_no", "canonical_name").limit(n)


def trace_stats(traces: DataFrame, newest: int = 500) -> DataFrame:
    """By stage over each user's newest traces: number, mean and longest time, mean gap to the trace before in seconds."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("request_id"))
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id").orderBy("ts", "request_id"))) / 1e6
    d = traces.withColumn("gap", gap).withColumn("r", F.row_number().over(w)).where(F.col("r") <= newest)
    return d.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 4).alias("mean_ms"), F.max("ms").alias("max_ms"), F.round(F.avg("gap"), 3).alias("mean_gap"))


def request_stats(requests: DataFrame, newest: int = 500, most_evidence: int = 20) -> DataFrame:
    """By status and intent over each user's newest requests: number, share on the fast path, times and evidence.

    requests: request_id, user_id, ts, status, intent, fast_path, ttft_ms, total_ms, n_evidence. A blank status counts as done;
    a request lists ``most_evidence`` items at most. Times that are null count in no mean; no request, no row.
    """
    d = requests.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("request_id")))).where(F.col("r") <= newest)
    status = F.when(F.trim("status") != "", F.col("status")).otherwise("done").alias("status")
    return d.groupBy(status, F.coalesce("intent", F.lit("")).alias("intent")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("fast_path", F.lit(False)).cast("int")), 4).alias("fast_share"), F.round(F.avg("ttft_ms"), 4).alias("mean_ttft_ms"),
        F.round(F.avg("total_ms"), 4).alias("mean_total_ms"), F.round(F.percentile("total_ms", F.lit(0.95)), 4).alias("p95_total_ms"), F.sum(F.least(F.coalesce("n_evidence", F.lit(0)), F.lit(most_evidence))).alias("n_evidence"),
    )

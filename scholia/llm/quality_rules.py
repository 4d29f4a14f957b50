"""Quality rules with host verdicts: document rules, then failure rates of hosts shrunk by a beta prior.

Method. Each document gets counts that need no other document. A document fails the base rules when it has fewer than
``MIN_WORDS`` words, or more than half of its words lie in 3-word windows that occur twice or more in it; RULES adds softer
rules on symbols, repeated lines and repeated windows. Failures of each rule are summed by host (``source``), the hosts' rates
give that rule a beta prior by the method of moments, and a host's rate is shrunk to the prior's mean. The host fails a rule
when its rate is surely high: its posterior mean less SURE posterior deviations lies above a limit that follows from the
prior, its mean plus FAR prior deviations, kept within RATE_LIMITS. A document is kept if it passes the base rules and its
host passes all rules; so a host of mostly bad documents takes its good ones with it, and a bad document among good hosts
costs its host nothing.

Defined results: a null text has no words and fails; a null host is a host of its own; repeated rows are
counted and judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, let, read, staged, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SURE, FAR = 3.0, 3.0
RATE_LIMITS = (0.25, 0.5)
PRIOR_LIMITS = (2.0, 1000.0)
BROADCAST_HOSTS = 20_000
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(ws: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more: sort window hashes, keep runs, add up cover."""
    grams = F.transform(
        F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("p")),
    )

    def covered(sorted_grams: Column) -> Column:
        h = lambda i: F.get(sorted_grams, i)["h"]
        places = F.array_sort(
            F.transform(
                F.filter(sorted_grams, lambda g, i: (F.when(i > 0, h(i - 1)).eqNullSafe(g["h"])) | h(i + 1).eqNullSafe(g["h"])),
                lambda g: g["p"],
            )
        )
        return let(
            places,
            lambda ps: F.aggregate(
                ps,
                F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                lambda a, p: F.struct((a["n"] + F.least(p - a["last"], F.lit(3))).alias("n"), p.alias("last")),
                lambda a: a["n"],
            ),
        )

    return let(grams, lambda gs: F.when(
        F.size(F.array_distinct(F.transform(gs, lambda g: g["h"]))) == F.size(gs), F.lit(0)
    ).otherwise(let(F.sort_array(gs), covered)))


def _lines_repeated(text: Column) -> Column:
    return let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda xs: F.size(xs) - F.size(F.array_distinct(xs)),
    )


def rule_counts(text: Column) -> Column:
    """Struct of the document's counts."""
    text = F.coalesce(text, F.lit(""))
    return let(
        words(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            _lines_repeated(text).cast("long").alias("n_dup_lines"),
            _repeat_words(ws).cast("long").alias("n_repeat_words"),
        ),
    )


#: Rules by which hosts are judged, as conditions that Spark and DuckDB read alike
BASE_RULE = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
RULES = {"base": BASE_RULE, "symbols": "10 * n_symbols > n_words", "lines": "n_dup_lines >= 3", "repeats": "10 * n_repeat_words > n_words"}


def _posterior(n: str, f: str, m: str, k: str) -> tuple[str, str]:
    """Mean and limit-adjusted lower end, as SQL, of a rate with ``f`` failures of ``n`` under a prior of mean m and strength k."""
    mean = f"(({f} + {m} * {k}) / ({n} + {k}))"
    low = f"({mean} - {SURE} * sqrt({mean} * (1 - {mean}) / ({n} + {k} + 1)))"
    limit = f"greatest({RATE_LIMITS[0]}, least({RATE_LIMITS[1]}, {m} + {FAR} * sqrt({m} * (1 - {m}) / ({k} + 1))))"
    return mean, f"({low} <= {limit})"


def host_verdicts(flags: DataFrame, host: str, failed: list[str]) -> DataFrame:
    """One row per host: host, n_docs, rate_<rule> (shrunk) for each boolean column of ``failed``, and host_ok.

    A rule's prior is Beta(m K, (1 - m) K): m is the overall rate, and K comes from the spread of the hosts' rates beyond what
    sampling explains, kept within PRIOR_LIMITS.
    """
    by = flags.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), *(F.count_if(F.col(c)).alias(f"f_{c}") for c in failed))
    sums = [F.sum("n_docs").cast("double").alias("all_docs"), F.count(F.lit(1)).alias("hosts")]
    for c in failed:
        rate = F.col(f"f_{c}") / F.col("n_docs")
        sums += [F.sum(f"f_{c}").alias(f"all_{c}"), F.sum(rate * rate * F.col("n_docs")).alias(f"square_{c}")]
    prior = by.agg(*sums)
    for c in failed:
        prior = prior.withColumn(f"m_{c}", F.col(f"all_{c}") / F.col("all_docs"))
        m = F.col(f"m_{c}")
        spread = F.greatest(F.col(f"square_{c}") / F.col("all_docs") - m * m - m * (1 - m) * F.col("hosts") / F.col("all_docs"), F.lit(1e-9))
        prior = prior.withColumn(f"k_{c}", F.least(F.greatest(m * (1 - m) / spread - 1, F.lit(PRIOR_LIMITS[0])), F.lit(PRIOR_LIMITS[1])))
    prior = prior.select(*(f"{x}_{c}" for c in failed for x in "mk"))
    told = [_posterior("n_docs", f"f_{c}", f"m_{c}", f"k_{c}") for c in failed]
    # one row on the right side: an aggregate without keys
    return by.join(F.broadcast(prior)).select("host", "n_docs", *(F.expr(mean).alias(f"rate_{c}") for (mean, _), c in zip(told, failed)), F.expr(" AND ".join(ok for _, ok in told)).alias("host_ok"))


def judge(counted: DataFrame, counts: str, host: str) -> tuple[DataFrame, str, str]:
    """Rows with a struct of counts, with two more columns, whose names are returned: base_failed and kept.

    The few host verdicts are broadcast only after counting them; beyond BROADCAST_HOSTS Spark joins by shuffle and splits
    hot hosts.
    """
    flags = counted.select(F.col(host).alias("host"), f"{counts}.*").select("host", *(F.expr(c).alias(r) for r, c in RULES.items()))
    verdicts = host_verdicts(flags, "host", list(RULES)).checkpoint()
    few = verdicts.count() <= BROADCAST_HOSTS
    failed, kept, key, ok = (fresh(counted, n) for n in ("base_failed", "kept", "judged_host", "host_ok"))
    verdicts = verdicts.select(F.col("host").alias(key), F.col("host_ok").alias(ok))
    out = counted.join(F.broadcast(verdicts) if few else verdicts, F.col(host).eqNullSafe(F.col(key)), "left")
    n, rep = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    out = out.withColumn(failed, (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n))
    return out.withColumn(kept, ~F.col(failed) & F.coalesce(ok, F.lit(True))).drop(key, ok), failed, kept


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    slim = staged(docs.select("doc_id", "source", rule_counts(F.col("text")).alias("rules")), "quality")
    out, failed, kept = judge(slim, "rules", "source")
    return out.select("doc_id", *(F.col(f"rules.{c}").alias(c) for c in METRICS), F.col(failed).alias("base_failed"), F.col(kept).alias("kept"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass, as they are.

    Null texts fail; null hosts are one host; repeated rows are judged each, ties have no effect; columns of any name are
    kept; an empty table gives an empty one. The rows with their counts are written once, and hosts are summed from that.
    """
    counts = fresh(docs, "rule_counts")
    out, _, kept = judge(staged(docs.withColumn(counts, rule_counts(F.col("text"))), "quality"), counts, "source")
    return out.where(F.col(kept)).select(*docs.columns)


WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP4_SQL = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {WORDS_SQL} AS ws FROM documents
), g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n >= 2
), cover AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), c AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w) w
  LEFT JOIN cover ON cover.doc_id = w.doc_id
), b AS (
  SELECT *, {", ".join(f"{c} AS bad_{r}" for r, c in RULES.items())} FROM c
), h AS (
  SELECT source AS host, count(*) AS n, {", ".join(f"count(*) FILTER (bad_{r}) AS f_{r}" for r in RULES)} FROM b GROUP BY source
), t AS (
  SELECT sum(n)::DOUBLE AS n, count(*) AS k, {", ".join(f"sum(f_{r}) / sum(n) AS m_{r}, sum((f_{r} / n) * (f_{r} / n) * n) / sum(n) AS rr_{r}" for r in RULES)} FROM h
), p AS (
  SELECT {", ".join(f"m_{r}, least(greatest(m_{r} * (1 - m_{r}) / greatest(rr_{r} - m_{r} * m_{r} - m_{r} * (1 - m_{r}) * k / n, 1e-9) - 1, {PRIOR_LIMITS[0]}), {PRIOR_LIMITS[1]}) AS k_{r}" for r in RULES)} FROM t
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bad_base AS base_failed,
       NOT bad_base AND {" AND ".join(_posterior("h.n", f"h.f_{r}", f"p.m_{r}", f"p.k_{r}")[1] for r in RULES)} AS kept
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.host, p
"""

"""Secret scans: fixed patterns, and Markov models of random strings and of ordinary identifiers.

Method. Three patterns give the base spans. Two first-order character models are trained: one on the values that the
base spans label as secrets, one on the other identifier-like words of the same documents, those of letters alone or met REGULAR times. Any run of
``[A-Za-z0-9+/_=-]`` of MIN_RUN or more characters that meets no base span is added as kind ``random`` when its
log-likelihood ratio, summed over character pairs, exceeds MARGIN. Rare pairs lean on single characters, and the random
model half on an even alphabet, since secrets come in more forms than the labelled ones. The models are counted by Spark over at most about
TRAIN_DOCS documents, drawn by a hash of the id; what reaches the driver is one number for each pair of characters.

Places of matches come from Spark functions alone: the text split by a pattern, and the matches, add up to offsets.

Defined results: a null text is empty and has no span; without labelled secrets the random model is nearly uniform; repeated
rows are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, let, read, running, text_blocks

# fixed values: patterns and least lengths of the base kinds
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 8, "access": 16, "hex": 32}

RUN = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z0-9+/_=-]{6,}"
MARGIN = 10.0
TRAIN_DOCS = 20_000
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIDE = len(ALPHABET) + 1
SMOOTHING, EASE = 0.5, 20.0
REGULAR = 3
MASK = "[SECRET]"

SPAN = "struct<start:bigint,kind:int,end:bigint>"


def _spans(text: Column, pattern: str, kind: str, keep, group: int = 0) -> Column:
    """Array of (start, kind, end) of the pattern's matches whose ``group`` passes ``keep``."""
    none = F.array().cast(f"array<{SPAN}>")

    def found(t: Column) -> Column:
        parts = F.split(t, pattern, -1)
        whole, of = (F.regexp_extract_all(t, F.lit(pattern), F.lit(g)) for g in (0, group))
        hits = F.arrays_zip(F.slice(parts, F.lit(1), F.size(parts) - 1).alias("gap"), whole.alias("hit"), of.alias("of"))
        return let(hits, placed)

    def placed(hits: Column) -> Column:
        sizes = F.transform(hits, lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("long"))

        def span(x: Column, end: Column) -> Column:
            return F.struct((end - F.length(x["hit"])).cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), keep(x["of"]).alias("keep"))

        ends = let(sizes, lambda v: running(v, lambda p, q: p + q))
        all_ = let(ends, lambda es: F.transform(hits, lambda x, i: span(x, F.get(es, i))))
        return F.transform(F.filter(all_, lambda x: x["keep"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    return F.when(text.rlike(pattern), let(text, found)).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans, by start, then kind."""
    long_hex = HEX.replace("+", f"{{{LEAST['hex']},}}")  # runs are maximal, so the least length can stand in the pattern
    long_access = ACCESS.replace("+", f"{{{LEAST['access'] - 4},}}")
    always = lambda x: F.lit(True)
    return F.sort_array(F.concat(
        _spans(text, ASSIGN, "assign", lambda x: F.length(x) >= LEAST["assign"], group=2),
        _spans(text, long_access, "access", always),
        _spans(text, long_hex, "hex", always),
    ))


def _pairs(word: Column) -> Column:
    """Numbers of the adjacent character pairs of a word, the first character after a start mark (0)."""
    return let(F.transform(F.split(word, ""), lambda c: F.position(c, F.lit(ALPHABET))), lambda cs: F.transform(cs, lambda c, i: F.when(i == 0, F.lit(0)).otherwise(F.get(cs, i - 1)) * SIDE + c))


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", train_docs: int = TRAIN_DOCS) -> list[float]:
    """SIDE x SIDE log-likelihood ratios of character pairs, random against ordinary."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(max(n, 1))) < train_docs).select(F.coalesce(text, F.lit("")).alias("t"))
    value = F.when(F.col("s.kind") == 0, F.regexp_extract("hit", ASSIGN, 2)).otherwise(F.col("hit"))
    secret = some.select("t", F.explode(base_spans(F.col("t"))).alias("s")).select("s", F.substring("t", (F.col("s.start") + 1).cast("int"), (F.col("s.end") - F.col("s.start")).cast("int")).alias("hit")).select(value.alias("word"))
    secret = secret.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    plain = some.select(F.explode(F.regexp_extract_all("t", F.lit(IDENTIFIER), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(secret.select("word"), "word", "left_anti")
    plain = plain.where(F.col("word").rlike("^[A-Za-z_/-]+$") | (F.col("n") >= REGULAR))  # a lone string of digits and letters has no label
    both = secret.select(F.lit(1).alias("random"), "word", "n").union(plain.select(F.lit(0), "word", "n"))
    counts = both.select("random", "n", F.explode(_pairs(F.col("word"))).alias("pair")).groupBy("random", "pair").agg(F.sum("n").alias("n"))
    seen = [[0.0] * SIDE * SIDE for _ in range(2)]
    for row in counts.collect():  # at most 2 * SIDE * SIDE rows
        seen[row.random][row.pair] = float(row.n)

    def log_p(c: list[float], even: float) -> list[float]:
        """Logarithms for all pairs: counts, eased towards single characters, and these by ``even`` towards all alike."""
        total = sum(c)
        alone = [(1 - even) * (sum(c[b::SIDE]) + SMOOTHING) / (total + SMOOTHING * SIDE) + even / SIDE for b in range(SIDE)]
        first = [sum(c[a * SIDE : (a + 1) * SIDE]) for a in range(SIDE)]
        return [math.log((c[p] + EASE * alone[p % SIDE]) / (first[p // SIDE] + EASE)) for p in range(SIDE * SIDE)]

    return [round(r - o, 6) for r, o in zip(log_p(seen[1], 0.5), log_p(seen[0], 0.0))]


def random_spans(text: Column, base: Column, ratios: list[float]) -> Column:
    """Spans of long runs that the random model explains better, apart from base spans."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    score = lambda word: F.aggregate(_pairs(word), F.lit(0.0), lambda a, p: a + F.get(table, p))
    runs = _spans(text, RUN, "random", lambda x: score(x) > MARGIN)
    return F.filter(runs, lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name is returned: all spans, by start, then kind; those of kind < 3 are base spans.

    Counts the training documents first. Each column is read once by the next, outside of lambdas, so none is worked out twice.
    """
    ratios = train(docs, text, key)
    t, base = F.coalesce(F.col(text), F.lit("")), fresh(docs, "base_spans")
    spans = fresh(docs, "spans")
    found = docs.withColumn(base, base_spans(t)).withColumn(spans, let(F.col(base), lambda b: F.sort_array(F.concat(b, random_spans(t, b, ratios)))))
    return found.drop(base), spans


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, spans = scan(read(spark, sf_dir, "documents", "doc_id", "text"))
    found = found.select("doc_id", let(F.col(spans), lambda s: F.struct(s.alias("all"), F.filter(s, lambda x: x["kind"] < 3).alias("base"))).alias("s"))
    number = lambda k: F.size(F.filter("s.base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *(number(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(told(F.col("s.base")), 256).alias("base_sha256"), told(F.col("s.all")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or overlapping spans together, replaced by MASK."""

    def pieces(blocks: Column, upto: Column) -> Column:
        last = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(upto, i - 1))
        opening = F.filter(F.transform(spans, lambda s, i: F.struct(last(i).alias("last"), s["start"].alias("start"))), lambda x: x["start"] >= x["last"])
        return F.concat(F.array_join(F.transform(opening, lambda x: F.concat(cut(blocks, x["last"], x["start"]), F.lit(MASK))), ""), cut(blocks, F.element_at(upto, -1), F.length(text).cast("long")))

    upto = let(F.transform(spans, lambda s: s["end"]), lambda v: running(v, F.greatest))
    return F.when(F.size(spans) == 0, text).otherwise(let(text_blocks(text), lambda blocks: let(upto, lambda u: pieces(blocks, u))))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with their secrets masked; n_chars, where present, follows the text.

    Null texts stay null; repeated rows are masked alike; null ids count as one id for the training sample; columns of any
    name are kept as they are, as none is added; an empty table gives an empty one.
    """
    out, spans = scan(docs)
    out = out.withColumn("text", let(F.col(spans), lambda s: masked(F.col("text"), s)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)

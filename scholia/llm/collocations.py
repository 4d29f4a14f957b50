"""Phrase collocation mining: frequent phrases of two to five words and how far they exceed chance, per language.

Method. Places of a text are edges of a weighted de Bruijn graph: the edge of a place is the longest gram, of at most five
words, that starts there, and leads from the node of its first four words to that of its last four; equal edges are added up.
A gram that a piece's end cuts short is an edge to the end. The count of a shorter phrase is the flow through its node: all
edges that begin with it, plus those that end there (the piece-end corrections). So only one shuffle carries grams, and
sorted edges give the counts of every prefix as sums of runs.

Words below the least count can't be in a frequent phrase. A first pass counts all words exactly; in the second, words that aren't
frequent end a run as a piece's end does. Frequent words go by numbers in falling order of their counts, so that an edge is
two integers. Beyond LISTED frequent words their list isn't sent to the tasks: a table of bits of fixed size then tells
which words may be frequent, and edges hold hashes. False positives of the bits cost rows and change no count.

Edges meet by the hash of their first words: two, and one more for each of the leading words that makes up a thousandth of all
words, so that no such group holds more than a thousandth of the edges. Sums of prefixes that several groups or batches share
are added up afterwards.

A phrase whose whole flow enters or leaves by one edge lies on a unary path, which is compacted: only its longest phrases
stay. (A phrase inside a longer one with as many occurrences is also inside one that has one word more and as many.)

Words are named by 64-bit hashes of language and word. That no other word has a frequent word's name is checked over the table of
all words; otherwise another seed is taken.

Defined results: null text is empty, null lang is ``und``; a text without a phrase of the least count gives no rows; long texts are
cut into words whole; repeated rows count again; an empty table gives an empty result; other columns are not read. Scores are exact
to 3e17 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, staged
from .tokens import batches_by_size

LONGEST = 5
LEAST_COUNT = 100
TOP = 2000
BATCH_CHARS = 4_000_000
LISTED = 2_000_000  # frequent words whose list is sent to the tasks: 24 MB at most
BITS = 26  # bits of the table of frequent words: 8 MB, whatever their number
HOT_SHARE = 1000  # at most so many words have this part of all words
GRAMS_A_PART = 1_500_000
SALTS = 128
SCALE = 1000

LOWER, KIND = np.arange(256, dtype=np.uint8), np.zeros(256, np.uint8)
LOWER[65:91] += 32
KIND[[0x20, 0x09]], KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 1, 2  # within a piece; ends a piece


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words in order, and for each its text's number and its piece's; pieces are numbered in order over all texts."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    edge = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = LOWER[np.frombuffer(data, np.uint8)[edge[0] : edge[-1]]] if data else np.zeros(0, np.uint8)
    edge = edge - edge[0]
    kind = KIND[raw]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    opens = edge[:-1][edge[:-1] < edge[1:]]
    first[opens] = inside[opens]
    starts = np.flatnonzero(first)
    doc = np.searchsorted(edge[:-1], starts, "right") - 1
    piece = np.cumsum(kind == 2)[starts] + doc
    sizes = np.diff(np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside)))
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[inside]))])
    return words, doc, piece


def heads(langs: list[str], seed: int) -> list[int]:
    """Hash seeds of languages, as Spark's ``xxhash64`` chains columns."""
    from xxhash import xxh64_intdigest

    start = xxh64_intdigest(str(seed).encode(), 42)
    return [xxh64_intdigest(x.encode(), start) for x in langs]


class Named:
    """The words of a batch: ``of`` numbers each word's (language, word), which have ``lang`` and ``word``."""

    def __init__(self, batch: pa.RecordBatch):
        words, doc, self.piece = cut_words(batch["text"])
        langs = pc.fill_null(batch["lang"], "und").dictionary_encode()
        coded = words.dictionary_encode()
        many = max(1, len(coded.dictionary))
        pairs, self.of = np.unique(langs.indices.to_numpy()[doc].astype(np.int64) * many + coded.indices.to_numpy(), return_inverse=True)
        self.langs, self.at_lang = langs.dictionary, pairs // many
        self.lang, self.word = self.langs.take(pa.array(self.at_lang)), coded.dictionary.take(pa.array(pairs % many))

    def hashes(self, seed: int) -> np.ndarray:
        from xxhash import xxh64_intdigest

        start = heads(self.langs.to_pylist(), seed)
        return np.fromiter((xxh64_intdigest(w, start[i]) for i, w in zip(self.at_lang.tolist(), self.word.to_pylist())), np.uint64, len(self.at_lang))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, n, h) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in batches_by_size(whole, chars=BATCH_CHARS):
                t = Named(b)
                yield pa.RecordBatch.from_arrays([t.lang, t.word.cast(pa.large_string()).cast(pa.string()), pa.array(np.bincount(t.of, minlength=len(t.at_lang)))], ["lang", "word", "n"])

    found = docs.select("text", "lang").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return found.withColumn("h", F.xxhash64(F.lit(str(seed)), "lang", "word"))


class Lexicon:
    """Frequent words by number, or by hash where there are more than LISTED of them; ``hot`` values stand for the commonest."""

    def __init__(self, names: DataFrame, n_names: int, n_words: int, seed: int):
        self.seed, common = seed, F.col("n") >= max(1, n_words // HOT_SHARE)
        hot = sorted((r.h for r in names.where(common).select("h").collect()), key=lambda h: h % (1 << 64))
        self.listed = n_names <= LISTED
        if self.listed:
            ranked = names.orderBy(F.desc("n"), "h").select("h").toArrow()["h"].to_numpy().view(np.uint64)
            order = np.argsort(ranked)
            self.known, self.number = ranked[order], (order + 1).astype(np.uint32)
            self.hot = np.sort(self._numbers(np.array(hot, np.int64).view(np.uint64)))
            self.bits = max(1, n_names.bit_length())
        else:
            self.table, self.hot, self.bits = bit_table(names), np.array(hot, np.int64).view(np.uint64), 64
        self._lay_out()

    def _lay_out(self) -> None:
        """How many words each integer of an edge holds: the first two stand apart, as runs of edges share them and compress well."""
        self.held = (2, 3) if 3 * self.bits <= 63 else (1,) * LONGEST
        self.columns = [f"k{i}" for i in range(len(self.held))]

    def _numbers(self, h: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(h), np.uint64)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, self.number[at], 0).astype(np.uint64)

    def values(self, t: Named) -> np.ndarray:
        """Each (language, word) of a batch as its number or hash; 0 for one that isn't frequent."""
        h = t.hashes(self.seed)
        if self.listed:
            return self._numbers(h)
        at = h >> np.uint64(65 - (8 * len(self.table)).bit_length())
        may = (np.frombuffer(self.table, np.uint64)[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return np.where(may, h, np.uint64(0))

    def packed(self, w: list[np.ndarray]) -> list[np.ndarray]:
        out, at = [], 0
        for n in self.held:
            k = w[at]
            for x in w[at + 1 : at + n]:
                k = k << np.uint64(self.bits) | x
            out.append(k.view(np.int64))
            at += n
        return out

    def unpacked(self, keys: list[np.ndarray]) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        return np.stack([k.view(np.uint64) >> np.uint64(self.bits * j) & mask for k, n in zip(keys, self.held) for j in range(n - 1, -1, -1)])

    def numbered(self, names: DataFrame) -> DataFrame:
        """Adds the value ``v`` of each frequent word."""
        if not self.listed:
            return names.withColumn("v", F.col("h"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.append_column("v", pa.array(self._numbers(b["h"].to_numpy().view(np.uint64)).view(np.int64)))

        return names.select("lang", "word", "n", "h").mapInArrow(run, "lang string, word string, n long, h long, v long")


def bit_table(names: DataFrame) -> bytes:
    """2^BITS bits, those at the first bits of each name set; at most 2^(BITS - 6) rows reach the driver."""
    at = F.shiftrightunsigned("h", 64 - BITS)
    rows = names.select(F.shiftright(at, 6).cast("int").alias("i"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITS}) & 63 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (BITS - 6), np.int64)
    got = rows.toArrow()
    out[got["i"].to_numpy()] = got["b"].to_numpy()
    return out.tobytes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def own_prefix(w: list[np.ndarray], hot: np.ndarray) -> np.ndarray:
    """How many first words decide where a gram goes: two, and one more for each leading hot word after the first."""
    lead, so_far = np.zeros(len(w[0]), np.int64), np.ones(len(w[0]), bool)
    for x in w[:-1]:
        at = np.minimum(np.searchsorted(hot, x), max(0, len(hot) - 1))
        so_far = so_far & (hot[at] == x) if len(hot) else np.zeros(len(x), bool)
        lead += so_far
    return np.clip(lead + 1, 2, len(w))


def edges_of(t: Named, value: np.ndarray, hot: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The batch's distinct edges as columns of values (0: none), with their hashed place and number."""
    at = np.flatnonzero(value[t.of])
    code, piece = t.of[at] + 1, t.piece[at]
    ends = np.append((np.diff(at) != 1) | (np.diff(piece) != 0), True) if len(at) else np.zeros(0, bool)
    stops = np.flatnonzero(ends)
    left = np.repeat(stops, np.diff(np.append(-1, stops))) - np.arange(len(at)) + 1  # words from here to the run's end
    rows = np.flatnonzero(left > 1)
    value = np.append(np.uint64(0), value)
    w = [value[np.where(left[rows] > j, code[np.minimum(rows + j, len(code) - 1)], 0)] for j in range(LONGEST)] if len(rows) else [np.zeros(0, np.uint64)] * LONGEST
    bits = int(value.max()).bit_length()
    if 3 * bits <= 64:  # two sort keys hold five values
        b = np.uint64(bits)
        order = np.lexsort([w[3] << b | w[4], (w[0] << b | w[1]) << b | w[2]])
    else:
        order = np.lexsort(w[::-1])
    w = [x[order] for x in w]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in w:
        new[1:] |= x[1:] != x[:-1]
    start = np.flatnonzero(new)
    w = [x[start] for x in w]
    m = own_prefix(w, hot)
    place = mixed(w[0])
    for j in range(1, LONGEST):
        place = np.where(m > j, mixed(place + w[j]), place)
    return w, place, np.diff(np.append(start, len(order)))


def flows(w: np.ndarray, n: np.ndarray, hot: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts of all prefixes of a batch of sorted edges, a row of values for each place: (phrases of one length, numbers).

    A run that others may continue (the batch's first and last, and a prefix shorter than the one that placed it) is given
    whatever its number; a whole one only if it is frequent.
    """
    m = own_prefix(list(w), hot)
    new = np.zeros(len(n), bool)
    new[0] = True
    for j in range(LONGEST):
        new[1:] |= w[j, 1:] != w[j, :-1]
        if j:
            start = np.flatnonzero(new)
            total = np.add.reduceat(n, start)
            partial = m[start] > j + 1
            partial[[0, -1]] = True
            keep = (w[j, start] != 0) & (partial | (total >= least))
            yield w[: j + 1, start[keep]], total[keep]


def phrase_counts(docs: DataFrame, lexicon: Lexicon, n_words: int, least: int) -> DataFrame:
    """(w, a): frequent phrases of two or more words, as arrays of the lexicon's values, with their counts."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(lexicon)
    keys = lexicon.columns
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_words // GRAMS_A_PART))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for whole in batches:
            for b in batches_by_size(whole, chars=BATCH_CHARS):
                t = Named(b)
                w, place, n = edges_of(t, known.values(t), known.hot)
                part = (place % np.uint64(parts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), *map(pa.array, known.packed(w)), pa.array(n)], ["part", *keys, "n"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            if b.num_rows:
                for w, n in flows(known.unpacked([b[k].to_numpy() for k in keys]), b["n"].to_numpy(), known.hot, least):
                    flat = pa.array(np.ascontiguousarray(w.T).ravel().view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(w), pa.int32()), flat), pa.array(n)], ["w", "a"])

    edges = docs.select("text", "lang").mapInArrow(grams, f"part int, {', '.join(f'{k} long' for k in keys)}, n long")
    met = edges.repartitionById(parts, "part").sortWithinPartitions(*keys)
    return met.mapInArrow(sums, "w array<long>, a long").groupBy("w").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def counted_words(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """All words with counts, the frequent ones, and the seed under which no other word has a frequent word's name."""
    seed = 0
    while True:
        every = staged(word_counts(docs, seed), "collocation-words")
        names = staged(every.where(F.col("n") >= least), "collocation-names")
        if every.join(names.select("h"), "h", "left_semi").count() == names.select("h").distinct().count() == names.count():
            return every, names, seed
        seed += 1


def mine_collocations(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP, share: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of rows (text, lang): each language's ``top`` phrases.

    A phrase is dropped for a longer one that has at least ``share`` percent of its occurrences.
    """
    every, names, seed = counted_words(docs, least)
    sizes = every.groupBy("lang").agg(F.sum("n").alias("n"))
    n_names, n_words = names.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    lexicon = Lexicon(names, n_names, n_words, seed)
    names = lexicon.numbered(names).select("v", "lang", "word", "n")
    phrases = staged(phrase_counts(docs, lexicon, n_words, least), "collocation-phrases")
    size = F.size("w")
    inner = phrases.where(size > 2).select(F.explode(F.array(F.slice("w", 1, size - 1), F.slice("w", F.lit(2), size - 1))).alias("w"), F.col("a").alias("longer"))
    kept = phrases.join(inner.groupBy("w").agg(F.max("longer").alias("longer")), "w", "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * share, F.lit(True))).drop("longer")
    told = (
        kept.select("w", F.posexplode("w").alias("at", "v")).join(names.select("v", "lang", "word"), "v").groupBy("w")
        .agg(F.max("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    counts = phrases.union(names.select(F.array("v"), "n"))
    cuts = kept.select("w", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select("w", "a", "k", F.slice("w", F.lit(1), F.col("k")).alias("first"), F.slice("w", F.col("k") + 1, size - F.col("k")).alias("rest"))
    cuts = cuts.join(counts.select(F.col("w").alias("first"), F.col("a").alias("l")), "first").join(counts.select(F.col("w").alias("rest"), F.col("a").alias("r")), "rest").drop("first", "rest")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(told, "w").join(sizes, "lang").withColumn("up", wide("a") * wide("n") * F.lit(SCALE)).withColumn("down", wide("l") * wide("r")).withColumn("score", F.expr("up div down"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return top_of(best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score"), top)


def top_of(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language; first of each of SALTS parts of it, so no task sorts a whole language."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(read(spark, sf_dir, "documents", "text", "lang"))


OP12_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), i AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, i, unnest(range(1, least({LONGEST}, len(ws) - i + 1) + 1)) AS k FROM i)
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL
), s AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= {LEAST_COUNT}
), q AS (
  SELECT c.*, unnest(range(1, c.k)) AS cut FROM c
  WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.lang = c.lang AND d.k > c.k AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * d.a >= 100 * c.a)
), r AS (
  SELECT q.lang, q.phrase, q.a, q.cut, x.a AS l, y.a AS r, s.n, ({SCALE}::HUGEINT * q.a * s.n) // (x.a::HUGEINT * y.a) AS score
  FROM q JOIN f x ON x.lang = q.lang AND x.phrase = array_to_string(ws[1:cut], ' ') JOIN f y ON y.lang = q.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ') JOIN s ON s.lang = q.lang
), b AS (
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM b
QUALIFY rank <= {TOP}
"""

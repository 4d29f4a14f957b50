"""Hybrid retrieval over batches of questions: lexical, vector and concept hits, fused, gated and evaluated."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions import text as ft
from scholia.sources.tables import written

from .mentions import names_in

K1, B = 1.2, 0.75
POSTING_ROWS = 2_000  # so many chunks are counted at a time
# fixed values: titles of tables of contents
TOC_TITLES = ("(no title)", "目录", "本章学习要点", "习题", "思考题", "参考文献", "附录", "table of contents", "toc")
TOC_PARTS = ("目录", "本章学习要点", "习题", "table of contents")


def build_postings(chunks: DataFrame, text: str = "content", mode: str = "word") -> tuple[DataFrame, DataFrame]:
    """Postings (book_id, term, chunk_id, pos fields, tf, dl), and book statistics (n, avgdl)."""
    t = chunks.select("book_id", "chapter", "chunk_id", "chunk_index", ft.tokens(F.col(text), mode).alias("ts")).withColumn("dl", F.size("ts"))
    stats = t.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    key = ["book_id", "chapter", "chunk_id", "chunk_index"]
    # a line's terms are counted where it stands; only chunks that are there more than once are brought together
    again = written(chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*(F.col(c).alias(f"own_{c}") for c in key)), "again")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in key))
    types = {c: chunks.schema[c].dataType for c in key}
    schema = T.StructType([*(T.StructField(c, types[c]) for c in key), T.StructField("dl", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    order = ["book_id", "term", "chapter", "chunk_id", "chunk_index", "dl", "tf"]
    if again.isEmpty():
        return t.mapInArrow(_counted, schema).select(*order), stats
    once = t.join(again, same, "left_anti").mapInArrow(_counted, schema).select(*order)
    p = t.join(again, same, "left_semi").select(*key, "dl", F.explode("ts").alias("term")).groupBy(*order[:-1]).agg(F.count(F.lit(1)).alias("tf"))
    return once.union(p), stats


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk and distinct term with its count, the chunk's columns repeated."""
    for whole in batches:
        for first in range(0, whole.num_rows, POSTING_ROWS):
            b = whole.slice(first, POSTING_ROWS)
            term = b["ts"].flatten().dictionary_encode()
            n = max(1, len(term.dictionary))
            row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(b["ts"]), 0).to_numpy(zero_copy_only=False))
            at, tf = np.unique(row * n + term.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            names = ["book_id", "chapter", "chunk_id", "chunk_index", "dl"]
            kept = b.select(names).take(pa.array(at // n))
            yield pa.RecordBatch.from_arrays([*kept.columns, term.dictionary.take(pa.array(at % n)), pa.array(tf.astype(np.int64))], [*names, "term", "tf"])


def bm25_search(queries: DataFrame, postings: DataFrame, stats: DataFrame, k: int = 20, preferred: DataFrame | None = None, mode: str = "word") -> DataFrame:
    """Best ``k`` chunks of each query (query_id, book_id, text); a repeated query term counts again.

    Blocks of about QUERY_BLOCK queries go over the postings, of which only those of their words are written. Postings stand by
    chunk, so a task sums its chunks' scores before any are shuffled.
    """
    q = queries.select("query_id", "book_id", F.explode(ft.tokens(F.col("text"), mode)).alias("term")).groupBy("query_id", "book_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    q = written(q, "query-terms")
    blocks, found = max(1, -(-queries.count() // QUERY_BLOCK)), None
    for i in range(blocks):
        asked = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        met = written(postings.join(F.broadcast(asked.select("book_id", "term").distinct()), ["book_id", "term"], "left_semi"), "postings-met")
        df = met.groupBy("book_id", "term").agg(F.count(F.lit(1)).alias("df"))
        weights = asked.join(df, ["book_id", "term"]).join(stats, "book_id").select("query_id", "book_id", "term", (F.col("qtf") * idf).alias("w"), F.greatest("avgdl", F.lit(1.0)).alias("avgdl"))
        hits = met.join(F.broadcast(written(weights, "weights")), ["book_id", "term"]).groupBy("query_id", "book_id", "chapter", "chunk_id", "chunk_index").agg(F.sum(part).alias("s"))
        found = hits if found is None else found.union(hits)
    if preferred is not None:
        found = found.join(preferred.select("query_id", "chapter", F.lit(1.2).alias("boost")), ["query_id", "chapter"], "left").withColumn("s", F.col("s") * F.coalesce("boost", F.lit(1.0))).drop("boost")
    found = found.withColumn("score", F.round("s", 6)).where("score > 0").drop("s")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.col("chapter")), F.desc("chunk_index"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


SCORES = 2_000_000
WEIGHTS = 2_000_000


def bm25_search_all(queries: DataFrame, chunks: DataFrame, k: int = 20, mode: str = "word") -> DataFrame:
    """Best ``k`` chunks of each query (query_id, text) over the chunks of every book, those without a name included.

    Blocks of QUERY_BLOCK queries go over the chunks, and over blocks of books where their words' weights are more than
    WEIGHTS. Texts are cut into tokens once; statistics, document frequencies and scores read the tokens. A task scores its chunks against the block's queries and gives each query's best; all books are ranked together.
    """
    sc = queries.sparkSession.sparkContext
    q = queries.select("query_id", F.explode(ft.tokens(F.col("text"), mode)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    t = written(chunks.select("book_id", "chapter", "chunk_id", "chunk_index", ft.tokens(F.col("content"), mode).alias("ts")), "tokens")  # each text is cut once
    stats = t.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("ts")).alias("avgdl"))
    n_books = stats.count()
    out = "query_id long, book_id string, chapter string, chunk_id string, chunk_index int, s double"
    found = queries.sparkSession.createDataFrame([], out)
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for i in range(query_blocks):
        rows = q.where(F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)) == i).toPandas()
        if not len(rows):
            continue
        ids, at = np.unique(rows["query_id"].to_numpy(np.int64), return_inverse=True)
        names, term = np.unique(rows["term"].to_numpy(str), return_inverse=True)
        o = np.argsort(term, kind="stable")
        asked = (ids, pa.array(names.tolist()), np.searchsorted(term[o], np.arange(len(names) + 1)), at[o], rows["qtf"].to_numpy(float)[o])
        vocabulary = F.broadcast(queries.sparkSession.createDataFrame([(x, j) for j, x in enumerate(names.tolist())], "term string, no int"))  # words of one block of queries
        book_blocks = max(1, -(-n_books * len(names) // WEIGHTS))
        for j in range(book_blocks):
            mine = F.pmod(F.xxhash64("book_id"), F.lit(book_blocks)) == j
            df = t.where(mine).select("book_id", F.explode(F.array_distinct("ts")).alias("term")).join(vocabulary, "term").groupBy("book_id", "no").agg(F.count(F.lit(1)).alias("df"))
            books = {r["book_id"]: (b, r["n"], max(r["avgdl"], 1.0)) for b, r in enumerate(stats.where(mine).collect())}
            idf = np.zeros((len(books), len(names)))
            d = df.toPandas()
            own = [books[None if pd.isna(x) else x] for x in d["book_id"]]
            n, m = np.array([x[1] for x in own], float), d["df"].to_numpy(float)
            idf[np.array([x[0] for x in own], int), d["no"].to_numpy(int)] = np.log(1 + (n - m + 0.5) / (m + 0.5))
            sent = sc.broadcast((*asked, {x: v[0] for x, v in books.items()}, idf, np.array([v[2] for v in books.values()])))
            found = found.union(t.where(mine).mapInArrow(_best_of(sent, k), out))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("chapter"), F.desc("chunk_index"))
    return found.withColumn("score", F.round("s", 6)).where("score > 0").drop("s").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best_of(sent, k: int):
    """Chunks that may be among a query's best ``k``: at least as good, to six digits, as the k-th of the rows so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, begin, query, qtf, books, idf, avgdl = sent.value
        least = np.zeros(len(ids))
        step = max(1, SCORES // len(ids))
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                b = whole.slice(first, step)
                dl = pc.fill_null(pc.list_value_length(b["ts"]), 0).to_numpy(zero_copy_only=False)
                t = pc.fill_null(pc.index_in(b["ts"].flatten(), value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(b.num_rows), dl)[t >= 0]
                key, tf = np.unique(row * len(names) + t[t >= 0], return_counts=True)
                row, t = key // len(names), key % len(names)
                book = np.array([books[x] for x in b["book_id"].to_pylist()], int)[row]
                part = idf[book, t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avgdl[book]))
                n = begin[t + 1] - begin[t]
                each = np.repeat(begin[t] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                s = np.bincount(np.repeat(row, n) * len(ids) + query[each], np.repeat(part, n) * qtf[each], b.num_rows * len(ids)).astype(float).reshape(b.num_rows, len(ids))
                if b.num_rows >= k:
                    least = np.maximum(least, np.partition(s, b.num_rows - k, axis=0)[b.num_rows - k])
                r, c = np.nonzero((s > 0) & (s >= least - 2e-6))
                kept = b.select(["book_id", "chapter", "chunk_id", "chunk_index"]).take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(ids[c]), *kept.columns, pa.array(s[r, c])], ["query_id", *kept.schema.names, "s"])

    return run


def gold_chunks(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of the chunks of any book that hold a query's whole text."""
    found = names_in(chunks, "content", queries, "text", ["chunk_id"])
    return found.join(queries.select("query_id", F.col("text").alias("name")), "name").select("query_id", "chunk_id")


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 5, top_n: int = 3, weight: float = 0.03) -> DataFrame:
    """Per book the nearest candidates, then the best chapters by distance less priority, then their best chunks.

    ``queries`` (query_id, book_id, q) are a stated set; vectors (book_id, chapter, vec_id, embedding, rag_priority).
    """
    most = max(k * top_n * 4, k)
    d = nearest_of(queries, vectors, most, by_chapter=False)
    cand = Window.partitionBy("query_id", "book_id").orderBy("distance", "vec_id")
    d = d.withColumn("r", F.row_number().over(cand)).where(F.col("r") <= most).withColumn("adjusted", F.round(F.col("distance") - weight * F.col("rag_priority"), 6))
    return _best_chapters(d, "adjusted", k, top_n)


def nearest_of(queries: DataFrame, vectors: DataFrame, most: int, by_chapter: bool) -> DataFrame:
    """Pairs (query_id, book_id, chapter, vec_id, rag_priority, distance) within a book, that hold each query's ``most`` nearest
    vectors, of the book or of each chapter: a task gives its own nearest, from matrix products of Arrow batches.

    The queries go to the tasks in blocks of about QUERY_BLOCK, dealt by a hash, one pass over the vectors for each block.
    """
    fields = ["book_id", "chapter", "vec_id", "rag_priority"]
    schema = T.StructType([queries.schema["query_id"], *(vectors.schema[c] for c in fields), T.StructField("distance", T.DoubleType())])
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = vectors.sparkSession.createDataFrame([], schema)
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).select("query_id", "book_id", "q").toArrow()
        if rows.num_rows:
            book = np.array(rows["book_id"].to_pylist(), object)
            ids, q = rows["query_id"].to_numpy(), _unit(rows["q"])
            sent = vectors.sparkSession.sparkContext.broadcast({b: (ids[book == b], q[book == b]) for b in dict.fromkeys(book)})
            part = vectors.select(*fields, "embedding").mapInArrow(_near_batches(sent, most, by_chapter), schema)
            out = part if blocks == 1 else out.union(part)
    return out


CELLS = 250_000  # so many distances are worked out at a time


def _unit(lists) -> np.ndarray:
    """Vectors of an Arrow column in double precision, of length one."""
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return x


def _tiles(q: np.ndarray, x: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vector, distance) of each query's ``most`` nearest, for some queries at a time; ties at the edge stay, the window that follows orders them."""
    n, step = min(most, len(x)), max(1, CELLS // max(1, len(x)))
    for s in range(0, len(q) if n else 0, step):
        d = np.round(1 - q[s : s + step] @ x.T, 6)
        i, j = np.nonzero(d <= np.partition(d, n - 1, axis=1)[:, n - 1 : n])
        yield s + i, j, d[i, j]


def _near_batches(sent, most: int, by_chapter: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(b["embedding"])
            vec = b["vec_id"].to_numpy()
            book = np.array(b["book_id"].to_pylist(), object)
            group = np.unique(np.array([str(c) for c in b["chapter"].to_pylist()]), return_inverse=True)[1] if by_chapter else np.zeros(b.num_rows, int)
            kept = b.select(["book_id", "chapter", "vec_id", "rag_priority"])
            for name, (ids, q) in sent.value.items():
                for g in np.unique(group):
                    own = np.flatnonzero((group == g) & (book == name))
                    own = own[np.argsort(vec[own], kind="stable")]
                    for i, j, d in _tiles(q, x[own], most):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), *kept.take(pa.array(own[j])).columns, pa.array(d)], ["query_id", *kept.schema.names, "distance"])

    return run


def _best_chapters(d: DataFrame, by: str, k: int, top_n: int) -> DataFrame:
    inner = Window.partitionBy("query_id", "chapter").orderBy(by, "vec_id")
    d = d.withColumn("in_chapter", F.row_number().over(inner)).withColumn("best", F.min(by).over(Window.partitionBy("query_id", "chapter")))
    d = d.withColumn("chapter_rank", F.dense_rank().over(Window.partitionBy("query_id").orderBy("best", "chapter")))
    return d.where((F.col("in_chapter") <= k) & (F.col("chapter_rank") <= top_n)).select("query_id", "chapter", "vec_id", "distance", F.col(by).alias("ordered_by"), "chapter_rank", "in_chapter")


def vector_search_by_chapter(queries: DataFrame, vectors: DataFrame, k: int = 5, top_n: int = 3) -> DataFrame:
    """Without a book index: the nearest ``k`` of each chapter, chapters by their nearest."""
    return _best_chapters(nearest_of(queries, vectors, k, by_chapter=True).withColumn("order", F.col("distance")), "order", k, top_n)


QUERY_BLOCK = 5_000


def vector_topk_fast(queries: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, vec_id, distance, rank): matrix products over Arrow batches, a partial top k each, then one merge.

    The queries go to the tasks in blocks of about QUERY_BLOCK, dealt by a hash, one pass over the vectors for each block.
    """
    blocks = -(-queries.count() // QUERY_BLOCK)
    part = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, distance double")
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "q").toArrow()
        if rows.num_rows:
            sent = vectors.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(), _unit(rows["q"])))
            part = part.union(vectors.select("vec_id", "embedding").mapInArrow(_nearest(sent, k), "query_id long, vec_id long, distance double"))
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, q = sent.value
                vec = b["vec_id"].to_numpy()
                order = np.argsort(vec, kind="stable")
                for i, j, d in _tiles(q, _unit(b["embedding"])[order], k):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(vec[order][j]), pa.array(d)], ["query_id", "vec_id", "distance"])

    return run


def expand_neighbors(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Chunks within ``window`` places of a hit in its chapter; direct where one is a hit itself."""
    near = hits.select("query_id", "book_id", "chapter", "rank", F.col("chunk_index").alias("at"), F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index"))
    near = near.groupBy("query_id", "book_id", "chapter", "chunk_index").agg(F.min("rank").alias("rank"), F.bool_or(F.col("at") == F.col("chunk_index")).alias("is_direct_hit"))
    c = chunks.select(F.col("book_id").alias("own_book"), F.col("chapter").alias("own_chapter"), F.col("chunk_index").alias("own_index"), "chunk_id", "page_idx", "content")
    same = (near["chapter"] == c["own_chapter"]) & (near["chunk_index"] == c["own_index"]) & near["book_id"].eqNullSafe(c["own_book"])  # books without a name count
    return near.join(c, same).drop("own_book", "own_chapter", "own_index")


def _term_score(of_query: Column, of_term: Column, inside: Column, exact: Column) -> Column:
    """By both lengths and whether the term stands ``inside`` the query or around it; one inside the other and as long is the same."""
    return (
        F.when(of_query == of_term, exact)
        .when(~inside & (of_query >= 2), F.lit(50) + of_query / of_term * 50)
        .when(inside & (of_term >= 2), F.least(exact - 5, F.lit(70) + of_term / of_query * 20))
        .otherwise(F.lit(0.0))
    )


def _meetings(texts: DataFrame, keep: list[str], text: str, terms: DataFrame, term: str) -> DataFrame:
    """(keep, term, inside): terms that a row's text contains and, not inside, those that contain it, the same ones twice; only
    texts no longer than some term can be contained."""
    inside = names_in(texts, text, terms, term, keep).select(*keep, F.col("name").alias(term), F.lit(True).alias("inside"))
    longest = terms.agg(F.max(F.length(term))).first()[0] or 0
    short = texts.where(F.length(text) <= longest)
    around = names_in(terms.select(term).distinct(), term, short, text, [term])
    return inside.union(around.join(short.select(*keep, F.col(text).alias("name")), "name").select(*keep, term, F.lit(False)))


def _either_way(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """(key, term) of the terms that a row's text contains or that contain it."""
    return _meetings(texts, [key], text, terms, term).drop("inside").distinct()


def concept_search(queries: DataFrame, concepts: DataFrame, k: int = 5) -> DataFrame:
    """Best concepts of each query by name (100) or alias (90), whole or contained either way."""
    terms = F.transform(F.array_union(F.array("canonical_name"), "aliases"), lambda t: F.struct(F.lower(F.trim(t)).alias("term"), F.when(t == F.col("canonical_name"), 100.0).otherwise(90.0).alias("exact")))
    t = concepts.select("concept_id", "canonical_name", F.explode(terms).alias("t")).select("concept_id", "canonical_name", "t.term", "t.exact").where("term <> ''")
    q = queries.select("query_id", F.lower(F.trim("text")).alias("ql")).where("ql <> ''").withColumn("n", F.length("ql"))
    # the texts themselves stay behind: a query's length is all that its score takes
    d = _meetings(q, ["query_id", "n"], "ql", t, "term").join(t, "term")
    score = _term_score(F.col("n"), F.length("term"), F.col("inside"), F.col("exact"))
    d = d.groupBy("query_id", "concept_id", "canonical_name").agg(F.round(F.max(score), 6).alias("score")).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "canonical_name")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_concepts(matches: DataFrame, keep: int = 3, least: float = 30) -> DataFrame:
    """Adjusts matches (query_id, text, canonical_name, aliases, roles, occurrence_count, score) and keeps the best.

    +60 if the query is a name, +35 if it contains one, +40 if a core term is the name, -1.5 for each character the name
    has beyond the longest term inside it, +12 if a role suits the question's intent (column ``intent``, else that of a plain question).
    """
    q, name = F.lower(F.trim("text")), F.col("canonical_name")
    wanted = F.array(*map(F.lit, ft.ROLES_OF_INTENT["qa"]))
    if "intent" in matches.columns:
        for intent, roles in ft.ROLES_OF_INTENT.items():
            wanted = F.when(F.col("intent") == intent, F.array(*map(F.lit, roles))).otherwise(wanted)
    names = F.array_union(F.array(name), "aliases")
    core = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_.+-]+|[\x{4e00}-\x{9fff}]{2,}"), F.lit(0))
    partial = F.filter(core, lambda t: F.contains(name, t) & (t != name))
    adj = (
        F.col("score") + F.when(F.exists(names, lambda n: F.lower(n) == q), 60).otherwise(0) + F.when(F.exists(names, lambda n: F.contains(q, F.lower(n))), 35).otherwise(0)
        + F.when(F.array_contains(core, name), 40).otherwise(0)
        - F.when(F.size(partial) > 0, 1.5 * (F.length(name) - F.array_max(F.transform(partial, F.length)))).otherwise(0.0)
        + F.when(F.arrays_overlap("roles", wanted), 12).otherwise(0)
    )
    d = matches.withColumn("adjusted", F.round(adj, 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("adjusted"), F.length(name), F.desc("occurrence_count"), name)
    return d.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= keep) & (F.col("score") >= least))


# fixed values: order of roles when a concept's places are chosen
PLACE_ORDER = ("definition", "theorem", "property", "derivation", "proof", "example", "algorithm", "exercise", "reference")


EXAMPLE = r"(?m)^\s*例\s*(题|\d)"  # fixed value: how an example begins


def concept_chunks(concepts: DataFrame, occurrences: DataFrame, chunks: DataFrame, window: int = 1, max_hits: int = 3, back: int = 5) -> DataFrame:
    """Chunks where a concept occurs, best roles first, with their neighbours (three to each side of an example).

    A hit in an example reaches back to where the example begins, ``back`` chunks at most. Neighbours that look like a table of
    contents are left out, hits are not.
    """
    order = F.array_position(F.array(*map(F.lit, PLACE_ORDER)), F.col("role"))
    o = occurrences.join(concepts.select("concept_id"), "concept_id").groupBy("concept_id", "book_id", "chapter", "chunk_id", "chunk_index").agg(F.min_by("role", order).alias("role"), F.min(order).alias("o"))
    w = Window.partitionBy("concept_id", "book_id").orderBy("o", "chapter", "chunk_index")
    o = o.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_hits)
    title = F.col("section_title") if "section_title" in chunks.columns else F.lit(None).cast("string")
    c = chunks.select("book_id", "chapter", "chunk_index", "chunk_id", "page_idx", "content", toc_like(title, F.col("content")).alias("toc"))
    begins = F.max(F.when(F.col("content").rlike(EXAMPLE), F.col("chunk_index"))).over(Window.partitionBy("book_id", "chapter").orderBy("chunk_index").rangeBetween(-back, -1))
    starts = c.select("chunk_id", begins.alias("begins")).where("begins is not null")
    o = o.join(starts, "chunk_id", "left")
    first = F.when(F.col("role") == "example", F.least(F.col("chunk_index") - max(window, 3), "begins")).otherwise(F.col("chunk_index") - window)
    last = F.col("chunk_index") + F.when(F.col("role") == "example", max(window, 3)).otherwise(window)
    near = o.select("concept_id", "book_id", "chapter", F.col("chunk_index").alias("at"), F.explode(F.sequence(first, last)).alias("chunk_index"))
    near = near.groupBy("concept_id", "book_id", "chapter", "chunk_index").agg(F.bool_or(F.col("at") == F.col("chunk_index")).alias("is_direct_hit"))
    return near.join(c, ["book_id", "chapter", "chunk_index"]).where("is_direct_hit or not toc").drop("toc")


def toc_like(title: Column, text: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    chapters = F.size(F.filter(F.slice(lines, 1, 14), lambda x: F.contains(x, F.lit("第")) & (F.contains(x, F.lit("章")) | F.contains(x, F.lit("节")))))
    pages = F.regexp_count(F.array_join(F.slice(lines, 1, 8), " "), F.lit(r"\s\d{1,3}(\s|$)"))
    named = t.isin(*TOC_TITLES)
    for p in TOC_PARTS:
        named = named | F.contains(t, F.lit(p))
    return named | ((chapters >= 3) & (pages >= 3))


def fuse_and_rerank(hits: DataFrame, queries: DataFrame, per_chapter: int = 6, total: int = 10, intent: str = "qa") -> DataFrame:
    """Reciprocal ranks of the sources summed, then adjusted by coverage, role, book and kind of hit.

    hits: query_id, list_no, position, rank (null: position), source, chunk_id, chapter, page_idx, role, book_role,
    is_direct_hit, section_title, text.
    """
    d = hits.where(F.trim("text") != "").withColumn("key", F.coalesce("chunk_id", F.regexp_replace(F.substring("text", 1, 100), "[ \n]", "")))
    d = d.withColumn("kind", F.when(F.col("source") == "bm25", "bm25").when(F.startswith("source", F.lit("kg")), "kg").otherwise("dense")).withColumn("r", F.coalesce("rank", "position"))
    order = F.struct("list_no", "position")
    cols = ["chapter", "page_idx", "role", "book_role", "section_title", "text", "source", "chunk_id"]
    one = d.groupBy("query_id", "key").agg(
        *(F.min_by(c, order).alias(c) for c in cols), F.bool_or("is_direct_hit").alias("is_direct_hit"), F.max_by(F.when(F.col("is_direct_hit"), F.col("source")), F.when(F.col("is_direct_hit"), order)).alias("direct_source"),
        *(F.min(F.when(F.col("kind") == k, F.col("r"))).alias(f"r_{k}") for k in ("kg", "dense", "bm25")),
    ).join(queries.select("query_id", F.array_distinct(ft.tokens(F.col("text"))).alias("qt")), "query_id")
    source = F.coalesce("direct_source", "source")
    coverage = F.when(F.size("qt") > 0, F.size(F.array_intersect("qt", ft.tokens(F.col("text")))) / F.size("qt")).otherwise(0.0)
    roles = ft.ROLES_OF_INTENT[intent]
    at = F.array_position(F.array(*map(F.lit, roles)), F.coalesce("role", F.lit("")))
    rrf = sum((F.coalesce(1.0 / (60 + F.col(f"r_{k}")), F.lit(0.0)) for k in ("kg", "dense", "bm25")), F.lit(0.0))
    score = (
        rrf + F.when(F.col("is_direct_hit"), 0.05).otherwise(0.0) + 0.08 * coverage + F.when(at > 0, 0.012 * (len(roles) - at + 1) / len(roles)).otherwise(0.0)
        + F.when(F.col("book_role") == "core", 0.035).when(F.col("book_role") == "reference", -0.006).otherwise(0.0)
        - F.when(source == "neighbor", 0.004).otherwise(0.0) - F.when(toc_like(F.col("section_title"), F.col("text")), 0.2).otherwise(0.0)
    )
    d = one.withColumn("score", F.round(score, 6)).withColumn("coverage", F.round(coverage, 6))
    by = [F.desc("score"), "page_idx", "key"]
    d = d.withColumn("in_chapter", F.row_number().over(Window.partitionBy("query_id", "chapter").orderBy(*by))).where(F.col("in_chapter") <= per_chapter)
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= total)
    return d.select("query_id", "rank", "chunk_id", "chapter", "page_idx", "score", "coverage", "is_direct_hit", "text")


def evidence_gate(ranked: DataFrame, queries: DataFrame, first: int = 6, least: float = 0.2) -> DataFrame:
    """Of the first items those that hold all literals of the query and are direct or cover enough of it."""
    d = ranked.where(F.col("rank") <= first).join(queries.select("query_id", ft.literals(F.col("text")).alias("lits")), "query_id")
    low = F.lower("text")
    return d.where(F.forall("lits", lambda x: F.contains(low, x)) & (F.col("is_direct_hit") | (F.col("coverage") >= least))).drop("lits")


def refused(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    return queries.join(evidence.select("query_id"), "query_id", "left_anti")


def rewrite_followups(turns: DataFrame, markers=ft.FOLLOW_UPS) -> DataFrame:
    """User turns that refer back get the last user turn before them in front, and before that ``[subject / book]`` where the
    turns have such columns, the last ones given in the conversation."""
    user = F.when((F.col("role") == "user") & (F.trim("text") != ""), F.col("text"))
    before = F.last(user, True).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    clean = F.trim(F.regexp_replace(F.regexp_replace(before, r"(?i)\s*/\s*[a-f0-9]{12,64}(\s*\])", "$1"), r"\s+", " "))
    compact, back = F.regexp_replace("text", r"\s+", ""), F.lit(False)
    for m in markers:
        back = back | F.contains(compact, F.lit(m))
    t = F.trim("text")
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    place = [F.last(F.when(F.trim(c) != "", F.trim(c)), True).over(upto) for c in ("subject", "book") if c in turns.columns]
    named = F.concat_ws(" / ", *place) if place else F.lit("")
    prefix = F.when(named != "", F.concat(F.lit("["), named, F.lit("] "))).otherwise("")
    d = turns.withColumn("rewritten", F.when(back & (clean != ""), F.concat(prefix, F.substring(clean, 1, 500), F.lit("；"), t)).otherwise(t))
    return d.where("role = 'user'")


def keyword_chapters(queries: DataFrame, keywords: DataFrame) -> DataFrame:
    """Chapters by the number of their keywords that the question contains or that contain it."""
    k = keywords.select("chapter", F.lower(F.trim("keyword")).alias("kw")).where(F.length("kw") >= 2).distinct()
    q = queries.select("query_id", F.lower("text").alias("ql"))
    d = _either_way(q, "query_id", "ql", k, "kw").join(k, "kw")
    return d.groupBy("query_id", "chapter").agg(F.count(F.lit(1)).alias("score"))


def chapters_named(queries: DataFrame, chapters: DataFrame) -> DataFrame:
    """The chapter whose title stands in the question, else the one with the question's chapter number."""
    n = F.regexp_extract("text", r"第\s*(\d+)\s*章", 1)
    q = queries.select("query_id", "text", F.when(n != "", F.concat(F.lit("第"), n, F.lit("章"))).alias("number"))
    c = chapters.select("chapter", "title")
    named = names_in(q, "text", c, "title", ["query_id"]).select("query_id", F.col("name").alias("title"), F.lit(0).alias("pri"))
    numbered = names_in(c.select("title").distinct(), "title", q, "number", ["title"]).join(q.select("query_id", F.col("number").alias("name")), "name").select("query_id", "title", F.lit(1).alias("pri"))
    d = named.union(numbered).join(c, "title")
    w = Window.partitionBy("query_id").orderBy("pri", F.desc(F.length("title")), "chapter")
    return d.withColumn("r", F.row_number().over(w)).where("r = 1").select("query_id", "chapter", "title")

"""From OCR items and text lines to chapters, chunks, roles and sections."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.sources.tables import written

from scholia.functions import roles

# fixed value: what a chapter heading looks like
HEADING = r"^\s*(第\s*[0-9一二三四五六七八九十百]+\s*[章节篇讲]|\d+(\.\d+)*\s+\S|(?i:chapter)\s*\d+)"
UNTITLED = "(no title)"


def _running(flag: Column, keys: list[str], order: str) -> Column:
    return F.sum(flag.cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def _chapters(rows: DataFrame, is_heading: Column, title: Column, key: str, order: str) -> DataFrame:
    d = rows.withColumn("is_heading", is_heading).withColumn("chapter_no", _running(F.col("is_heading"), [key], order))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct(order, "text")))), lambda x: x["text"]), "\n")
    extra = [F.min("page_idx").alias("first_page"), F.max("page_idx").alias("last_page")] if "page_idx" in rows.columns else []
    head = F.max(F.when(F.col("is_heading"), title))
    return d.groupBy(key, "chapter_no").agg(F.coalesce(head, F.lit("全文")).alias("title"), body.alias("text"), *extra)


def chapters_from_items(items: DataFrame, key: str = "book_id", order: str = "pos", heading: str = HEADING) -> DataFrame:
    """A short text item of level 1 or 2 that looks like a heading starts a chapter; what comes before is a full-text one."""
    t = F.trim(F.coalesce("text", F.lit("")))
    starts = (F.col("type") == "text") & F.coalesce(F.col("text_level").isin(1, 2), F.lit(False)) & (F.length(t) <= 80) & t.rlike(heading)
    return _chapters(items, starts, t, key, order)


def chapters_from_markdown(lines: DataFrame, key: str = "book_id", order: str = "pos") -> DataFrame:
    """Lines of one to three ``#`` and a title of 120 characters at most start chapters."""
    pattern = r"^(#{1,3})\s+(\S.{0,119})$"
    return _chapters(lines, F.col("text").rlike(pattern), F.trim(F.regexp_extract("text", pattern, 2)), key, order)


def coalesce_heading_chapters(rows: DataFrame, key: str = "book_id", order: str = "pos", least: int = 80, early: int = 120, external: int = 20) -> DataFrame:
    """Books with many external OCR rows are grouped by the leading number, carried forward; others keep their rows."""
    w = Window.partitionBy(key).orderBy(order)
    d = rows.withColumn("nth", F.row_number().over(w))
    guard = d.groupBy(key).agg(((F.count(F.lit(1)) >= least) & (F.count_if((F.col("nth") <= early) & F.col("external")) >= external)).alias("grouped"))
    n = F.regexp_extract("title", r"^\s*(\d+)", 1)
    d = d.join(guard, key).withColumn("number", F.last(F.when(n != "", n), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    changed = ~F.col("number").eqNullSafe(F.lag("number").over(w)) | (F.col("nth") == 1)
    d = d.withColumn("grp", F.when(F.col("grouped"), F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).otherwise(F.col("nth")))
    return d.groupBy(key, "grp").agg(F.min_by("title", order).alias("title"), F.count(F.lit(1)).alias("n_rows"), F.min(order).alias("first_pos"))


def inherit_section_title(chunks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Untitled chunks take the last real title, ``root`` before any."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    real = F.when(F.coalesce("section_title", F.lit("")).isin("", UNTITLED), None).otherwise(F.col("section_title"))
    return chunks.withColumn("section_title", F.coalesce(F.last(real, True).over(w), F.lit("root")))


def parse_toc(lines: DataFrame, key: str = "book_id", order: str = "pos") -> DataFrame:
    """Contents lines to chapters and sections with pages; one ends before the next of its kind begins."""
    ch, se = r"^第(\d+)章\s*(.*?)[\s.·…]*(\d+)$", r"^(\d+\.\d+)\s+(.*?)[\s.·…]*(\d+)$"
    t = F.trim("text")
    d = lines.withColumn("kind", F.when(t.rlike(ch), "chapter").when(t.rlike(se), "section")).where("kind is not null")
    pick = lambda g: F.when(F.col("kind") == "chapter", F.regexp_extract(t, ch, g)).otherwise(F.regexp_extract(t, se, g))
    w = Window.partitionBy(key).orderBy(order)
    d = d.select(key, order, "kind", pick(1).alias("number"), pick(2).alias("title"), pick(3).cast("int").alias("page"))
    d = d.withColumn("chapter", F.last(F.when(F.col("kind") == "chapter", F.col("number")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("end_page", F.lead("page").over(Window.partitionBy(key, "kind").orderBy(order)) - 1)


def normalise_chunks(raw: DataFrame, book: str = "book_id") -> DataFrame:
    """Typed chunks from loose rows: first non-blank text source, blanks dropped, stable ids, four-number boxes only."""
    names = [c for c in ("content", "text", "markdown", "source_markdown") if c in raw.columns]
    body = F.coalesce(*(F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in names))
    box = F.when(F.size("bbox") == 4, F.transform("bbox", lambda x: x.cast("double"))).otherwise(F.array().cast("array<double>")) if "bbox" in raw.columns else F.array().cast("array<double>")
    d = raw.withColumn("content", body).where("content is not null")
    page = F.coalesce(F.col("page_idx").cast("int"), F.lit(-1))
    return d.select(
        book, "pos", page.alias("page_idx"), box.alias("bbox"), "content", F.substring("content", 1, 4000).alias("parent_content"),
        F.substring(F.sha1(F.concat_ws("|", F.col(book).cast("string"), F.col("pos").cast("string"), F.substring("content", 1, 120))), 1, 16).alias("chunk_id"),
    )


def link_neighbors(chunks: DataFrame, keys: list[str], order: str = "chunk_index") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    near = lambda f: F.coalesce(f("chunk_id").over(w), F.lit(""))
    return chunks.withColumn("nth", F.row_number().over(w) - 1).withColumn("prev_chunk_id", near(F.lag)).withColumn("next_chunk_id", near(F.lead))


def assign_roles(chunks: DataFrame, graph_roles: DataFrame | None = None) -> DataFrame:
    """The graph's first role of a chunk where it says more than ``reference``, else the patterns' role."""
    own = roles.classify(F.col("content"))
    if graph_roles is None:
        return chunks.withColumn("role", own)
    first = graph_roles.groupBy("chunk_id").agg(F.min_by("role", "occ_order").alias("graph_role"))
    given = roles.normalise(F.col("graph_role"))
    return chunks.join(first, "chunk_id", "left").withColumn("role", F.when(given != "reference", given).otherwise(own)).drop("graph_role")


def role_distribution(chunks: DataFrame) -> DataFrame:
    """Counts by book, chapter and role, with subtotals."""
    return chunks.rollup("book_id", "chapter", "role").agg(F.count(F.lit(1)).alias("n"))


def index_health(chunks: DataFrame, postings: DataFrame, vectors: DataFrame) -> DataFrame:
    c = chunks.groupBy("book_id").agg(F.countDistinct("chapter").alias("collections"), F.count(F.lit(1)).alias("expected"))
    p = postings.groupBy("book_id").agg(F.countDistinct("chunk_id").alias("lexical"))
    v = vectors.groupBy("book_id").agg(F.countDistinct("chunk_id").alias("vectors"))
    d = c.join(p, "book_id", "full_outer").join(v, "book_id", "full_outer").fillna(0)
    return d.withColumn("healthy", (F.col("lexical") > 0) & (F.col("vectors") > 0)).withColumn("complete", F.col("lexical") >= F.col("expected"))


def book_fingerprint(chunks: DataFrame) -> DataFrame:
    """Hash of a book that depends on the order of its chunks, in four levels, so that no book is one group.

    Chunk hashes in order give a chapter's hash. Chapters are dealt by 16 bits of the hash of their name; in a bucket they are
    ordered by name. Buckets of one first byte are joined in order, and these 256 again.
    """
    joined = lambda order: F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "h"))), lambda v: v["h"]), ""))
    part = chunks.select("book_id", "chapter", "chunk_index", F.sha1(F.concat_ws("|", "chunk_id", "content")).alias("h")).groupBy("book_id", "chapter").agg(joined("chunk_index").alias("h"))
    part = part.withColumn("bucket", F.substring(F.md5("chapter"), 1, 4)).groupBy("book_id", "bucket").agg(joined("chapter").alias("h"))
    part = part.groupBy("book_id", F.substring("bucket", 1, 2).alias("top")).agg(joined("bucket").alias("h"))
    return part.groupBy("book_id").agg(joined("top").alias("fingerprint"))


def stale_scopes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Books whose stored fingerprint is missing or another one."""
    s = stored.select("book_id", F.col("fingerprint").alias("old"))
    return current.join(s, "book_id", "left").where(~F.col("fingerprint").eqNullSafe(F.col("old"))).select("book_id")


# fixed values: words in titles that tell the classes of sections, and how problems begin
STUDY_POINTS = ("学习要点", "本章要点")
EXERCISE_SECTIONS = ("习题", "练习题", "复习题", "思考题", "例题")
AUXILIARY = ("本章学习要点", "学习要点", "习题", "复习题", "思考题")
PROBLEM_START = r"(^|\n)\s*(例\s*\d*|例题|习题|练习|思考题|证明|求解|计算|判断|设\s)"


def section_ends(sections: DataFrame, chapters: DataFrame) -> DataFrame:
    """``end_page``: the page before the next section of the chapter, or the chapter's last page; never before the start.

    sections: book_id, chapter, section_no, start_page; chapters: book_id, chapter, last_page. Books without a name count.
    """
    c = chapters.select(F.col("book_id").alias("own_book"), F.col("chapter").alias("own_chapter"), "last_page")
    d = sections.join(c, sections["book_id"].eqNullSafe(c["own_book"]) & (sections["chapter"] == c["own_chapter"]), "left").drop("own_book", "own_chapter")
    following = F.lead("start_page").over(Window.partitionBy("book_id", "chapter").orderBy("start_page", "section_no"))
    return d.withColumn("end_page", F.greatest("start_page", F.coalesce(following - 1, "last_page"))).drop("last_page")


def section_class(title: Column) -> Column:
    """(kind, is_auxiliary): study points, exercises or content by the title's words; auxiliary sections aren't read as text."""
    t = F.regexp_replace(F.coalesce(title, F.lit("")), r"[\s\x{3000}]+", "")
    named = lambda words: F.greatest(*(F.contains(t, F.lit(w)) for w in words))
    return F.struct(F.when(named(STUDY_POINTS), "study_points").when(named(EXERCISE_SECTIONS), "exercise").otherwise("content").alias("kind"), named(AUXILIARY).alias("is_auxiliary"))


def sections_by_page(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks with each section of their chapter whose pages hold them; with its class where sections have a ``title``."""
    s = sections.select("book_id", "chapter", "section_no", "start_page", "end_page", *([section_class(F.col("title")).alias("c")] if "title" in sections.columns else []))
    if "c" in s.columns:
        s = s.select("book_id", "chapter", "section_no", "start_page", "end_page", F.col("c.kind").alias("section_kind"), F.col("c.is_auxiliary").alias("is_auxiliary"))
    return chunks.join(s, ["book_id", "chapter"]).where(F.col("page_idx").between(F.col("start_page"), F.col("end_page")))


def chapter_of_page_range(ranges: DataFrame, chapters: DataFrame) -> DataFrame:
    """The first chapter (by index) that holds both ends of a range; null if none does."""
    c = chapters.select("book_id", "chapter_no", "first_page", "last_page")
    hit = ranges.join(c, "book_id").where((F.col("first_page") <= F.col("start")) & (F.col("last_page") >= F.col("end")) & (F.col("start") <= F.col("end")))
    return ranges.join(hit.groupBy("range_id").agg(F.min("chapter_no").alias("chapter_no")), "range_id", "left")


def images_in_sections(images: DataFrame, sections: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Images whose page lies in a section, one row per path, the earliest.

    With ``chunks`` (book_id, chapter, page_idx), an image also stays whose page one of them is on, and a chapter that has neither
    chunks with a page nor sections that begin on one keeps all its images. A section without an end ends where it begins.
    """
    s = sections.select("book_id", "chapter", "start_page", F.greatest("start_page", F.coalesce("end_page", "start_page")).alias("end_page")).where("start_page is not null")
    own = (F.col("i.book_id") == F.col("s.book_id")) & (F.col("i.chapter") == F.col("s.chapter"))
    i = images.alias("i")
    inside = i.join(s.alias("s"), own & F.col("i.page_idx").between(F.col("s.start_page"), F.col("s.end_page")), "left_semi")
    if chunks is not None:
        keys = ["book_id", "chapter"]
        pages = chunks.where("page_idx >= 0").select(*keys, "page_idx").distinct()
        on_page = images.join(pages, [*keys, "page_idx"], "left_semi")
        free = images.join(pages.select(*keys).union(s.select(*keys)).distinct(), keys, "left_anti")
        inside = inside.unionByName(on_page).unionByName(free)
    return inside.groupBy("book_id", "path").agg(F.min("page_idx").alias("page_idx"), F.min("pos").alias("pos"))


def captions(items: DataFrame, keys: list[str], order: str = "pos", pattern: str = r"(图|表|Figure|Table)", most: int = 2) -> DataFrame:
    """Captions of each item from itself and two neighbours on either side on the page."""
    w = Window.partitionBy(*keys, "page_idx").orderBy(order).rowsBetween(-2, 2)
    return items.withColumn("captions", F.slice(F.filter(F.collect_list("content").over(w), lambda x: x.rlike(pattern)), 1, most))


def dedupe_blocks(docs: DataFrame, key: str = "doc_id", sep: str = r"\n\s*\n", join: str = "\n\n") -> DataFrame:
    """Repeated blocks of a text drop, the first stays; white space doesn't count."""
    norm = lambda x: F.regexp_replace(x, r"\s+", "")
    blocks = F.filter(F.transform(F.split("text", sep), lambda x: F.trim(x)), lambda x: x != "")
    # in the array: a block stays if its normal form stands first there
    xs = F.transform(blocks, lambda x: F.struct(norm(x).alias("n"), x.alias("t")))
    d = docs.select(key, xs.alias("xs")).withColumn("ns", F.transform("xs", lambda x: x["n"]))
    kept = F.filter("xs", lambda x, i: F.array_position("ns", x["n"]) == i + 1)
    return d.select(key, F.array_join(F.transform(kept, lambda x: x["t"]), join).alias("text"), (F.size("xs") - F.size(kept)).alias("dropped"))


def resolve_resources(books: DataFrame, selected: DataFrame) -> DataFrame:
    """For each chosen book the books of its group (or subject): core first, then priority, then name; first core is primary."""
    own = books.select("book_id", F.coalesce("grp", "subject").alias("grp"), F.col("book_role").alias("role"))
    chosen = selected.join(own, "book_id").select(F.col("book_id").alias("chosen"), "grp", F.col("role").alias("chosen_role"))
    b = books.select("book_id", F.coalesce("grp", "subject").alias("g"), "book_role", F.greatest(F.lit(0.05), F.least(F.lit(2.0), F.coalesce("rag_priority", F.when(F.col("book_role") == "reference", 0.55).otherwise(1.0)))).alias("rag_priority"))
    d = chosen.join(b, chosen["grp"] == b["g"]).where((F.col("chosen_role") != "standalone") | (F.col("book_id") == F.col("chosen")))
    d = d.where((F.col("chosen_role") == "standalone") | F.col("book_role").isin("core", "reference"))
    w = Window.partitionBy("chosen").orderBy((F.col("book_role") != "core").cast("int"), F.desc("rag_priority"), "book_id")
    return d.select("chosen", "book_id", "book_role", "rag_priority", F.row_number().over(w).alias("rank")).withColumn("is_primary", F.col("rank") == 1)


def section_examples(chunks: DataFrame, sections: DataFrame, cap: int = 5000) -> DataFrame:
    """A section's examples and exercises, by role or by how they begin, each under its reference; ``cap`` characters at most.

    Only chunks that begin before the cap are gathered, so no section is an unbounded group.
    """
    d = sections_by_page(chunks.where(F.col("role").isin("example", "exercise") | F.col("content").rlike(PROBLEM_START)), sections)
    d = d.withColumn("part", F.concat(F.lit("["), "chunk_id", F.lit("; "), F.coalesce(F.when(F.col("role") != "", F.col("role")), F.lit("problem")), F.lit("]\n"), F.trim("content")))
    w = Window.partitionBy("book_id", "chapter", "section_no").orderBy("chunk_index", "part")
    d = d.withColumn("upto", F.sum(F.length("part") + 2).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("upto") - F.length("part") - 2)
    near = F.array_sort(F.collect_list(F.when(F.col("before") < cap, F.struct("chunk_index", "part"))))
    g = d.groupBy("book_id", "chapter", "section_no").agg(F.array_join(F.transform(near, lambda x: x["part"]), "\n\n").alias("text"), (F.max("upto") - 2).alias("chars"))
    return g.select("book_id", "chapter", "section_no", F.substring("text", 1, cap).alias("text"), (F.col("chars") > cap).alias("cut"))


def practice_appendix(chunks: DataFrame, sections: DataFrame, most: int = 12, cap: int = 700) -> DataFrame:
    """Example and exercise chunks by section: the first ``most`` with shortened text, and how many more there are."""
    d = sections_by_page(chunks.where(F.col("role").isin("example", "exercise")), sections)
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("book_id", "chapter", "section_no").orderBy("chunk_index")))
    head = F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", F.substring("content", 1, cap).alias("t")))))
    return d.groupBy("book_id", "chapter", "section_no").agg(F.array_join(F.transform(head, lambda x: x["t"]), "\n").alias("text"), F.greatest(F.lit(0), F.count(F.lit(1)) - most).alias("more"))


SECTION = "key string, part int, section_path array<string>, body string"


def split_sections(chapters: DataFrame, title: str = "title") -> DataFrame:
    """(key, part, section_path, body): a heading of n marks cuts the path to n - 1 (1 at least) and adds itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                path, body, parts = [r.title], [], []
                for line in (r.text or "").split("\n"):
                    head = line.lstrip("#")
                    n = len(line) - len(head)
                    if 0 < n <= 6 and head.startswith(" ") and head.strip():
                        parts.append((list(path), "\n".join(body).strip()))
                        path, body = [*path[: max(1, n - 1)], head.strip()], []
                    else:
                        body.append(line)
                parts.append((list(path), "\n".join(body).strip()))
                rows += [(r.key, i, p, t) for i, (p, t) in enumerate(x for x in parts if x[1])]
            yield pd.DataFrame(rows, columns=["key", "part", "section_path", "body"])

    return chapters.select(F.col("key").cast("string").alias("key"), F.col(title).alias("title"), "text").mapInPandas(run, SECTION)


# fixed values: separators from coarse to fine
SEPARATORS = ("\n\n", "\n", "。", "；", "，", " ", "")


def split_text(text: str, size: int, overlap: int, seps: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that occurs; neighbours share up to ``overlap``."""
    sep, finer = "", ()
    for i, s in enumerate(seps):
        if s == "" or s in text:
            sep, finer = s, seps[i + 1 :]
            break
    raw = list(text) if sep == "" else [p if i == 0 else sep + p for i, p in enumerate(text.split(sep))]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if whole := "".join(held).strip():
            out.append(whole)

    for piece in (p for p in raw if p):
        if len(piece) > size and finer:
            flush()
            held.clear()
            out.extend(split_text(piece, size, overlap, finer))
            continue
        if held and sum(map(len, held)) + len(piece) > size:
            flush()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(piece) > size):
                held.pop(0)
        held.append(piece)
    flush()
    return out


CHUNK = "key string, part int, idx int, chunk_id string, content string, retrieval_text string, parent_content string"


PIECES = 2_000  # so many rows are held at a time, each with its section's head


def split_chunks(sections: DataFrame, size: int = 700, overlap: int = 80) -> DataFrame:
    """Bounded chunks of the sections, with ids that follow from their place and text."""
    return sections.mapInPandas(_split_batches(size, overlap), CHUNK)


def _split_batches(size: int, overlap: int):
    columns = ["key", "part", "idx", "chunk_id", "content", "retrieval_text", "parent_content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                path, head = " > ".join(r.section_path), r.body[:2000]
                for i, c in enumerate(split_text(r.body, size, overlap)):
                    key = hashlib.md5(f"{r.key}|{path}|{r.part}|{i}|{c[:120]}".encode()).hexdigest()[:16]
                    rows.append((r.key, r.part, i, key, c, f"{path}\n{c}", head))
                    if len(rows) == PIECES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    return run


def pack_text(parts: DataFrame, most: int = 2500) -> DataFrame:
    """(key, batch, text): ordered parts (key, pos, text) packed greedily, joined by line feeds; a part longer than ``most`` stands alone.

    Empty parts at a batch's start are left out. No key's parts are gathered: the last part that fits after each possible start
    comes from running sums; which starts are taken follows from the first one by jumps of 1, 2, 4 and so on batches.
    """
    whole = Window.partitionBy("key").orderBy("pos", "text")
    p = parts.select("key", "pos", "text").where("text is not null").withColumn("i", F.row_number().over(whole)).withColumn("end", F.sum(F.length("text") + 1).over(whole))
    later = whole.rowsBetween(0, Window.unboundedFollowing)
    p = written(p.withColumn("full", F.min(F.when(F.col("text") != "", F.col("i"))).over(later)), "parts")  # the first part from here with text
    ends = p.select("key", F.col("end").alias("at"), F.lit(0).alias("kind"), "i")
    limits = p.where("text <> ''").select("key", (F.col("end") - F.length("text") + most).alias("at"), F.lit(1).alias("kind"), "i")
    order = Window.partitionBy("key").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    fits = ends.union(limits).withColumn("last", F.max(F.when(F.col("kind") == 0, F.col("i"))).over(order)).where("kind = 1")
    spans = written(fits.select("key", "i", (F.greatest("i", "last") + 1).alias("stop")), "spans")  # parts i to stop - 1 make a batch
    jump = written(spans.join(p.select("key", F.col("i").alias("stop"), F.col("full").alias("to")), ["key", "stop"]).where("to is not null").select("key", "i", "to"), "jump")
    taken = p.groupBy("key").agg(F.min("full").alias("i")).where("i is not null")
    while not jump.isEmpty():
        taken = written(taken.union(taken.join(jump, ["key", "i"]).select("key", F.col("to").alias("i"))), "taken")
        jump = written(jump.join(jump.select("key", F.col("i").alias("to"), F.col("to").alias("far")), ["key", "to"]).select("key", "i", F.col("far").alias("to")), "jump")
    starts = taken.join(spans, ["key", "i"]).withColumn("batch", F.row_number().over(Window.partitionBy("key").orderBy("i")) - 1)
    run = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    of = p.join(starts, ["key", "i"], "left").withColumn("batch", F.last("batch", True).over(run)).withColumn("stop", F.last("stop", True).over(run)).where("i < stop")
    return of.groupBy("key", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n").alias("text"))


# fixed values: headings of generated notes that go with all that stands below them
UNWANTED = ("本章重点", "本节重点", "分节重点", "总章节", "章节总览", "整体总结", "本章总结", "本章学习要点参考", "本章学习要点", "学习要点参考", "教材例题与习题资源")
HEADING = r"^(#{1,6})\s+(.+?)\s*$"


def plain_heading(title: Column) -> Column:
    """A heading without marks of code, bold type, links, formulas and white space."""
    for pattern, to in ((r"`([^`]+)`", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\$+", ""), (r"\s+", "")):
        title = F.regexp_replace(title, pattern, to)
    return title


def without_unwanted(notes: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text): each text without headings of level 1 and 2, and without unwanted headings and their scopes.

    A scope reaches to the next heading of its level or a higher one. A line lies in one if for some level the last unwanted
    heading of that level is also the last heading of that or a higher level.
    """
    lines = notes.select(key, F.posexplode(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"\s+$", ""))).alias("i", "line"))
    level = F.length(F.regexp_extract("line", HEADING, 1))
    title = plain_heading(F.regexp_extract("line", HEADING, 2))
    bad = F.lit(False)
    for x in UNWANTED:
        bad = bad | F.contains(title, F.lit(x))
    lines = lines.withColumn("level", level).withColumn("bad", (F.col("level") > 0) & bad)
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    hidden = F.lit(False)
    for n in range(1, 7):
        last_bad = F.max(F.when(F.col("bad") & (F.col("level") == n), F.col("i"))).over(w)
        last = F.max(F.when((F.col("level") > 0) & (F.col("level") <= n), F.col("i"))).over(w)
        hidden = hidden | F.coalesce(last_bad == last, F.lit(False))
    kept = lines.withColumn("hidden", hidden).where(~F.col("hidden") & ~F.col("level").isin(1, 2))
    joined = kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias(text))
    return notes.select(key).distinct().join(joined, key, "left").select(key, F.coalesce(text, F.lit("")).alias(text))


def assemble_notes(notes: DataFrame, sections: DataFrame) -> DataFrame:
    """Notes (section_ids, batch, text) under their first section, by batch, without headings of level 1 and 2 and unwanted parts."""
    told = written(notes.select(F.get("section_ids", F.lit(0)).alias("section_id"), "batch", "text").withColumn("note", F.monotonically_increasing_id()), "notes")
    n = told.select("section_id", "batch", "note").join(without_unwanted(told, "note"), "note").drop("note")
    joined = n.groupBy("section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    clean = dedupe_blocks(joined, "section_id")
    return sections.join(clean, "section_id", "left").select(*sections.columns, F.coalesce("text", F.lit("")).alias("text"))

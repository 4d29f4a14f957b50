"""Book, chapter, section and concept as a tree, by the numbers and words of titles; where a concept belongs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.numerals import NUMERAL, titled_number

# fixed values
UNPLACED = "未分类"
NO_TITLES = ("(no title)", "本章学习要点", "习题", "思考题", "参考文献", "附录", "")


def short_title(c: Column) -> Column:
    """The 第n章 of a title, or its first 30 characters."""
    numbered = F.regexp_extract(c, f"第[{NUMERAL}]+章", 0)
    return F.when(numbered != "", numbered).otherwise(F.substring(c, 1, 30))


def chapter_of_concept(occurrences: DataFrame, order: list[str], noise: tuple[str, ...] = NO_TITLES) -> DataFrame:
    """(concept_id, chapter, by): the title that a concept occurs under most often, of equals the one seen first by ``order``.

    occurrences: concept_id, chapter and section titles (null, empty and meaningless ones don't count). A concept without any
    chapter title takes its most frequent section title.
    """
    kinds = F.array(F.struct(F.lit("chapter").alias("by"), F.col("chapter").alias("title")), F.struct(F.lit("section").alias("by"), F.col("section").alias("title")))
    told = occurrences.select("concept_id", F.struct(*order).alias("at"), F.explode(kinds).alias("x")).select("concept_id", "at", "x.by", "x.title").where(F.col("title").isNotNull() & ~F.col("title").isin(*noise))
    n = told.groupBy("concept_id", "by", "title").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    w = Window.partitionBy("concept_id").orderBy("by", F.desc("n"), "at")
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select("concept_id", short_title(F.col("title")).alias("chapter"), "by")


def numbered_titles(rows: DataFrame, within: list[str], kind: str) -> DataFrame:
    """Adds ``number``: that of the title, or else its place (``pos``, from 0) plus one; of equal numbers the last row stays."""
    n = rows.withColumn("number", F.coalesce(titled_number(F.col("title"), kind), F.col("pos") + 1))
    w = Window.partitionBy(*within, "number").orderBy(F.desc("pos"))
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def section_tree(concepts: DataFrame, chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """Edges (parent, child, level): root, books, chapters, sections, concepts.

    concepts: concept_id, book_id, chapter (a title, whole or short). chapters: book_id, pos, title. sections: book_id, chapter_pos,
    pos, title. A concept belongs to the chapter of its book with an equal title, or with its number and a title that contains or is
    contained; without these to the first chapter whose title does. It stands under that chapter's first section by key;
    without chapter or section it is unplaced in its book. Equal titles and numbers meet by key; only the other distinct titles
    are compared with the chapters of their book.
    """
    ch = numbered_titles(chapters, ["book_id"], "章").select("book_id", F.col("pos").alias("chapter_pos"), F.col("title").alias("whole"), F.concat(F.lit("第"), "number", F.lit("章")).alias("chapter_key"), "number")
    se = numbered_titles(sections, ["book_id", "chapter_pos"], "节").select("book_id", "chapter_pos", F.col("number").alias("section_number"))
    se = se.join(ch.select("book_id", "chapter_pos", "chapter_key"), ["book_id", "chapter_pos"]).withColumn("section_key", F.concat_ws(".", "chapter_key", "section_number"))
    first = se.groupBy("book_id", "chapter_key").agg(F.min("section_key").alias("section_key"))
    titles = concepts.select("book_id", "chapter").where(F.coalesce("chapter", F.lit("")) != "").distinct()
    t, c = F.col("t.chapter"), F.col("c.whole")
    equal = titles.alias("t").join(ch.alias("c"), (F.col("t.book_id") == F.col("c.book_id")) & (t == c))
    by_number = titles.withColumn("n", titled_number(F.col("chapter"), "章")).where("n is not null").alias("t").join(ch.alias("c"), (F.col("t.book_id") == F.col("c.book_id")) & (F.col("t.n") == F.col("c.number"))).where(F.contains(c, t) | F.contains(t, c))
    known = equal.select(F.col("t.book_id").alias("book_id"), t.alias("chapter"), F.col("c.chapter_key").alias("chapter_key"), F.col("c.chapter_pos").alias("chapter_pos"))
    known = known.union(by_number.select("t.book_id", t, "c.chapter_key", "c.chapter_pos"))
    rest = titles.join(known.select("book_id", "chapter").distinct(), ["book_id", "chapter"], "left_anti").alias("t")
    other = rest.join(ch.alias("c"), F.col("t.book_id") == F.col("c.book_id")).where(F.contains(c, t) | F.contains(t, c)).select("t.book_id", t, "c.chapter_key", "c.chapter_pos")
    placed = known.union(other).groupBy("book_id", "chapter").agg(F.min_by("chapter_key", "chapter_pos").alias("chapter_key")).join(first, ["book_id", "chapter_key"])
    where = concepts.select("concept_id", "book_id", "chapter").join(placed, ["book_id", "chapter"], "left")
    key = lambda *x: F.concat_ws("/", "book_id", *x)
    books = chapters.select("book_id").union(concepts.select("book_id")).distinct()
    levels = [
        books.select(F.lit("root").alias("parent"), F.col("book_id").alias("child"), F.lit(1).alias("level")),
        ch.select("book_id", key("chapter_key"), F.lit(2)),
        se.select(key("chapter_key"), key("section_key"), F.lit(3)),
        where.where("section_key is null").select("book_id", key(F.lit(UNPLACED)), F.lit(2)),
        where.select(key(F.coalesce("section_key", F.lit(UNPLACED))), F.concat_ws("::", key(F.coalesce("section_key", F.lit(UNPLACED))), "concept_id"), F.when(F.col("section_key").isNull(), 3).otherwise(4)),
    ]
    out = levels[0]
    for x in levels[1:]:
        out = out.union(x)
    return out.distinct()

"""Readers and writers: OCR item lists, page trees, chunk lines, Markdown folders, plain tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXTS = T.ArrayType(T.StringType())
ITEM = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("code_body", T.StringType()), T.StructField("latex", T.StringType()),
    T.StructField("text_level", T.IntegerType()), T.StructField("page_idx", T.IntegerType()), T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("image_caption", T.StringType()), T.StructField("table_caption", T.StringType()), T.StructField("image_footnote", T.StringType()), T.StructField("table_footnote", T.StringType()),
])
SPAN = T.StructType([T.StructField("content", T.StringType())])
LINE = T.StructType([T.StructField("spans", T.ArrayType(SPAN))])
_LEAF = T.StructType([T.StructField("type", T.StringType()), T.StructField("lines", T.ArrayType(LINE))])
BLOCK = T.StructType([T.StructField("type", T.StringType()), T.StructField("lines", T.ArrayType(LINE)), T.StructField("blocks", T.ArrayType(_LEAF))])
MIDDLE = T.StructType([T.StructField("pdf_info", T.ArrayType(T.StructType([T.StructField("page_idx", T.IntegerType()), T.StructField("para_blocks", T.ArrayType(BLOCK))])))])
CHUNK = T.StructType([T.StructField(n, T.StringType()) for n in ("chunk_id", "text", "section_title", "role", "book_id", "subject", "rag_priority")] + [T.StructField("page_idx", T.IntegerType())])
ROLES = {"formula": "derivation", "text": "reference"}


def scratch(spark, name: str) -> str:
    """A new path in the folder that executors share; local sessions without one use a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-scholia-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    _made.append((spark.sparkContext.applicationId, path))
    return path


_made: list[tuple[str, str]] = []  # scratch paths by application


def clear_scratch(spark: SparkSession) -> int:
    """Removes the scratch folders that this application made so far; results that read them must have been written. How many."""
    own = [p for app, p in _made if app == spark.sparkContext.applicationId]
    for p in own:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made[:] = [x for x in _made if x[1] not in set(own)]
    return len(own)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, for what several steps read."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _caption(c: Column) -> Column:
    """Captions come as a string or as a list in JSON; both give lines."""
    listed = F.from_json(F.when(F.startswith(F.trim(c), F.lit("[")), c), TEXTS)
    return F.coalesce(F.array_join(listed, "\n"), c)


def item_text(parts: list[Column]) -> Column:
    """The non-blank parts, trimmed, one under another."""
    return F.array_join(F.filter(F.array(*(F.trim(F.coalesce(p, F.lit(""))) for p in parts)), lambda x: x != ""), "\n")


def read_ocr_content(spark: SparkSession, path: str) -> DataFrame:
    """Items of OCR content lists (one JSON array a file): book_id from the file name, position, text and place.

    A file is read by one task, as an array can't be split; books spread over files.
    """
    raw = spark.read.text(path, wholetext=True)
    own = [c for c in raw.columns if c != "value"]  # folders named key=value give columns
    raw = raw.select(F.col("_metadata.file_name").alias("file"), "value", *own)
    d = raw.select("file", *own, F.posexplode(F.from_json("value", T.ArrayType(ITEM))).alias("pos", "i")).select(F.regexp_replace("file", r"\.json$", "").alias("book_id"), *own, "pos", "i.*")
    parts = [F.col("text"), F.col("code_body"), F.col("latex"), *(_caption(F.col(c)) for c in ("image_caption", "table_caption", "image_footnote", "table_footnote"))]
    return d.select("book_id", *own, "pos", "type", "text_level", "page_idx", "bbox", item_text(parts).alias("text"))


def read_ocr_middle(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Text items of page trees: spans of a line joined by blanks, lines by line feeds; nested blocks one level deep.

    A file is one tree or, with ``whole_files`` off, has one in each line and can be split.
    """
    raw = spark.read.text(path, wholetext=whole_files)
    own = [c for c in raw.columns if c != "value"]  # folders named key=value give columns
    raw = raw.select(F.col("_metadata.file_name").alias("file"), *own, F.from_json("value", MIDDLE).alias("m"))
    pages = raw.select("file", *own, F.posexplode("m.pdf_info").alias("page_no", "p"))
    blocks = pages.select("file", *own, F.coalesce("p.page_idx", "page_no").alias("page_idx"), "page_no", F.posexplode("p.para_blocks").alias("block_no", "b"))
    lines = F.concat(F.coalesce("b.lines", F.array().cast(T.ArrayType(LINE))), F.flatten(F.transform(F.coalesce("b.blocks", F.array().cast(T.ArrayType(_LEAF))), lambda x: F.coalesce(x["lines"], F.array().cast(T.ArrayType(LINE))))))
    text = F.array_join(F.filter(F.transform(lines, lambda ln: F.trim(F.array_join(F.transform(ln["spans"], lambda s: s["content"]), " "))), lambda x: x != ""), "\n")
    d = blocks.select(F.regexp_replace("file", r"\.json$", "").alias("book_id"), *own, "page_idx", "page_no", "block_no", F.col("b.type").alias("type"), text.alias("text"))
    return d.where("text <> ''")


def read_chunk_jsonl(spark: SparkSession, path: str, book: str = "default", subject: str = "", priority: float = 1.0) -> DataFrame:
    """OCR chunk lines: blank texts go, titles in one line of 120 characters, roles mapped, defaults filled."""
    d = spark.read.schema(CHUNK).json(path).where(F.trim("text") != "")
    role = F.coalesce("role", F.lit("text"))
    for a, b in ROLES.items():
        role = F.when(role == a, b).otherwise(role)
    title = F.substring(F.trim(F.regexp_replace(F.coalesce("section_title", F.lit("")), r"\s+", " ")), 1, 120)
    return d.select("chunk_id", "text", title.alias("section_title"), role.alias("role"), F.coalesce("book_id", F.lit(book)).alias("book_id"), F.coalesce("subject", F.lit(subject)).alias("subject"),
                    F.coalesce(F.col("rag_priority").try_cast("double"), F.lit(priority)).alias("rag_priority"), F.coalesce("page_idx", F.lit(-1)).alias("page_idx"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Lines of Markdown files (file, pos, text) in order of path, without line ends; after a last line end stands one empty line.

    Files are read in splits and no file is held whole. A line's place is its split's first one and its place in the split; lines
    are written once for that. A byte order mark is left out.
    """
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_size", "bytes"), ("file_block_start", "start"))]
    raw = spark.read.schema("value string").option("lineSep", "\n").text(path).select(*meta, "value")
    own = F.split(F.regexp_replace("value", r"\r\z", ""), "\r")  # line feeds are cut already, other line ends are not
    raw = raw.select("file", "bytes", "start", (F.octet_length("value") + 1).alias("own_bytes"), F.endswith("value", F.lit("\r")).alias("returned"), F.posexplode(own).alias("at", "text"))
    lines = written(raw.withColumn("id", F.monotonically_increasing_id()), "lines")  # a split's ids follow each other
    first = F.col("at") == 0
    splits = lines.groupBy("file", "bytes", "start").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.sum(F.when(first, F.col("own_bytes"))).alias("read"), F.max_by("returned", "id").alias("returned"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("before", F.coalesce(before, F.lit(0)))
    body = lines.join(F.broadcast(splits.select("file", "start", "least", "before")), ["file", "start"]).select("file", (F.col("before") + F.col("id") - F.col("least")).cast("int").alias("pos"), "text")
    # all bytes but a mark's three were lines and their ends: the last line had one
    ended = F.col("returned") | (F.col("bytes") - F.col("read")).isin(0, 3)
    last = splits.groupBy("file", "bytes").agg(F.sum("n").cast("int").alias("pos"), F.sum("read").alias("read"), F.max_by("returned", "start").alias("returned"))
    return body.union(last.where(ended).select("file", "pos", F.lit("").alias("text")))


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, in one folder for each value of ``by`` where given; rows of a value are brought together first."""
    w = (df.repartition(by) if by else df).write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)

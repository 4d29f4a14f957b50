"""Queries on chapters, chunks, roles and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import roles
from scholia.operators import ingest as op
from scholia.sources import study
from scholia.sources.study import with_study

from .registry import query



def _hits_sql(role: str) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all(t, '(?im){p}'))" for p in roles.PATTERNS[role]) + ")"


def _role_sql() -> str:
    marks = " + ".join(f"(length(t) - length(replace(t, '{m}', ''))) // {len(m)}" for m in roles.MATH_MARKS)
    extra = {
        "formula": f" + CASE WHEN ({marks}) >= 3 OR (regexp_matches(t, '{roles.EQUATION}') AND length(t) < 1200) THEN 1 ELSE 0 END",
        "theorem": f" + CASE WHEN {_hits_sql('theorem')} > 0 AND {_hits_sql('proof')} > 0 THEN 1 ELSE 0 END",
    }
    scored = (f"{{'s': -({_hits_sql(r)}{extra.get(r, '')}), 'i': {i}, 'r': '{r}'}}" for i, r in enumerate(roles.PRIORITY))
    return f"list_min([{', '.join(scored)}])"


ROLE_SQL = _role_sql()
WITH_ROLES = with_study("chunks", "sections") + f", classified AS (SELECT *, CASE WHEN b.s < 0 THEN b.r ELSE 'reference' END AS own_role FROM (SELECT *, {ROLE_SQL} AS b FROM (SELECT *, trim(content) AS t FROM chunks)))"
PLACE_ROLE = "['definition', 'theorem', 'example', 'exercise', 'reference'][chunk_index % 5 + 1]"


def _place_role(d):
    return d.withColumn("role", F.element_at(F.array(*map(F.lit, ("definition", "theorem", "example", "exercise", "reference"))), F.col("chunk_index") % 5 + 1))


@query(with_study("pages_items") + """, h AS (SELECT *, coalesce(type = 'title' AND length(trim(text)) <= 80, false) AS head FROM pages_items), n AS (SELECT *, sum(head::INT) OVER (PARTITION BY page_id ORDER BY pos) AS chapter_no FROM h)
SELECT page_id, chapter_no::BIGINT AS chapter_no, coalesce(max(CASE WHEN head THEN trim(text) END), '全文') AS title, coalesce(string_agg(CASE WHEN NOT head THEN text END, chr(10) ORDER BY pos), '') AS text, min(pos)::INT AS first_page, max(pos)::INT AS last_page FROM n GROUP BY ALL""")
def in1_chapters_from_items(spark, sf_dir):
    i = study.pages_items(spark, sf_dir).withColumn("text_level", F.when(F.col("type") == "title", 1)).withColumn("type", F.lit("text")).withColumn("page_idx", F.col("pos"))
    return op.chapters_from_items(i, "page_id", heading=".")


@query(with_study("pages_items") + r""", l AS (SELECT page_id, pos, CASE WHEN type = 'title' THEN '# ' || trim(text) ELSE text END AS text FROM pages_items), h AS (SELECT *, regexp_matches(text, '^(#{1,3})\s+(\S.{0,119})$') AS head FROM l), n AS (SELECT *, sum(head::INT) OVER (PARTITION BY page_id ORDER BY pos) AS chapter_no FROM h)
SELECT page_id, chapter_no::BIGINT AS chapter_no, coalesce(max(CASE WHEN head THEN trim(regexp_extract(text, '^(#{1,3})\s+(\S.{0,119})$', 2)) END), '全文') AS title, length(coalesce(string_agg(CASE WHEN NOT head THEN text END, chr(10) ORDER BY pos), '')) AS chars FROM n GROUP BY ALL""")
def in2_chapters_from_markdown(spark, sf_dir):
    i = study.pages_items(spark, sf_dir).select("page_id", "pos", F.when(F.col("type") == "title", F.concat(F.lit("# "), F.trim("text"))).otherwise(F.col("text")).alias("text"))
    return op.chapters_from_markdown(i, "page_id").select("page_id", "chapter_no", "title", F.length("text").alias("chars"))


ROWS_SQL = ", r AS (SELECT book_id, chapter::BIGINT * 1000 + chunk_index AS pos, CASE WHEN chunk_index % 4 = 0 THEN (chapter::BIGINT % 9) || '. ' ELSE '' END || left(content, 20) AS title FROM chunks)"


def _rows(spark, sf_dir):
    t = F.concat(F.when(F.col("chunk_index") % 4 == 0, F.concat((F.col("chapter").cast("long") % 9).cast("string"), F.lit(". "))).otherwise(""), F.substring("content", 1, 20))
    return study.chunks(spark, sf_dir).select("book_id", (F.col("chapter").cast("long") * 1000 + F.col("chunk_index")).alias("pos"), t.alias("title"), F.lit(True).alias("external"))


@query(with_study("chunks") + ROWS_SQL + r""", n AS (SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY book_id) AS total, last_value(nullif(regexp_extract(title, '^\s*(\d+)', 1), '') IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS number FROM r WINDOW w AS (PARTITION BY book_id ORDER BY pos)),
c AS (SELECT *, (number IS DISTINCT FROM lag(number) OVER w OR nth = 1)::INT AS changed FROM n WINDOW w AS (PARTITION BY book_id ORDER BY pos)), g AS (SELECT *, CASE WHEN total >= 80 THEN sum(changed) OVER (PARTITION BY book_id ORDER BY pos) ELSE nth END AS grp FROM c)
SELECT book_id, grp::BIGINT AS grp, min_by(title, pos) AS title, count(*) AS n_rows, min(pos) AS first_pos FROM g GROUP BY ALL""")
def in3_coalesce_heading_chapters(spark, sf_dir):
    return op.coalesce_heading_chapters(_rows(spark, sf_dir))


@query(with_study("chunks") + """ SELECT chunk_id, coalesce(last_value(CASE WHEN chunk_index % 3 = 1 THEN left(content, 20) END IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY chunk_index ROWS UNBOUNDED PRECEDING), 'root') AS section_title FROM chunks""")
def in4_inherit_section_title(spark, sf_dir):
    c = study.chunks(spark, sf_dir).withColumn("section_title", F.when(F.col("chunk_index") % 3 == 1, F.substring("content", 1, 20)).otherwise(op.UNTITLED))
    return op.inherit_section_title(c, ["chapter"], "chunk_index").select("chunk_id", "section_title")


TOC_SQL = r""", toc AS (SELECT chapter, chunk_index AS pos, CASE chunk_index % 4 WHEN 0 THEN '第' || (chunk_index // 4 + 1) || '章 ' || chunk_id || ' .... ' || (chunk_index + 1) WHEN 1 THEN (chunk_index // 4 + 1) || '.1 ' || chunk_id || ' ' || (chunk_index + 1) ELSE left(content, 30) || ' x' END AS text FROM chunks)"""


@query(with_study("chunks") + TOC_SQL + r""", k AS (SELECT chapter AS book_id, pos, CASE WHEN regexp_matches(trim(text), '^第(\d+)章\s*(.*?)[\s.·…]*(\d+)$') THEN 'chapter' WHEN regexp_matches(trim(text), '^(\d+\.\d+)\s+(.*?)[\s.·…]*(\d+)$') THEN 'section' END AS kind, trim(text) AS t FROM toc),
p AS (SELECT book_id, pos, kind, regexp_extract(t, CASE kind WHEN 'chapter' THEN '^第(\d+)章\s*(.*?)[\s.·…]*(\d+)$' ELSE '^(\d+\.\d+)\s+(.*?)[\s.·…]*(\d+)$' END, 1) AS number, regexp_extract(t, CASE kind WHEN 'chapter' THEN '^第(\d+)章\s*(.*?)[\s.·…]*(\d+)$' ELSE '^(\d+\.\d+)\s+(.*?)[\s.·…]*(\d+)$' END, 3)::INT AS page FROM k WHERE kind IS NOT NULL)
SELECT book_id, pos, kind, number, page, last_value(CASE WHEN kind = 'chapter' THEN number END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS chapter, lead(page) OVER (PARTITION BY book_id, kind ORDER BY pos) - 1 AS end_page FROM p""".replace("regexp_extract(t, CASE kind WHEN 'chapter' THEN '^第(\\d+)章\\s*(.*?)[\\s.·…]*(\\d+)$' ELSE '^(\\d+\\.\\d+)\\s+(.*?)[\\s.·…]*(\\d+)$' END, 1)", r"CASE kind WHEN 'chapter' THEN regexp_extract(t, '^第(\d+)章', 1) ELSE regexp_extract(t, '^(\d+\.\d+)', 1) END").replace("regexp_extract(t, CASE kind WHEN 'chapter' THEN '^第(\\d+)章\\s*(.*?)[\\s.·…]*(\\d+)$' ELSE '^(\\d+\\.\\d+)\\s+(.*?)[\\s.·…]*(\\d+)$' END, 3)::INT", r"regexp_extract(t, '(\d+)$', 1)::INT"))
def in5_parse_toc(spark, sf_dir):
    i, c = F.col("chunk_index"), study.chunks(spark, sf_dir)
    n = (F.floor(i / 4) + 1).cast("string")
    text = F.when(i % 4 == 0, F.concat(F.lit("第"), n, F.lit("章 "), F.col("chunk_id"), F.lit(" .... "), (i + 1).cast("string"))).when(i % 4 == 1, F.concat(n, F.lit(".1 "), F.col("chunk_id"), F.lit(" "), (i + 1).cast("string"))).otherwise(F.concat(F.substring("content", 1, 30), F.lit(" x")))
    return op.parse_toc(c.select(F.col("chapter").alias("book_id"), i.alias("pos"), text.alias("text"))).drop("title")


def _sectioned(spark, sf_dir):
    d = study.table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 6 == 2, F.concat(F.lit("## "), F.substring(x, 1, 20))).otherwise(x))
    return op.split_sections(d.select(F.col("doc_id").alias("key"), F.col("source").alias("title"), F.array_join(lines, "\n").alias("text")))


@query()
def in6_split_sections(spark, sf_dir):
    return _sectioned(spark, sf_dir)


@query()
def in7_split_chunks(spark, sf_dir):
    return op.split_chunks(_sectioned(spark, sf_dir))


@query(with_study("pages_items") + """ SELECT page_id, pos, -1 AS page_idx, trim(text) AS content, substr(trim(text), 1, 4000) AS parent_content, substr(sha1(page_id || '|' || pos || '|' || substr(trim(text), 1, 120)), 1, 16) AS chunk_id FROM pages_items WHERE trim(text) <> ''""")
def in8_normalise_chunks(spark, sf_dir):
    return op.normalise_chunks(study.pages_items(spark, sf_dir).withColumn("page_idx", F.lit(None)), "page_id").drop("bbox")


@query(with_study("chunks") + """ SELECT chunk_id, row_number() OVER w - 1 AS nth, coalesce(lag(chunk_id) OVER w, '') AS prev_chunk_id, coalesce(lead(chunk_id) OVER w, '') AS next_chunk_id FROM chunks WINDOW w AS (PARTITION BY book_id, chapter ORDER BY chunk_index)""")
def in9_link_neighbors(spark, sf_dir):
    return op.link_neighbors(study.chunks(spark, sf_dir), ["book_id", "chapter"]).select("chunk_id", "nth", "prev_chunk_id", "next_chunk_id")


@query(WITH_ROLES + " SELECT chunk_id, own_role AS role FROM classified")
def in10_classify_role(spark, sf_dir):
    return op.assign_roles(study.chunks(spark, sf_dir)).select("chunk_id", "role")


@query(WITH_ROLES + " SELECT chunk_id, CASE WHEN chunk_index % 3 = 0 THEN CASE chunk_index % 2 WHEN 0 THEN 'theorem' ELSE own_role END ELSE own_role END AS role FROM classified")
def in11_assign_roles(spark, sf_dir):
    c = study.chunks(spark, sf_dir)
    g = c.where("chunk_index % 3 = 0").select("chunk_id", F.when(F.col("chunk_index") % 2 == 0, "Lemma").otherwise("remark").alias("role"), F.lit(0).alias("occ_order"))
    g = g.union(g.select("chunk_id", F.lit("proof"), F.lit(1)))
    return op.assign_roles(c, g).select("chunk_id", "role")


@query(WITH_ROLES + " SELECT book_id, chapter, own_role AS role, count(*) AS n FROM classified GROUP BY ROLLUP (book_id, chapter, own_role)")
def in12_role_distribution(spark, sf_dir):
    return op.role_distribution(op.assign_roles(study.chunks(spark, sf_dir)))


@query(with_study("chunks") + """ SELECT book_id, count(DISTINCT chapter) AS collections, count(*) AS expected, count(DISTINCT chunk_id) FILTER (regexp_matches(lower(content), '[a-z0-9]')) AS lexical, count(DISTINCT chunk_id) FILTER (chunk_index % 2 = 0) AS vectors,
  count(DISTINCT chunk_id) FILTER (regexp_matches(lower(content), '[a-z0-9]')) > 0 AND count(DISTINCT chunk_id) FILTER (chunk_index % 2 = 0) > 0 AS healthy, count(DISTINCT chunk_id) FILTER (regexp_matches(lower(content), '[a-z0-9]')) >= count(*) AS complete FROM chunks GROUP BY book_id""")
def in13_index_health(spark, sf_dir):
    c = study.chunks(spark, sf_dir)
    return op.index_health(c, c.where(F.lower("content").rlike("[a-z0-9]")), c.where("chunk_index % 2 = 0"))


FPR_SQL = """, p AS (SELECT book_id, chapter, sha1(string_agg(sha1(chunk_id || '|' || content), '' ORDER BY chunk_index)) AS h FROM chunks GROUP BY ALL), b AS (SELECT book_id, substr(md5(chapter), 1, 4) AS bucket, sha1(string_agg(h, '' ORDER BY chapter)) AS h FROM p GROUP BY ALL),
t AS (SELECT book_id, bucket[1:2] AS top, sha1(string_agg(h, '' ORDER BY bucket)) AS h FROM b GROUP BY ALL), fp AS (SELECT book_id, sha1(string_agg(h, '' ORDER BY top)) AS fingerprint FROM t GROUP BY book_id)"""


@query(with_study("chunks") + FPR_SQL + " SELECT * FROM fp")
def in14_book_fingerprint(spark, sf_dir):
    return op.book_fingerprint(study.chunks(spark, sf_dir))


@query(with_study("chunks") + " SELECT DISTINCT book_id FROM chunks WHERE book_id IN (SELECT book_id FROM chunks WHERE chunk_index = 40) OR book_id = 'src3'")
def in14_stale_scopes(spark, sf_dir):
    c = study.chunks(spark, sf_dir)
    return op.stale_scopes(op.book_fingerprint(c), op.book_fingerprint(c.where("chunk_index <> 40")).where("book_id <> 'src3'"))


TITLED_SQL = ", sec AS (SELECT book_id, chapter, section_no, start_page, ['1.1 text', '本章 学习要点', '练习题', '思考 题'][section_no % 4 + 1] AS title FROM sections), last AS (SELECT book_id, chapter, max(page_idx) AS last_page FROM chunks GROUP BY ALL), titled AS (SELECT sec.*, greatest(start_page, coalesce(lead(start_page) OVER (PARTITION BY sec.book_id, sec.chapter ORDER BY start_page, section_no) - 1, last_page)) AS end_page FROM sec LEFT JOIN last ON last.book_id IS NOT DISTINCT FROM sec.book_id AND last.chapter = sec.chapter)"


def _titled(spark, sf_dir):
    """Sections with titles; their ends follow from the next one's start and the chapter's last page."""
    titles = F.array(*map(F.lit, ("1.1 text", "本章 学习要点", "练习题", "思考 题")))
    s = study.sections(spark, sf_dir).drop("end_page").withColumn("title", F.element_at(titles, F.col("section_no") % 4 + 1))
    return op.section_ends(s, study.chunks(spark, sf_dir).groupBy("book_id", "chapter").agg(F.max("page_idx").alias("last_page")))


@query(with_study("chunks", "sections") + TITLED_SQL + " SELECT chunk_id, section_no, CASE WHEN regexp_matches(replace(title, ' ', ''), '学习要点|本章要点') THEN 'study_points' WHEN regexp_matches(replace(title, ' ', ''), '习题|练习题|复习题|思考题|例题') THEN 'exercise' ELSE 'content' END AS section_kind, regexp_matches(replace(title, ' ', ''), '本章学习要点|学习要点|习题|复习题|思考题') AS is_auxiliary FROM chunks c JOIN titled s ON s.book_id = c.book_id AND s.chapter = c.chapter AND c.page_idx BETWEEN s.start_page AND s.end_page")
def in15_sections_by_page(spark, sf_dir):
    return op.sections_by_page(study.chunks(spark, sf_dir), _titled(spark, sf_dir)).select("chunk_id", "section_no", "section_kind", "is_auxiliary")


@query(with_study("chunks", "sections") + """, r AS (SELECT chunk_id AS range_id, chapter AS book_id, page_idx AS "start", page_idx + chunk_index % 2 AS "end" FROM chunks)
SELECT r.range_id, min(section_no) AS chapter_no FROM r LEFT JOIN sections s ON s.chapter = r.book_id AND s.start_page <= r."start" AND s.end_page >= r."end" GROUP BY r.range_id""")
def in16_chapter_of_page_range(spark, sf_dir):
    r = study.chunks(spark, sf_dir).select(F.col("chunk_id").alias("range_id"), F.col("chapter").alias("book_id"), F.col("page_idx").alias("start"), (F.col("page_idx") + F.col("chunk_index") % 2).alias("end"))
    c = study.sections(spark, sf_dir).select(F.col("chapter").alias("book_id"), F.col("section_no").alias("chapter_no"), F.col("start_page").alias("first_page"), F.col("end_page").alias("last_page"))
    return op.chapter_of_page_range(r, c).select("range_id", "chapter_no")


@query(with_study("chunks", "sections") + """ SELECT book_id, path, min(page_idx) AS page_idx, min(chunk_index) AS pos FROM (SELECT *, 'img' || chunk_index % 50 AS path FROM chunks) i WHERE EXISTS (SELECT 1 FROM sections s WHERE s.book_id = i.book_id AND s.chapter = i.chapter AND s.section_no % 2 = 0 AND i.page_idx BETWEEN s.start_page AND s.end_page) GROUP BY book_id, path""")
def in17_images_in_sections(spark, sf_dir):
    i = study.chunks(spark, sf_dir).select("book_id", "chapter", "page_idx", F.col("chunk_index").alias("pos"), F.concat(F.lit("img"), F.col("chunk_index") % 50).alias("path"))
    return op.images_in_sections(i, study.sections(spark, sf_dir).where("section_no % 2 = 0"))


@query(with_study("chunks", "sections") + """, i AS (SELECT *, 'img' || chunk_index % 50 AS path FROM chunks), pg AS (SELECT DISTINCT chapter, page_idx FROM chunks WHERE chunk_index % 7 = 0 AND chapter::INT % 3 > 0), sc AS (SELECT * FROM sections WHERE section_no % 3 = 1 AND chapter::INT % 5 > 0)
SELECT book_id, path, min(page_idx) AS page_idx, min(chunk_index) AS pos FROM i WHERE (chapter, page_idx) IN (SELECT (chapter, page_idx) FROM pg) OR EXISTS (SELECT 1 FROM sc WHERE sc.chapter = i.chapter AND i.page_idx BETWEEN sc.start_page AND sc.end_page)
 OR NOT (chapter IN (SELECT chapter FROM pg) OR chapter IN (SELECT chapter FROM sc)) GROUP BY book_id, path""")
def in17_images_by_pages(spark, sf_dir):
    """Some chapters have chunks with pages, some sections, some both or neither."""
    c, n = study.chunks(spark, sf_dir), F.col("chapter").cast("int")
    i = c.select("book_id", "chapter", "page_idx", F.col("chunk_index").alias("pos"), F.concat(F.lit("img"), F.col("chunk_index") % 50).alias("path"))
    return op.images_in_sections(i, study.sections(spark, sf_dir).where((F.col("section_no") % 3 == 1) & (n % 5 > 0)), c.where((F.col("chunk_index") % 7 == 0) & (n % 3 > 0)))


@query(with_study("chunks") + """ SELECT chunk_id, array_to_string(list_filter(list(content) OVER (PARTITION BY chapter, page_idx ORDER BY chunk_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), lambda x: regexp_matches(x, '(of|the)'))[1:2], '|') AS captions FROM chunks""")
def in17_captions(spark, sf_dir):
    return op.captions(study.chunks(spark, sf_dir), ["chapter"], "chunk_index", "(of|the)").select("chunk_id", F.array_join("captions", "|").alias("captions"))


@query(with_study("chunks", recursive=True) + """, o AS (SELECT chapter, content, row_number() OVER (PARTITION BY chapter ORDER BY chunk_index) AS i FROM chunks), walk AS (SELECT chapter, content, i, length(content) AS n, 0 AS batch FROM o WHERE i = 1
  UNION ALL SELECT o.chapter, o.content, o.i, CASE WHEN w.n + length(o.content) + 1 <= 2500 THEN w.n + length(o.content) + 1 ELSE length(o.content) END, w.batch + (w.n + length(o.content) + 1 > 2500)::INT FROM walk w JOIN o ON o.chapter = w.chapter AND o.i = w.i + 1)
SELECT chapter AS key, batch, string_agg(content, chr(10) ORDER BY i) AS text FROM walk GROUP BY ALL""")
def in18_pack_text(spark, sf_dir):
    return op.pack_text(study.chunks(spark, sf_dir).select(F.col("chapter").alias("key"), F.col("chunk_index").alias("pos"), F.col("content").alias("text")))


@query(r"""WITH b AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS xs FROM documents), n AS (SELECT doc_id, unnest(xs) AS t, generate_subscripts(xs, 1) AS i FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, regexp_replace(t, '\s+', '', 'g') ORDER BY i) AS k FROM n) SELECT b.doc_id, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (k = 1), '') AS text, count(*) FILTER (k > 1)::INT AS dropped FROM b LEFT JOIN f ON f.doc_id = b.doc_id GROUP BY b.doc_id""")
def in19_dedupe_blocks(spark, sf_dir):
    return op.dedupe_blocks(study.table(spark, sf_dir, "documents").select("doc_id", "text"), sep="\n", join="\n")


BOOKS_SQL = """books AS (SELECT source AS book_id, 'g' || (length(source) % 2) AS grp, CASE WHEN right(source, 1) IN ('0', '1') THEN 'core' WHEN right(source, 1) = '9' THEN 'standalone' ELSE 'reference' END AS book_role, (right(source, 1)::INT / 4.0)::DOUBLE AS rag_priority FROM (SELECT DISTINCT source FROM documents))"""


@query("WITH " + BOOKS_SQL + """, d AS (SELECT c.book_id AS chosen, b.book_id, b.book_role, greatest(0.05, least(2.0, b.rag_priority)) AS rag_priority FROM books c JOIN books b ON b.grp = c.grp
 WHERE CASE WHEN c.book_role = 'standalone' THEN b.book_id = c.book_id ELSE b.book_role IN ('core', 'reference') END)
SELECT *, rank = 1 AS is_primary FROM (SELECT *, row_number() OVER (PARTITION BY chosen ORDER BY (book_role <> 'core')::INT, rag_priority DESC, book_id) AS rank FROM d)""")
def in20_resolve_resources(spark, sf_dir):
    s, last = F.col("book_id"), F.substring("book_id", -1, 1)
    b = study.table(spark, sf_dir, "documents").select(F.col("source").alias("book_id")).distinct()
    b = b.select("book_id", F.concat(F.lit("g"), F.length(s) % 2).alias("grp"), F.lit("x").alias("subject"), F.when(last.isin("0", "1"), "core").when(last == "9", "standalone").otherwise("reference").alias("book_role"), (last.cast("int") / 4.0).alias("rag_priority"))
    return op.resolve_resources(b, b.select("book_id"))


@query(with_study("chunks", "sections") + r""", n AS (SELECT chapter || '_' || (page_idx // 2) AS section_id, chunk_index AS batch, CASE WHEN regexp_matches(content, '^#{1,2}\s') THEN '' ELSE trim(content) END AS t FROM chunks),
f AS (SELECT *, row_number() OVER (PARTITION BY section_id, regexp_replace(t, '\s+', '', 'g') ORDER BY batch) AS k FROM n WHERE t <> ''), j AS (SELECT section_id, string_agg(t, chr(10) || chr(10) ORDER BY batch) AS text FROM f WHERE k = 1 GROUP BY 1)
SELECT s.chapter || '_' || s.section_no AS section_id, book_id, coalesce(text, '') AS text FROM sections s LEFT JOIN j ON j.section_id = s.chapter || '_' || s.section_no""")
def in21_assemble_notes(spark, sf_dir):
    c = study.chunks(spark, sf_dir)
    s = study.sections(spark, sf_dir).select(F.concat_ws("_", "chapter", "section_no").alias("section_id"), "book_id")
    n = c.select(F.array(F.concat_ws("_", "chapter", F.floor(F.col("page_idx") / 2).cast("int"))).alias("section_ids"), F.col("chunk_index").alias("batch"), F.concat(F.lit("## x\n"), F.col("content")).alias("text"))
    return op.assemble_notes(n, s)


@query(with_study("chunks") + r""", l AS (SELECT chapter, chunk_index * 2 + 1 AS i, rtrim(content) AS line, 0 AS level, false AS bad FROM chunks UNION ALL
  SELECT chapter, chunk_index * 2, repeat('#', chunk_index % 4 + 1) || ' ' || CASE WHEN chunk_index % 3 = 0 THEN '**本章 重点** ' ELSE 'part ' END || chunk_index, chunk_index % 4 + 1, chunk_index % 3 = 0 FROM chunks),
h AS (SELECT *, """ + " OR ".join(f"coalesce(max(CASE WHEN bad AND level = {n} THEN i END) OVER w = max(CASE WHEN level BETWEEN 1 AND {n} THEN i END) OVER w, false)" for n in range(1, 7)) + """ AS hidden FROM l WINDOW w AS (PARTITION BY chapter ORDER BY i))
SELECT chapter, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT hidden AND level NOT IN (1, 2)), '')) AS text FROM h GROUP BY chapter""")
def in21_heading_scopes(spark, sf_dir):
    """Chapters with a heading of a level from 1 to 4 before each chunk, every third one unwanted."""
    i = F.col("chunk_index")
    head = F.concat(F.expr("repeat('#', chunk_index % 4 + 1)"), F.lit(" "), F.when(i % 3 == 0, "**本章 重点** ").otherwise("part "), i, F.lit("\n"), F.col("content"))
    t = study.chunks(spark, sf_dir).groupBy("chapter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(i.alias("i"), head.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return op.without_unwanted(t, "chapter").withColumn("text", F.md5("text"))


@query(with_study("chunks", "sections") + f""", d AS (SELECT c.book_id, c.chapter, section_no, content, chunk_index, row_number() OVER (PARTITION BY c.book_id, c.chapter, section_no ORDER BY chunk_index) AS rank FROM chunks c JOIN sections s ON s.book_id = c.book_id AND s.chapter = c.chapter AND c.page_idx BETWEEN s.start_page AND s.end_page WHERE {PLACE_ROLE} IN ('example', 'exercise'))
SELECT book_id, chapter, section_no, coalesce(string_agg(substr(content, 1, 700), chr(10) ORDER BY rank) FILTER (rank <= 3), '') AS text, greatest(0, count(*) - 3) AS more FROM d GROUP BY ALL""")
def in22_practice_appendix(spark, sf_dir):
    return op.practice_appendix(_place_role(study.chunks(spark, sf_dir)), study.sections(spark, sf_dir), 3)


@query(with_study("chunks", "sections") + TITLED_SQL + f""", k AS (SELECT book_id, chapter, chunk_id, chunk_index, page_idx, CASE WHEN chunk_index % 5 = 4 THEN '' ELSE {PLACE_ROLE} END AS role, CASE WHEN chunk_index % 4 = 0 THEN '证明 ' || content ELSE content END AS content FROM chunks),
d AS (SELECT k.book_id, k.chapter, section_no, chunk_index, '[' || chunk_id || '; ' || coalesce(nullif(role, ''), 'problem') || ']' || chr(10) || trim(content) AS part FROM k JOIN titled s ON s.book_id = k.book_id AND s.chapter = k.chapter AND k.page_idx BETWEEN s.start_page AND s.end_page WHERE role IN ('example', 'exercise') OR starts_with(content, '证明')),
j AS (SELECT book_id, chapter, section_no, string_agg(part, chr(10) || chr(10) ORDER BY chunk_index) AS t FROM d GROUP BY ALL) SELECT book_id, chapter, section_no, md5(substr(t, 1, 5000)) AS text, length(t) > 5000 AS cut FROM j""")
def in22_section_examples(spark, sf_dir):
    i = F.col("chunk_index")
    c = _place_role(study.chunks(spark, sf_dir)).withColumn("role", F.when(i % 5 == 4, "").otherwise(F.col("role"))).withColumn("content", F.when(i % 4 == 0, F.concat(F.lit("证明 "), "content")).otherwise(F.col("content")))
    return op.section_examples(c, _titled(spark, sf_dir)).withColumn("text", F.md5("text"))

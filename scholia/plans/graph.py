"""Queries on the concept graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scholia.operators import graph as op
from scholia.operators import order, tree
from scholia.sources import study, tables
from scholia.sources.study import with_study

from .registry import query

NORM = "translate(regexp_replace(regexp_replace({}, '[\\s\\x{{3000}}]+', '', 'g'), '[，。；：、,.;:]+$', ''), '（）［］｛｝', '()[]{{}}')"
WORDS_SQL = with_study("chunks", "concepts", "occurrences") + r", w AS (SELECT book_id, chapter, chunk_id, chunk_index, content, unnest(regexp_extract_all(content, '[^ ]+')) AS word, generate_subscripts(regexp_extract_all(content, '[^ ]+'), 1) - 1 AS pos FROM chunks)"


def _words(spark, sf_dir):
    return study.chunks(spark, sf_dir).select("book_id", "chapter", "chunk_id", "chunk_index", "content", F.posexplode(F.regexp_extract_all("content", F.lit("[^ ]+"), F.lit(0))).alias("pos", "word"))


def _all(spark, sf_dir):
    return study.concepts(spark, sf_dir), study.occurrences(spark, sf_dir), study.chunks(spark, sf_dir)


@query(WORDS_SQL + f" SELECT DISTINCT book_id, {NORM.format('word')} AS name FROM w")
def kg1_normalise_name(spark, sf_dir):
    return _words(spark, sf_dir).select("book_id", op.normalise_name(F.col("word")).alias("name")).distinct()


@query()
def kg2_cluster_concepts(spark, sf_dir):
    """A chunk's first word stands for the name that its annotation proposes."""
    w = _words(spark, sf_dir).where("pos = 0").select("book_id", F.lower("word").alias("name"), (F.col("chapter").cast("long") * 1000 + F.col("chunk_index")).alias("pos"))
    return op.cluster_concepts(w)


@query(WORDS_SQL + r", e AS (SELECT DISTINCT book_id, chunk_id, latex FROM (SELECT book_id, chunk_id, unnest(regexp_extract_all(content, '([A-Za-z]+ ?= ?[^ ]+)', 1)) AS latex FROM chunks) WHERE length(trim(latex)) >= 3) SELECT book_id, latex, count(*) AS n_chunks, array_to_string(list_sort(list_distinct(regexp_extract_all(latex, '\\?[A-Za-z]+(?:_\{?[A-Za-z0-9]+\}?)?'))), ',') AS variables FROM e GROUP BY ALL")
def kg3_extract_formulas(spark, sf_dir):
    return _formulas(spark, sf_dir).select("book_id", "latex", F.size("chunks").cast("long").alias("n_chunks"), F.array_join("variables", ",").alias("variables"))


EQUATION = r"([A-Za-z]+ ?= ?[^ ]+)"


def _formulas(spark, sf_dir):
    return op.extract_formulas(study.chunks(spark, sf_dir), EQUATION)


@query(WORDS_SQL + f", a AS (SELECT {NORM.format('alias')} AS alias, min(concept_id) AS concept_id FROM (SELECT concept_id, unnest(aliases) AS alias FROM concepts) GROUP BY 1) SELECT DISTINCT chunk_id, concept_id, CASE chunk_index % 3 WHEN 0 THEN 'definition' WHEN 1 THEN 'reference' ELSE 'proof' END AS role FROM w JOIN a ON {NORM.format('word')} = alias")
def kg4_build_occurrences(spark, sf_dir):
    t = F.when(F.col("chunk_index") % 3 == 0, "definition").when(F.col("chunk_index") % 3 == 1, "overview").otherwise("proof")
    words = F.explode(F.array_distinct(F.split("content", " "))).alias("name")  # a word of a chunk counts once
    return op.build_occurrences(study.chunks(spark, sf_dir).select("chunk_id", t.alias("content_type"), words).where("name <> ''"), study.concepts(spark, sf_dir))


@query()
def kg4_similar_occurrences(spark, sf_dir):
    """As above, with the most similar concept for words that are no alias. Held against all pairs in the tests."""
    t = F.when(F.col("chunk_index") % 3 == 0, "definition").when(F.col("chunk_index") % 3 == 1, "overview").otherwise("proof")
    words = _words(spark, sf_dir).select("chunk_id", F.lower("word").alias("name"), t.alias("content_type"))
    return op.build_occurrences(words, study.concepts(spark, sf_dir), threshold=op.SIMILAR)


@query(WORDS_SQL + """, o AS (SELECT concept_id, count(*) AS n, list_sort(list_distinct(list(role))) AS roles FROM occurrences GROUP BY ALL)
SELECT c.concept_id, coalesce(n, 0) AS n, coalesce(array_to_string(roles, ','), '') AS roles, CASE WHEN coalesce(n, 0) >= 3 AND list_contains(roles, 'definition') THEN 0.9 WHEN coalesce(n, 0) >= 2 THEN 0.7 WHEN coalesce(n, 0) = 1 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM concepts c LEFT JOIN o USING (concept_id)""")
def kg5_merge_concepts(spark, sf_dir):
    c, o, _ = _all(spark, sf_dir)
    return op.merge_concepts(c, o).select("concept_id", "n", F.array_join("roles", ",").alias("roles"), "confidence")


REL_SQL = ", r AS (SELECT DISTINCT word AS source, CASE WHEN pos % 7 = 0 THEN 'noise' ELSE 'depends_on' END AS relation, lead(word) OVER (PARTITION BY chunk_id ORDER BY pos) AS target, chunk_id AS evidence FROM w)"


def _followed(spark, sf_dir):
    """Words as in ``_words`` with the word after each, from the line itself: no rows are ordered."""
    c = study.chunks(spark, sf_dir).withColumn("ws", F.regexp_extract_all("content", F.lit("[^ ]+"), F.lit(0)))
    pairs = F.transform("ws", lambda x, i: F.struct(x.alias("word"), F.get("ws", i + 1).alias("next")))
    return c.select("book_id", "chapter", "chunk_id", "chunk_index", "content", F.posexplode(pairs).alias("pos", "w")).select("*", "w.word", "w.next").drop("w")


def _rel(spark, sf_dir):
    """What a word and the next one relate, in lower case, each once in its line; words hold no blanks."""
    c = study.chunks_of(spark, sf_dir).withColumn("ws", F.regexp_extract_all(F.lower("content"), F.lit("[^ ]+"), F.lit(0)))
    told = F.transform("ws", lambda x, i: F.concat_ws(" ", F.when(i % 7 == 0, "noise").otherwise("depends_on"), x, F.get("ws", i + 1)))
    told = F.array_distinct(F.slice(told, 1, F.greatest(F.size("ws") - 1, F.lit(0))))  # nothing comes after the last
    return c.select(F.col("chunk_id").alias("evidence"), "again", F.explode(told).alias("told")).select(
        F.split_part("told", F.lit(" "), F.lit(2)).alias("source"), F.split_part("told", F.lit(" "), F.lit(1)).alias("relation"), F.split_part("told", F.lit(" "), F.lit(3)).alias("target"), "evidence", "again")


@query(WORDS_SQL + REL_SQL + """, a AS (SELECT lower(alias) AS alias, min(concept_id) AS id FROM (SELECT concept_id, unnest(aliases) AS alias FROM concepts) GROUP BY 1), d AS (SELECT DISTINCT lower(source) AS source, relation, lower(target) AS target, evidence FROM r WHERE relation = 'depends_on' AND target IS NOT NULL)
SELECT evidence, source, target, s.id AS source_id, t.id AS target_id FROM d LEFT JOIN a s ON s.alias = source LEFT JOIN a t ON t.alias = target""")
def kg6_resolve_relations(spark, sf_dir):
    a = study.concepts(spark, sf_dir).select("concept_id", F.explode("aliases").alias("alias"))
    return op.resolve_relations(_rel(spark, sf_dir), a).select("evidence", "source", "target", "source_id", "target_id")


@query(WORDS_SQL + r", e AS (SELECT DISTINCT book_id, chunk_id, latex FROM (SELECT book_id, chunk_id, unnest(regexp_extract_all(content, '([A-Za-z]+ ?= ?[^ ]+)', 1)) AS latex FROM chunks) WHERE length(trim(latex)) >= 3) SELECT e.book_id, latex, array_to_string(list_sort(list_distinct(list(concept_id))), ',') AS concepts FROM e JOIN occurrences o ON o.chunk_id = e.chunk_id GROUP BY ALL")
def kg7_link_formulas(spark, sf_dir):
    return op.link_formulas(_formulas(spark, sf_dir), study.occurrences(spark, sf_dir)).select("book_id", "latex", F.array_join("concepts", ",").alias("concepts"))


@query(WORDS_SQL + """, c AS (SELECT *, CASE WHEN pos % 2 = 0 THEN string_split(content, '.')[1] ELSE '' END AS definition FROM w WHERE length(word) >= 2)
SELECT book_id, word AS name, count(DISTINCT chunk_id) AS n_chunks, min_by(definition, (chunk_index, chunk_id, pos)) FILTER (definition <> '') AS definition, substr(sha1(book_id || '|' || word), 1, 16) AS concept_id, coalesce(array_to_string(list_sort(list_distinct(list(lower(word)) FILTER (contains(content, lower(word))))), ','), '') AS aliases FROM c GROUP BY book_id, word""")
def kg8_evidence_graph(spark, sf_dir):
    c = _words(spark, sf_dir).withColumnRenamed("word", "name").withColumn("definition", F.when(F.col("pos") % 2 == 0, F.substring_index("content", ".", 1)).otherwise("")).withColumn("aliases", F.array(F.lower("name")))
    return op.evidence_graph(c).withColumn("aliases", F.array_join("aliases", ","))


CAND_SQL = """, cand AS (SELECT lower(word) AS name, chunk_id, pos, CASE pos % 3 WHEN 0 THEN 'definition' ELSE 'example' END AS role, CASE WHEN pos % 2 = 1 THEN string_split(content, '.')[1] ELSE '' END AS definition, (pos % 10) / 10.0::DOUBLE AS confidence, [lower(word), word] AS aliases, [lower(lead(word) OVER (PARTITION BY chunk_id ORDER BY pos))] AS prerequisites FROM w)"""


def _cand(spark, sf_dir):
    p = F.col("pos")
    return _followed(spark, sf_dir).select(
        F.lower("word").alias("name"), "chunk_id", "pos", F.when(p % 3 == 0, "definition").otherwise("example").alias("role"), F.when(p % 2 == 1, F.substring_index("content", ".", 1)).otherwise("").alias("definition"),
        ((p % 10) / 10.0).alias("confidence"), F.array(F.lower("word"), F.col("word")).alias("aliases"), F.array(F.lower("next")).alias("prerequisites"))


@query(WORDS_SQL + CAND_SQL + " SELECT name, max(confidence) AS confidence, count(DISTINCT (chunk_id, role)) AS n_occurrences, min_by(definition, (pos, chunk_id)) FILTER (definition <> '') AS definition FROM cand GROUP BY name")
def kg9_merge_candidates(spark, sf_dir):
    return op.merge_candidates(_cand(spark, sf_dir)).select("name", "confidence", "n_occurrences", "definition")


@query(WORDS_SQL + CAND_SQL + " SELECT DISTINCT name AS source, 'depends_on' AS relation, prerequisites[1] AS target FROM cand WHERE prerequisites[1] IS NOT NULL AND prerequisites[1] <> name")
def kg9_graph_from_candidates(spark, sf_dir):
    return op.graph_from_candidates(_cand(spark, sf_dir), {"prerequisites": "depends_on"}).select("source", "relation", "target")


@query(WORDS_SQL + CAND_SQL + " SELECT name, prerequisites[1] AS target, confidence FROM cand WHERE confidence >= 0.72 AND prerequisites[1] IN (SELECT canonical_name FROM concepts)")
def kg10_link_reference_book(spark, sf_dir):
    links = _cand(spark, sf_dir).select("name", F.get("prerequisites", F.lit(0)).alias("target"), "confidence", F.lit("references").alias("relation"))
    return op.link_reference_book(links, study.concepts(spark, sf_dir)).select("name", "target", "confidence")


@query(WORDS_SQL + """, m AS (SELECT chunk_id, concept_id, canonical_name, (contains(content, canonical_name))::INT + (contains(content, canonical_name || 's'))::INT AS score FROM chunks, concepts WHERE length(content) >= 80 AND contains(content, canonical_name))
SELECT chunk_id, concept_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, length(canonical_name), canonical_name) AS rank FROM m) WHERE rank <= 20""")
def kg11_candidate_concepts_per_chunk(spark, sf_dir):
    c, _, ch = _all(spark, sf_dir)
    return op.candidate_concepts_per_chunk(ch, c).select("chunk_id", "concept_id", "score", "rank")


@query(WORDS_SQL + " SELECT chunk_id, pos, greatest(0, least(1, coalesce(try_cast(CASE pos % 4 WHEN 0 THEN 'high' ELSE ((pos % 20) / 10.0)::DOUBLE::VARCHAR END AS DOUBLE), 0))) AS confidence, CASE WHEN pos % 4 <> 0 AND (pos % 20) / 10.0 >= 0.72 THEN 'machine_generated' ELSE 'needs_review' END AS status FROM w")
def kg12_normalise_candidates(spark, sf_dir):
    raw = _words(spark, sf_dir).withColumn("confidence", F.when(F.col("pos") % 4 == 0, "high").otherwise(((F.col("pos") % 20) / 10.0).cast("string"))).withColumn("aliases", F.array("word"))
    return op.normalise_candidates(raw).select("chunk_id", "pos", "confidence", "status")


@query(WORDS_SQL + " SELECT chunk_id, pos, row_number() OVER (PARTITION BY chunk_id ORDER BY c, pos) AS rank FROM (SELECT *, CASE pos % 4 WHEN 0 THEN 0.0 ELSE least(1.0, (pos % 20) / 10.0) END::DOUBLE AS c FROM w) WHERE c < 0.72")
def kg12_review_queue(spark, sf_dir):
    raw = _words(spark, sf_dir).select("chunk_id", "pos", F.when(F.col("pos") % 4 == 0, "high").otherwise(((F.col("pos") % 20) / 10.0).cast("string")).alias("confidence"))
    return op.review_queue(op.normalise_candidates(raw)).select("chunk_id", "pos", "rank")


@query(WORDS_SQL + " SELECT chunk_id FROM chunks WHERE length(content) >= 40 AND chunk_index % 3 <> 0")
def kg13_pending_chunks(spark, sf_dir):
    c = study.chunks(spark, sf_dir)
    done = c.where("chunk_index % 3 <> 2").select("chunk_id", F.when(F.col("chunk_index") % 3 == 1, "failed").alias("error"))
    return op.pending_chunks(c, done).select("chunk_id")


TERM_SCORE = "CASE WHEN ql = term THEN exact WHEN length(ql) >= 2 AND contains(term, ql) THEN 50 + length(ql) / length(term) * 50 WHEN length(term) >= 2 AND contains(ql, term) THEN least(exact - 5, 70 + length(term) / length(ql) * 20) ELSE 0 END"
# txt: text_id, question, chunk, answer, matched, tags, intent. Texts are looked through once, each distinct one.
LINK_SQL = f""", a AS (SELECT concept_id, canonical_name, unnest([canonical_name, canonical_name || 's']) AS term, unnest([100.0::DOUBLE, 90.0::DOUBLE]) AS exact FROM concepts),
spoken AS (SELECT text_id, 4 AS o, 0.78::DOUBLE AS base, question AS text FROM txt UNION ALL SELECT text_id, 5, 0.68, chunk FROM txt UNION ALL SELECT text_id, 6, 0.58, answer FROM txt),
g AS (SELECT text, concept_id, canonical_name, max_by(term, (length(term), term)) AS term FROM (SELECT DISTINCT text FROM spoken) JOIN a ON contains(lower(text), term) GROUP BY ALL),
mn AS (SELECT *, row_number() OVER (PARTITION BY text_id, o ORDER BY concept_id) AS n, strpos(lower(text), term) AS place FROM spoken JOIN g USING (text)),
asked AS (SELECT text_id, 2 AS o, 0.86::DOUBLE AS base, unnest(tags) AS words FROM txt UNION ALL SELECT text_id, 3, 0.9, question FROM txt),
sm AS (SELECT words, concept_id, canonical_name, round(max({TERM_SCORE}), 6) AS score FROM (SELECT DISTINCT words, lower(trim(words)) AS ql FROM asked) JOIN a ON ql <> '' AND (contains(ql, term) OR contains(term, ql)) GROUP BY ALL),
sc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY words ORDER BY score DESC, canonical_name) AS r FROM sm WHERE score > 0) WHERE r <= 5),
kn AS (SELECT known, min((concept_id, canonical_name)) AS c FROM (SELECT concept_id, canonical_name, term AS known FROM a) GROUP BY known),
fd AS (SELECT text_id, c[1] AS concept_id, c[2] AS canonical_name, 1 AS o, 1.0::DOUBLE AS confidence, coalesce(question, '') AS evidence FROM (SELECT text_id, question, lower(trim(unnest(matched))) AS known FROM txt) JOIN kn USING (known)
  UNION ALL SELECT text_id, concept_id, canonical_name, o, least(1.0, base * score / 100), words FROM asked JOIN sc USING (words) WHERE least(1.0, base * score / 100) >= 0.45
  UNION ALL SELECT text_id, concept_id, canonical_name, o, least(1.0, base + least(0.12::DOUBLE, length(term) / 80)), trim(substr(text, greatest(1, place - 80)::INT, (place + length(term) + 80 - greatest(1, place - 80))::INT)) FROM mn WHERE n <= 20),
bf AS (SELECT text_id, concept_id, canonical_name, o, round(confidence, 6) AS confidence, substr(evidence, 1, 240) AS evidence FROM fd),
one AS (SELECT text_id, concept_id, canonical_name, min((-confidence, o, evidence)) AS b FROM bf GROUP BY ALL),
ev AS (SELECT text_id, concept_id, canonical_name, b[2] AS o, b[3] AS evidence, CASE WHEN intent IN ('definition', 'formula', 'property', 'derivation', 'comparison', 'application') AND b[2] IN (1, 3, 4) THEN round(least(1.0, 0.05::DOUBLE - b[1]), 6) ELSE -b[1] END AS confidence FROM one JOIN txt USING (text_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY confidence DESC, length(evidence) DESC, canonical_name DESC, concept_id) AS rank FROM ev)"""
# a chunk is asked about; the chunk before it is the passage, the one after it the answer; long words of it are tags and names found before
AROUND_SQL = ", around AS (SELECT chunk_id, chunk_index, content, lag(content) OVER w AS before, lead(content) OVER w AS after, regexp_extract_all(content, '[A-Z]?[a-z]{11,}') AS longest FROM chunks WINDOW w AS (PARTITION BY book_id, chapter ORDER BY chunk_index))"


def _around(spark, sf_dir):
    w = Window.partitionBy("book_id", "chapter").orderBy("chunk_index")
    return study.chunks(spark, sf_dir).select("chunk_id", "chunk_index", "content", F.lag("content").over(w).alias("before"), F.lead("content").over(w).alias("after"), F.regexp_extract_all("content", F.lit("[A-Z]?[a-z]{11,}"), F.lit(0)).alias("longest"))


@query(WORDS_SQL + AROUND_SQL + ", txt AS (SELECT chunk_id AS text_id, content AS question, before AS chunk, after AS answer, CASE WHEN chunk_index % 2 = 0 THEN longest ELSE [] END AS matched, CASE WHEN chunk_index % 2 = 1 THEN longest ELSE [] END AS tags, CASE WHEN chunk_index % 3 = 0 THEN 'definition' ELSE 'qa' END AS intent FROM around)" + LINK_SQL
       + " SELECT text_id, concept_id, confidence, ['kg_matched', 'tag', 'question', 'question_mention', 'chunk_mention', 'answer_mention'][o] AS source, length(evidence) AS evidence_chars, rank FROM rk WHERE rank <= 8")
def kg14_link_concepts(spark, sf_dir):
    i, none = F.col("chunk_index"), F.array().cast("array<string>")
    t = _around(spark, sf_dir).select(
        F.col("chunk_id").alias("text_id"), F.col("content").alias("question"), F.col("before").alias("chunk"), F.col("after").alias("answer"), F.when(i % 2 == 0, F.col("longest")).otherwise(none).alias("matched"),
        F.when(i % 2 == 1, F.col("longest")).otherwise(none).alias("tags"), F.when(i % 3 == 0, "definition").otherwise("qa").alias("intent"))
    return op.link_concepts(tables.written(t, "texts"), tables.written(study.concepts(spark, sf_dir), "concepts")).select("text_id", "concept_id", "confidence", "source", F.length("evidence").alias("evidence_chars"), "rank")


@query(WORDS_SQL + " SELECT concept_id, chapter, n FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY n DESC, chapter) AS r FROM (SELECT concept_id, chapter, count(*) AS n FROM occurrences GROUP BY ALL)) WHERE r = 1")
def kg15_infer_chapter(spark, sf_dir):
    return op.infer_chapter(study.occurrences(spark, sf_dir))


@query(with_study("relations") + ", o AS (SELECT source_id AS node, list_sort(list_distinct(list(target_id))) AS p FROM relations GROUP BY 1), b AS (SELECT target_id AS node, list_sort(list_distinct(list(source_id))) AS e FROM relations GROUP BY 1) SELECT coalesce(o.node, b.node) AS node, array_to_string(p, ',') AS prerequisites, array_to_string(e, ',') AS extensions, array_to_string(list_sort(list_distinct(coalesce(p, []) || coalesce(e, []))), ',') AS related FROM o FULL JOIN b ON o.node = b.node")
def kg16_neighbours(spark, sf_dir):
    n = op.neighbours(study.relations(spark, sf_dir))
    return n.select("node", F.array_join(F.col("prerequisites").cast("array<string>"), ",").alias("prerequisites"), F.array_join(F.col("extensions").cast("array<string>"), ",").alias("extensions"), F.array_join(F.col("related").cast("array<string>"), ",").alias("related"))


@query(with_study("relations") + ", e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM relations), s AS (SELECT DISTINCT a AS node FROM e WHERE a % 20 = 0), d1 AS (SELECT DISTINCT node AS start, b AS node FROM s JOIN e ON a = node), d2 AS (SELECT DISTINCT start, b AS node FROM d1 JOIN e ON a = node), d3 AS (SELECT DISTINCT start, b AS node FROM d2 JOIN e ON a = node), al AS (SELECT node AS start, node, 0 AS depth FROM s UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2 UNION ALL SELECT *, 3 FROM d3) SELECT start, node, min(depth) AS depth FROM al GROUP BY ALL")
def kg17_learning_path(spark, sf_dir):
    """Starts are the stated query set, ids divisible by 20; the paths go over all relations."""
    r = study.relations(spark, sf_dir)
    return op.learning_path(r.where("source_id % 20 = 0").select(F.col("source_id").alias("node")).distinct(), r)


# a part needs the next part of its order and its supplier; suppliers and customers need their nation, a nation its region
NEEDS_SQL = with_study("relations", recursive=True) + """, needs AS (SELECT DISTINCT * FROM (SELECT 'part ' || source_id AS a, 'part ' || target_id AS b FROM relations UNION ALL SELECT 'part ' || l_partkey, 'supplier ' || l_suppkey FROM lineitem UNION ALL SELECT 'supplier ' || s_suppkey, 'nation ' || s_nationkey FROM supplier
  UNION ALL SELECT 'customer ' || c_custkey, 'nation ' || c_nationkey FROM customer UNION ALL SELECT 'nation ' || n_nationkey, 'region ' || n_regionkey FROM nation)),
nd AS (SELECT a AS node FROM needs UNION SELECT b FROM needs), rc AS (SELECT a, b FROM needs UNION SELECT r.a, n.b FROM rc r JOIN needs n ON n.a = r.b), sc AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM rc x JOIN rc y ON y.a = x.b AND y.b = x.a GROUP BY x.a),
comp AS (SELECT node, coalesce(component, node) AS component FROM nd LEFT JOIN sc USING (node)), up AS (SELECT DISTINCT p.component AS a, q.component AS b FROM needs JOIN comp p ON p.node = a JOIN comp q ON q.node = b WHERE p.component <> q.component),
ly AS (SELECT DISTINCT component, 0 AS d FROM comp UNION SELECT up.a, ly.d + 1 FROM ly JOIN up ON up.b = ly.component), lay AS (SELECT node, component, layer FROM comp JOIN (SELECT component, max(d) AS layer FROM ly GROUP BY 1) USING (component))"""


def _needs(spark, sf_dir):
    t = lambda n: study.table(spark, sf_dir, n)
    edge = lambda df, x, a, y, b: df.select(F.concat(F.lit(f"{x} "), a).alias("a"), F.concat(F.lit(f"{y} "), b).alias("b"))
    parts = edge(study.relations(spark, sf_dir), "part", "source_id", "part", "target_id").union(edge(t("lineitem"), "part", "l_partkey", "supplier", "l_suppkey"))
    people = edge(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey").union(edge(t("customer"), "customer", "c_custkey", "nation", "c_nationkey"))
    return parts.union(people).union(edge(t("nation"), "nation", "n_nationkey", "region", "n_regionkey"))


@query(NEEDS_SQL + " SELECT node, component, layer FROM lay")
def kg17_study_layers(spark, sf_dir):
    return order.study_layers(_needs(spark, sf_dir))


@query(NEEDS_SQL + ", st AS (SELECT node FROM nd WHERE split_part(node, ' ', 2)::BIGINT % 20 = 0), al AS (SELECT node AS start, node FROM st UNION SELECT a, b FROM rc WHERE a IN (FROM st)) SELECT start, node, layer, row_number() OVER (PARTITION BY start ORDER BY layer, component, node) AS place FROM al JOIN lay USING (node)")
def kg17_study_order(spark, sf_dir):
    """Starts are the stated query set, nodes whose number is divisible by 20; all that they need, however far, in order."""
    needs = tables.written(_needs(spark, sf_dir).distinct(), "needs")
    starts = needs.select(F.col("a").alias("node")).union(needs.select("b")).where(F.substring_index("node", " ", -1).cast("long") % 20 == 0)
    return order.study_order(starts, needs)


@query(WORDS_SQL + r""", e AS (SELECT DISTINCT chunk_id, latex FROM (SELECT chunk_id, unnest(regexp_extract_all(content, '([A-Za-z]+ ?= ?[^ ]+)', 1)) AS latex FROM chunks) WHERE length(trim(latex)) >= 3), fm AS (SELECT concept_id, string_agg(latex, ',' ORDER BY latex) AS formulas FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY latex) AS n FROM (SELECT DISTINCT concept_id, latex FROM e JOIN occurrences USING (chunk_id))) WHERE n <= 5 GROUP BY 1),
o AS (SELECT o.*, c.content, CASE WHEN role IN ('definition', 'theorem', 'property') THEN 'def' WHEN role IN ('example', 'exercise') THEN 'ex' ELSE 'other' END AS kind, list_position(['definition', 'theorem', 'property', 'derivation', 'proof', 'example', 'algorithm', 'exercise', 'reference'], role) AS o FROM occurrences o JOIN chunks c USING (chunk_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY concept_id, kind ORDER BY o, book_id, chapter, chunk_index) AS r FROM o)
SELECT concept_id, md5(min_by(substr(content, 1, 800), ((kind <> 'def')::INT, o, book_id, chapter, chunk_index))) AS definition, coalesce(string_agg(chunk_id, ',' ORDER BY r) FILTER (kind = 'def' AND r <= 3), '') AS definitions, coalesce(string_agg(chunk_id, ',' ORDER BY r) FILTER (kind = 'ex' AND r <= 3), '') AS examples, array_to_string(list_sort(list_distinct(list(chapter)))[1:8], ',') AS chapters, any_value(formulas) AS formulas FROM r LEFT JOIN fm USING (concept_id) GROUP BY concept_id""")
def kg18_concept_card(spark, sf_dir):
    c = tables.written(study.concepts(spark, sf_dir), "concepts")
    near = study.occurrences(spark, sf_dir, c, F.col("content").rlike(EQUATION))  # a chunk without a formula links none
    card = op.concept_card(c, study.occurrences(spark, sf_dir, c), study.chunks(spark, sf_dir), op.link_formulas(_formulas(spark, sf_dir), near))
    return card.select("concept_id", F.md5("definition").alias("definition"), *(F.array_join(c, ",").alias(c) for c in ("definitions", "examples", "chapters", "formulas")))


@query(WORDS_SQL + """, s AS (SELECT book_id, chapter, chunk_index, unnest(regexp_split_to_array(content, '[.,;]')) AS s, generate_subscripts(regexp_split_to_array(content, '[.,;]'), 1) AS pos FROM chunks), t AS (SELECT book_id, chapter, chunk_index, pos, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s FROM s)
SELECT concept_id, min_by(s, (book_id, chapter, chunk_index, pos)) AS definition FROM t JOIN concepts ON contains(s, canonical_name) WHERE length(s) > 10 AND length(s) < 300 AND regexp_matches(s, '(is|ist|est)') GROUP BY concept_id""")
def kg19_mine_definitions(spark, sf_dir):
    c, _, ch = _all(spark, sf_dir)
    return op.mine_definitions(c, ch, "(is|ist|est)", "[.,;]")


@query(WORDS_SQL + """, f AS (SELECT concept_id, min(book_id) AS book_id, min_by(chapter, (book_id, chapter)) AS chapter FROM occurrences GROUP BY concept_id), p AS (SELECT concept_id, coalesce(book_id, '未分类') AS book_id, coalesce(chapter, '未分类') AS chapter FROM concepts LEFT JOIN f USING (concept_id))
SELECT 'root' AS parent, book_id AS child, 1 AS level FROM p UNION SELECT book_id, book_id || '/' || chapter, 2 FROM p UNION SELECT book_id || '/' || chapter, concept_id, 3 FROM p""")
def kg20_concept_tree(spark, sf_dir):
    c, o, _ = _all(spark, sf_dir)
    first = o.groupBy("concept_id").agg(F.min("book_id").alias("book_id"), F.min_by("chapter", F.struct("book_id", "chapter")).alias("chapter"))
    return op.concept_tree(c, first)


@query(WORDS_SQL + AROUND_SQL + ", txt AS (SELECT chunk_id AS text_id, concat_ws(chr(10), nullif(content, ''), nullif(after, '')) AS question, NULL::VARCHAR AS chunk, before AS answer, []::VARCHAR[] AS matched, longest AS tags, 'mistake' AS intent FROM around)" + LINK_SQL
       + " SELECT text_id AS mistake_id, concept_id, greatest(confidence, 0.999::DOUBLE) AS confidence, true AS weak FROM rk WHERE rank <= 3")
def kg21_link_mistakes(spark, sf_dir):
    """A chunk as the mistaken question, the next one as its correct answer, the one before as explanation."""
    m = _around(spark, sf_dir).select(F.col("chunk_id").alias("text_id"), F.col("content").alias("question"), F.col("after").alias("correct_answer"), F.col("before").alias("explanation"), F.col("longest").alias("tags"))
    return op.link_mistakes(tables.written(m, "mistakes"), tables.written(study.concepts(spark, sf_dir), "concepts"))


# titles: some numbered in digits, some in Chinese numerals, some not; a few chapters have none or a meaningless one
_DIGIT = "substr('一二三四五六七八九', ({})::INT, 1)"
TITLES_SQL = f""", chs AS (SELECT source AS book_id, doc_id::VARCHAR AS chapter, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS pos FROM documents),
tt AS (SELECT *, CASE WHEN pos % 3 = 2 THEN 'plain ' || chapter ELSE '第' || CASE WHEN pos % 3 = 0 OR pos + 1 > 99 THEN (pos + 1)::VARCHAR WHEN pos + 1 < 10 THEN {_DIGIT.format('pos + 1')} ELSE CASE WHEN pos + 1 < 20 THEN '' ELSE {_DIGIT.format('(pos + 1) // 10')} END || '十' || CASE WHEN (pos + 1) % 10 = 0 THEN '' ELSE {_DIGIT.format('(pos + 1) % 10')} END END || '章 c' || chapter END AS title FROM chs)"""


def _titles(spark, sf_dir):
    d = study.table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").cast("string").alias("chapter"), (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("pos"))
    n, digit = F.col("pos") + 1, lambda x: F.substring(F.lit("一二三四五六七八九"), x.cast("int"), F.lit(1))
    tens = F.concat(F.when(n < 20, "").otherwise(digit(F.floor(n / 10))), F.lit("十"), F.when(n % 10 == 0, "").otherwise(digit(n % 10)))
    told = F.when((F.col("pos") % 3 == 0) | (n > 99), n.cast("string")).when(n < 10, digit(n)).otherwise(tens)
    return d.withColumn("title", F.when(F.col("pos") % 3 == 2, F.concat(F.lit("plain "), "chapter")).otherwise(F.concat(F.lit("第"), told, F.lit("章 c"), "chapter")))


@query(WORDS_SQL + TITLES_SQL + """, o AS (SELECT o.concept_id, (o.book_id, o.chapter, chunk_index, chunk_id) AS seen, CASE o.chapter::INT % 7 WHEN 0 THEN NULL WHEN 1 THEN '习题' ELSE title END AS chapter, '第' || page_idx || '节' AS section FROM occurrences o JOIN tt USING (chapter)),
k AS (SELECT concept_id, seen, 'chapter' AS kind, chapter AS title FROM o WHERE chapter <> '习题' UNION ALL SELECT concept_id, seen, 'section', section FROM o), g AS (SELECT concept_id, kind, title, count(*) AS n, min(seen) AS seen FROM k GROUP BY ALL)
SELECT concept_id, CASE WHEN kind = 'chapter' AND regexp_matches(title, '第[零〇一二两三四五六七八九十百千0-9]+章') THEN regexp_extract(title, '第[零〇一二两三四五六七八九十百千0-9]+章') ELSE left(title, 30) END AS chapter, kind AS "by" FROM g QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY kind, n DESC, seen) = 1""")
def kg15_chapter_titles(spark, sf_dir):
    """Titles of chapters where they have any, else of sections; of equally frequent ones the first seen."""
    c = F.col("chapter").cast("int") % 7
    o = study.occurrences(spark, sf_dir).withColumn("doc", F.col("chapter")).join(_titles(spark, sf_dir).select("chapter", "title"), "chapter")
    o = o.withColumn("section", F.concat(F.lit("第"), "page_idx", F.lit("节"))).withColumn("chapter", F.when(c == 0, None).when(c == 1, "习题").otherwise(F.col("title")))
    return tree.chapter_of_concept(o, ["book_id", "doc", "chunk_index", "chunk_id"])


@query(with_study("chunks", "concepts", "occurrences", "sections") + TITLES_SQL + """, f AS (SELECT concept_id, any_value(canonical_name) AS name, min((book_id, chapter)) AS b FROM occurrences GROUP BY concept_id),
cc AS (SELECT concept_id, tt.book_id, CASE length(name) % 3 WHEN 0 THEN title WHEN 1 THEN CASE WHEN regexp_matches(title, '^第.+章') THEN regexp_extract(title, '^第.+章') ELSE left(title, 30) END ELSE 'c' || tt.chapter END AS chapter, tt.pos FROM f JOIN tt ON tt.chapter = b[2]),
ch AS (SELECT book_id, pos, chapter AS doc, title, '第' || (pos + 1) || '章' AS key FROM tt), se AS (SELECT ch.book_id, key, key || '.' || (section_no + 1) AS skey FROM ch JOIN sections s ON s.chapter = doc), fs AS (SELECT book_id, key, min(skey) AS skey FROM se GROUP BY ALL),
tl AS (SELECT DISTINCT book_id, chapter FROM cc), own AS (SELECT tl.book_id, tl.chapter, ch.pos FROM tl JOIN ch ON ch.book_id = tl.book_id AND (ch.title = tl.chapter OR (starts_with(tl.chapter, '第') AND contains(ch.title, tl.chapter)))),
oth AS (SELECT tl.book_id, tl.chapter, ch.pos FROM tl JOIN ch ON ch.book_id = tl.book_id AND (contains(ch.title, tl.chapter) OR contains(tl.chapter, ch.title)) WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.book_id = tl.book_id AND own.chapter = tl.chapter)),
pl AS (SELECT book_id, chapter, min(pos) AS pos FROM (SELECT * FROM own UNION ALL SELECT * FROM oth) GROUP BY ALL), wh AS (SELECT concept_id, cc.book_id, skey FROM cc LEFT JOIN pl ON pl.book_id = cc.book_id AND pl.chapter = cc.chapter LEFT JOIN ch ON ch.book_id = pl.book_id AND ch.pos = pl.pos LEFT JOIN fs ON fs.book_id = ch.book_id AND fs.key = ch.key)
SELECT 'root' AS parent, book_id AS child, 1 AS level FROM ch UNION SELECT book_id, book_id || '/' || key, 2 FROM ch UNION SELECT book_id || '/' || key, book_id || '/' || skey, 3 FROM se UNION SELECT book_id, book_id || '/未分类', 2 FROM wh WHERE skey IS NULL
UNION SELECT book_id || '/' || coalesce(skey, '未分类'), book_id || '/' || coalesce(skey, '未分类') || '::' || concept_id, CASE WHEN skey IS NULL THEN 3 ELSE 4 END FROM wh""")
def kg20_section_tree(spark, sf_dir):
    """Chapters and sections by their numbers, concepts by whole, short and partial titles."""
    t = tables.written(_titles(spark, sf_dir), "titles")
    f = study.occurrences(spark, sf_dir).groupBy("concept_id").agg(F.length(F.max("canonical_name")).alias("n"), F.min(F.struct("book_id", "chapter"))["chapter"].alias("chapter"))
    n = F.col("n") % 3
    c = f.join(t, "chapter").select("concept_id", "book_id", F.when(n == 0, F.col("title")).when(n == 1, tree.short_title(F.col("title"))).otherwise(F.concat(F.lit("c"), "chapter")).alias("chapter"))
    s = study.sections(spark, sf_dir).join(t.select("chapter", F.col("pos").alias("chapter_pos")), "chapter")
    s = s.select("book_id", "chapter_pos", F.col("section_no").alias("pos"), F.concat(F.lit("第"), F.col("section_no") + 1, F.lit("节")).alias("title"))
    return tree.section_tree(c, t.select("book_id", "pos", "title"), s)


@query(WORDS_SQL + """, s AS (SELECT book_id, chapter, chunk_index, unnest(regexp_split_to_array(content, '[.,;]')) AS s, generate_subscripts(regexp_split_to_array(content, '[.,;]'), 1) AS pos FROM chunks), t AS (SELECT book_id, chapter, chunk_index, pos, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s FROM s),
m AS (SELECT concept_id, min_by(s, (book_id, chapter, chunk_index, pos)) AS definition FROM t JOIN concepts ON contains(s, canonical_name) WHERE length(s) > 10 AND length(s) < 300 AND regexp_matches(s, '(heit|keit)') GROUP BY concept_id),
c AS (SELECT concept_id, chapter FROM (SELECT concept_id, chapter, count(*) AS n FROM occurrences GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY n DESC, chapter) = 1)
SELECT concept_id, left(coalesce(definition, CASE WHEN chapter <> '' THEN '《' || chapter || '》中的核心概念' END, '（暂无摘要）'), 500) AS definition, definition IS NOT NULL AS mined FROM concepts LEFT JOIN m USING (concept_id) LEFT JOIN c USING (concept_id)""")
def kg19_definitions(spark, sf_dir):
    """Every concept's definition; a rare verb leaves many without a sentence, which get their chapter's."""
    c, ch = tables.written(study.concepts(spark, sf_dir), "concepts"), study.chunks(spark, sf_dir)
    o = study.occurrences(spark, sf_dir, c)
    return op.definitions(c, op.mine_definitions(c, ch, "(heit|keit)", "[.,;]"), op.infer_chapter(o))

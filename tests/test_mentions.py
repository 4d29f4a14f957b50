"""Names in texts by automata, against plain containment; and operators that rest on them."""

import random

from pyspark.sql import functions as F

from scholia.operators import exercises, graph, learning, mentions, retrieve
from scholia.streaming import reviews


def test_names_in_against_containment(spark, monkeypatch):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abé中") for _ in range(n))
    texts = [(i, word(r.randint(0, 40))) for i in range(60)] + [(60, None), (61, ""), (62, "b" * 500)]
    names = [(word(r.randint(1, 5)),) for _ in range(40)] + [("",), (None,), ("b",), ("b",)]
    t, n = spark.createDataFrame(texts, "i long, t string"), spark.createDataFrame(names, "n string")
    want = {(i, x) for i, s in texts for (x,) in names if s and x and x in s}
    for chars in (mentions.NAME_CHARS, 20):  # one pass, and many
        monkeypatch.setattr(mentions, "NAME_CHARS", chars)
        got = [(x.i, x.name) for x in mentions.names_in(t, "t", n, "n", ["i"]).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert mentions.names_in(t, "t", n.where("false"), "n", ["i", "t"]).count() == 0


def test_concept_names_may_hold_blanks_and_cjk(spark):
    c = spark.createDataFrame([("c1", "mean value", ["mean values"]), ("c2", "导数", []), ("c3", "absent", [])], "concept_id string, canonical_name string, aliases array<string>")
    t = spark.createDataFrame([("t1", "The Mean Values of a 导数 here"), ("t2", None)], "text_id string, text string")
    got = {(x.text_id, x.concept_id): x.term for x in graph.link_concepts(t, c).collect()}
    assert got == {("t1", "c1"): "mean values", ("t1", "c2"): "导数"}


def test_examples_reach_back_to_their_start(spark):
    texts = ["例 1 start", "a", "b", "c", "d the concept", "e", "目录 第1章 3\n第2章 5\n第3章 7", "x"]
    chunks = spark.createDataFrame([("b", "1", f"k{i}", i, 0, t) for i, t in enumerate(texts)], "book_id string, chapter string, chunk_id string, chunk_index int, page_idx int, content string")
    occ = spark.createDataFrame([("c", "b", "1", "k4", 4, "example")], "concept_id string, book_id string, chapter string, chunk_id string, chunk_index int, role string")
    one = spark.createDataFrame([("c",)], "concept_id string")
    got = sorted(r.chunk_index for r in retrieve.concept_chunks(one, occ, chunks).collect())
    assert got[0] == 0 and 4 in got and 7 in got
    assert 6 not in got  # a table of contents that is no hit


def test_ties_at_the_edge_are_ordered_by_id(spark):
    v = spark.createDataFrame([("b", "x" if i % 2 else "y", i, [1.0, 0.0], 0.0) for i in range(12)], "book_id string, chapter string, vec_id long, embedding array<float>, rag_priority double")
    q = spark.createDataFrame([(1, "b", [1.0, 0.0]), (2, "none", [0.0, 1.0])], "query_id long, book_id string, q array<float>")
    got = retrieve.vector_search_by_chapter(q, v.repartition(3), k=2).collect()
    assert {(r.query_id, r.chapter, r.vec_id) for r in got} == {(1, "x", 1), (1, "x", 3), (1, "y", 0), (1, "y", 2)}


def test_log_ignores_known_ids_however_late(spark, tmp_path):
    src, log, state = (str(tmp_path / x) for x in ("src", "log", "state"))
    for rows in ([(1, "a"), (2, "b"), (1, "a")], [(1, "late"), (3, "c")]):
        spark.createDataFrame(rows, "id long, v string").coalesce(1).write.mode("append").parquet(src)
        reviews.append_stream(spark.readStream.schema("id long, v string").parquet(src), log, state)
    assert sorted((r.id, r.v) for r in spark.read.parquet(log).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_conflicting_mistakes_are_told(spark):
    a = spark.createDataFrame([("b", 1, 7, 1, "new text"), ("b", 1, 8, 1, "same")], "book_id string, session_id long, exercise_id long, quality int, question_text string")
    new = exercises.exercise_to_mistake(a)
    known = new.withColumn("question_text", F.when(F.col("exercise_id") == 7, "old text").otherwise(F.col("question_text")))
    assert [(r.question_text, r.known_text) for r in exercises.mistake_conflicts(new, known).collect()] == [("new text", "old text")]


def test_state_lists_are_distinct_in_order(spark):
    rows = [(1, "k", i, i, 0.9, i == 3, f"s{i % 2}", f"ch{i % 3}", ["b", f"a{i}"]) for i in range(30)]
    e = spark.createDataFrame(rows, "user_id long, concept string, ts long, event_id long, confidence double, weak boolean, source string, chapter string, aliases array<string>")
    r = learning.concept_state(e).first()
    assert (r.sources, r.chapters, r.weak_reason) == (["s0", "s1"], ["ch0", "ch1", "ch2"], "s1")
    assert len(r.all_aliases) == 20 and r.all_aliases[:3] == ["a0", "b", "a1"]

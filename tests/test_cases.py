"""Small literal cases of single operators."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholia.functions import latex, questions, roles, text
from scholia.functions import review as fr
from scholia.operators import evaluate, exercises, graph, ingest, retrieve
from scholia.streaming.reviews import advance


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("content", "role"), [("定义：若A则称B", "definition"), ("例 1 求极限", "example"), ("", "reference"), ("a = b", "formula"), ("定理 证明：由此得证 proof", "theorem")])
def test_roles(spark, content, role):
    assert one(spark, roles.classify(F.col("t")), t=content) == role


def test_graph_role_wins(spark):
    c = spark.createDataFrame([("c1", "例 1"), ("c2", "例 1")], "chunk_id string, content string")
    g = spark.createDataFrame([("c1", "Lemma", 0), ("c2", "remark", 0)], "chunk_id string, role string, occ_order int")
    assert {r.chunk_id: r.role for r in ingest.assign_roles(c, g).collect()} == {"c1": "theorem", "c2": "example"}


def test_chunk_metrics(spark):
    s = spark.createDataFrame([(1, ["a", "b"], ["toc"], [12])], "query_id long, gold array<string>, forbidden array<string>, pages array<int>")
    h = spark.createDataFrame([(1, 1, "toc", 1), (1, 2, "a", 12), (1, 3, "b", 13)], "query_id long, rank int, chunk_id string, page_idx int")
    r = evaluate.chunk_metrics(s, h, (1, 2, 3)).first()
    assert (r.hit_1, r.recall_2, r.recall_3, r.mrr, r.forbidden, r.page_hit) == (0.0, 0.5, 1.0, 0.5, 1, True)


def test_point_recall(spark):
    c = spark.createDataFrame([(1, ["x", "y", "z"], True), (2, ["x"], True), (3, [], False)], "query_id long, points array<string>, answerable boolean")
    h = spark.createDataFrame([(1, 1, "x!"), (2, 1, "x")], "query_id long, rank int, text string")
    r = {x.query_id: x for x in evaluate.point_recall(c, h).collect()}
    assert (r[1].recall, round(r[1].point_recall, 3)) == (0.0, 0.333)
    assert (r[2].recall, r[2].reciprocal, r[3].recall) == (1.0, 1.0, 1.0)


def test_fusion_prefers_agreement(spark):
    cols = "query_id long, list_no int, position int, rank int, source string, chunk_id string, chapter string, page_idx int, role string, book_role string, is_direct_hit boolean, section_title string, text string"
    row = lambda i, s, k, r: (1, 2, i, r, s, k, "ch", 1, "", "", False, None, f"text of {k}")
    h = spark.createDataFrame([row(1, "dense", "x", 1), row(2, "dense", "gold", 4), row(3, "bm25", "gold", 1)], cols)
    q = spark.createDataFrame([(1, "q")], "query_id long, text string")
    assert retrieve.fuse_and_rerank(h, q).orderBy("rank").first().chunk_id == "gold"


def test_session_replay_is_a_no_op(spark):
    s = spark.createDataFrame([(1, [10, 20])], "session_id long, exercise_ids array<long>")
    a = spark.createDataFrame([(1, 10, 1, 5), (1, 10, 2, 1), (1, 20, 3, 1)], "session_id long, exercise_id long, seq long, quality int")
    r = exercises.session_progress(s, a).orderBy("seq").collect()
    assert [x.accepted for x in r] == [True, False, True]
    assert r[-1].completed and r[-1].current_index == 2


def test_import_marks_spaced_copies(spark):
    rec = spark.createDataFrame([(3, "b", "A  b", 3), (4, "b", "ab", 4), (5, "b", " ", 5), (6, "b", "", 6)], "exercise_id long, book_id string, question_text string, created_sec long")
    bank = spark.createDataFrame([(1, "b", "xy", 1)], rec.schema)
    assert {r.exercise_id: r.duplicate_of for r in exercises.import_batch(rec, bank).collect()} == {3: None, 4: 3, 5: None, 6: None}


def test_import_text_splits(spark):
    t = spark.createDataFrame([(1, "1. 求导数 A. x B. y C. z\n2. 简述线性规划的可行域")], "doc_id long, text string")
    r = exercises.analyse_candidates(exercises.score_split(exercises.split_questions(t))).orderBy("pos").collect()
    assert [(x.type, x.tags[0]) for x in r] == [(questions.CHOICE, "导数"), ("简答题", "线性规划")]


def test_answers_pair_by_number(spark):
    c = spark.createDataFrame([(1, i, f"{i}. q") for i in (1, 2, 3)], "doc_id long, pos int, block string")
    a = spark.createDataFrame([(1, 0, "1. a"), (1, 1, "2. b"), (1, 2, "2. c")], "doc_id long, pos int, text string")
    assert {r.number: (r.answer, r.missing) for r in exercises.attach_answers(c, a).collect()} == {1: ("1. a", False), 2: ("2. c", False), 3: (None, True)}


@pytest.mark.parametrize(("raw", "clean"), [("<think>a</think> b", "b"), ("b <THINK>a", "b"), ("b <thi", "b"), ("b <", "b"), ("a < b", "a < b"), ("x<think>1</think>y<think>2</think>z", "xyz")])
def test_thinking(spark, raw, clean):
    assert one(spark, text.strip_thinking(F.col("t")), t=raw) == clean


SPACED = r"$$\begin{aligned} a&=b\\[4pt] c&=d \end{aligned}$$"
KEPT = ["函数 $f(x) = x^2$ 在 $x=0$ 处取极小值。", r"$$\begin{bmatrix}1 & 2\\3 & 4\end{bmatrix}$$", r"`$x` ```$$``` \$5 a", r"\(x", "", r"\end{cases} $a$"]


@pytest.mark.parametrize(("raw", "out"), [
    (r"\(x\)", "$x$"), (r"\[x\]", "$$x$$"), (r"\\(x\\)", "$x$"), ("$x", "$x$"), ("$$x", "$$x$$"), ("$$ $$a $ $", "a "), ("＄x=1＄", "$x=1$"), (SPACED, SPACED.replace("[4pt]", "")),
    (r"$\nabla f(X) 是", r"$\nabla f(X)$ 是"), ("$$f = 0\n后续", "$$f = 0$$\n后续"), (r"s \begin{aligned}a\\b\end{aligned} d", "s $$\n\\begin{aligned}a\\\\b\\end{aligned}\n$$ d"), (None, None), *((x, x) for x in KEPT),
])
def test_latex(spark, raw, out):
    assert latex.sanitised(raw) == out
    assert latex.sanitised(out) == out


def test_latex_issues(spark):
    d = spark.createDataFrame([(1, "$$ $$ $a 中$ $b\n$$x\n\\begin{cases}1\\end{cases}"), (2, r"$x$ \$ $\text{中}$"), (3, None)], "i long, t string")
    got = {r.i: r.x for r in d.select("i", latex.latex_issues(F.col("t")).alias("x")).collect()}
    assert got == {1: ["bare_environment", "bare_words", "empty_display", "odd_display", "odd_inline"], 2: [], 3: []}
    assert one(spark, latex.sanitise_latex(F.col("t")), t=r"\(x\)") == "$x$"
    assert len(latex.parse(r"\(" * 20_000 + "$" * 3)) <= 4


def test_intents(spark):
    i = one(spark, text.intent(F.col("t")), t="什么是导数")
    assert (i.intent, i.is_simple, i.fast_path) == ("definition", True, True)
    assert one(spark, text.intent(F.col("t")), t="证明导数").intent == "derivation"


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="Hello 单纯形 b1") == ["hello", "单纯形", "单纯", "纯形", "b1"]
    assert one(spark, text.tokens(F.col("t"), "cjk"), t="a b") == ["ab"]


def test_cluster_and_names(spark):
    c = spark.createDataFrame([("b", "线性规划", 1), ("b", "线性规划法", 2), ("b", "积分", 3)], "book_id string, name string, pos long")
    r = {x.name: x.canonical for x in graph.cluster_concepts(c).collect()}
    assert r == {"线性规划": "线性规划法", "线性规划法": "线性规划法", "积分": "积分"}


def test_path_with_cycle(spark):
    e = spark.createDataFrame([(1, "depends_on", 2), (2, "depends_on", 1), (2, "depends_on", 3)], "source_id long, relation string, target_id long")
    s = spark.createDataFrame([(1,)], "node long")
    assert sorted((r.node, r.depth) for r in graph.learning_path(s, e, 5).collect()) == [(1, 0), (2, 1), (3, 2)]


def test_sections_and_chunks(spark):
    d = spark.createDataFrame([("k", "book", "intro\n## one\nbody\n### two\nmore")], "key string, title string, text string")
    r = ingest.split_sections(d).orderBy("part").collect()
    assert [(x.section_path, x.body) for x in r] == [(["book"], "intro"), (["book", "one"], "body"), (["book", "one", "two"], "more")]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab。 \n", max_size=200), st.integers(5, 40))
def test_split_text_bounds(body, size):
    parts = ingest.split_text(body, size, 3)
    assert all(0 < len(p) <= size for p in parts)
    assert sum(len(p.replace("\n", "").replace(" ", "")) for p in parts) >= len(body.replace("\n", "").replace(" ", "")) - 0


def test_pack_text(spark):
    d = spark.createDataFrame([("k", i, "x" * n) for i, n in enumerate((10, 10, 30, 5))], "key string, pos int, text string")
    assert [len(r.text) for r in ingest.pack_text(d, 25).orderBy("batch").collect()] == [21, 30, 5]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-1, 6), max_size=12))
def test_sm2_fold_matches_stepwise(spark, qs):
    s = (2.5, 1, 0)
    for q in qs:
        s = advance(s, q)
    arr = F.array(*(F.struct(F.lit(q).alias("quality")) for q in qs)) if qs else F.array().cast("array<struct<quality:int>>")
    r = spark.range(1).select(fr.sm2_fold(arr).alias("s")).first().s
    assert (round(r.easiness, 9), r.interval, r.repetitions) == (round(s[0], 9), s[1], s[2])


def concept_table(spark):
    return spark.createDataFrame([("c1", "limit", ["limit", "limits"]), ("c2", "integral", ["integral"]), ("c3", "matrix", ["matrix", "array"])], "concept_id string, canonical_name string, aliases array<string>")


def test_link_concepts_by_source(spark):
    t = spark.createDataFrame(
        [(1, "the limits hold", "an Integral", "a matrix", [], [], "qa"), (2, "no name", None, None, ["Array", "", None], ["integral"], "definition"), (3, "limit", None, "", None, None, "formula"), (4, None, None, None, None, None, None)],
        "text_id long, question string, chunk string, answer string, matched array<string>, tags array<string>, intent string")
    r = {(x.text_id, x.concept_id): (x.source, round(x.confidence, 4)) for x in graph.link_concepts(t, concept_table(spark)).collect()}
    assert r == {
        (1, "c1"): ("question_mention", 0.855), (1, "c2"): ("chunk_mention", 0.78), (1, "c3"): ("answer_mention", 0.655),
        (2, "c3"): ("kg_matched", 1.0), (2, "c2"): ("tag", 0.86), (3, "c1"): ("question", 0.95),
    }


def test_link_mistakes_asks_question_and_answer(spark):
    m = spark.createDataFrame([(1, "what", "the limit", "by the matrix", ["integral"])], "text_id long, question string, correct_answer string, explanation string, tags array<string>")
    r = graph.link_mistakes(m, concept_table(spark)).collect()
    assert {(x.concept_id, x.confidence, x.weak) for x in r} == {("c1", 0.999, True), ("c2", 0.999, True), ("c3", 0.999, True)}
    assert graph.link_mistakes(m.limit(0), concept_table(spark)).count() == 0


BOOK = "book_id string, chapter string, chunk_index int, chunk_id string, page_idx int, role string, content string, title string, provider int"


def test_textbook_exercises(spark):
    rows = [
        ("b", "一", 0, "c0", 0, "text", "例 1 求", "正文", 1), ("b", "一", 1, "c1", 1, "Example", "text", "正文", 1), ("b", "二", 2, "c2", 2, "text", "12、 算", "正文", 1), ("b", "二", 3, "c3", -1, None, "all of it", "习 题", 1),
        ("b", "", 4, "c4", 4, "exercise", "(3) x", "目录", 1), ("b", "二", 5, "c5", 5, "exercise", "12、 算", "正文", 1), ("b", "二", 6, "c6", 6, "exercise", "1. other", "正文", 2), (None, None, 0, "n0", 0, None, "例题", None, 2),
    ]
    c = spark.createDataFrame(rows, BOOK)
    ids = lambda *a: {x.chunk_id for x in exercises.extract_textbook_exercises(c, *a).collect()}
    assert ids("examples") == {"c0", "c1", "n0"}
    assert ids("exercise_sections") == {"c0", "c1", "c2", "c3", "n0"}
    assert ids("other") == {"c0", "c2", "n0"}
    assert ids("all_pages") == {"c0", "c1", "c2", "c3", "c4", "n0"}
    assert ids("all_pages", 2, 3) == {"c1", "c2"}
    assert ids("all_pages", None, None, " 二") == {"c2", "c3", "c4", "n0"}
    assert exercises.extract_textbook_exercises(c.limit(0), "other").count() == 0


def test_sections_end_and_class(spark):
    s = spark.createDataFrame([("b", "1", 0, 1, "1.1"), ("b", "1", 1, 3, "习题"), ("b", "1", 2, 3, "本章要点"), (None, "1", 0, 2, None)], "book_id string, chapter string, section_no int, start_page int, title string")
    c = spark.createDataFrame([("b", "1", 9), (None, "1", 4)], "book_id string, chapter string, last_page int")
    d = ingest.section_ends(s, c)
    assert {(x.book_id, x.section_no): x.end_page for x in d.collect()} == {("b", 0): 2, ("b", 1): 3, ("b", 2): 9, (None, 0): 4}
    k = {(x.book_id, x.section_no): (x.c.kind, x.c.is_auxiliary) for x in s.select("book_id", "section_no", ingest.section_class(F.col("title")).alias("c")).collect()}
    assert k == {("b", 0): ("content", False), ("b", 1): ("exercise", True), ("b", 2): ("study_points", False), (None, 0): ("content", False)}


def test_section_examples_are_cut(spark):
    s = spark.createDataFrame([("b", "1", 0, 0, 9)], "book_id string, chapter string, section_no int, start_page int, end_page int")
    c = spark.createDataFrame([("b", "1", i, f"c{i}", 0, "example", "x" * 30) for i in range(50)], "book_id string, chapter string, chunk_index int, chunk_id string, page_idx int, role string, content string")
    r = ingest.section_examples(c, s, 100).first()
    whole = "\n\n".join(f"[c{i}; example]\n" + "x" * 30 for i in range(50))
    assert (r.text, r.cut) == (whole[:100], True)
    short = ingest.section_examples(c.limit(1), s, 100).first()
    assert (short.text, short.cut) == ("[c0; example]\n" + "x" * 30, False)


def test_conversation_index_keeps_the_last(spark):
    from scholia.operators import learning

    rows = [(1, i, "user", f"question {i}", "math" if i == 3 else " ", None, i) for i in range(50)] + [(2, 0, "assistant", "hello", None, "b", 7), (3, 0, "user", "  ", "art", "b", None)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, subject string, book_name string, created_at long")
    r = {x.conv_id: x for x in learning.conversation_index(t).collect()}
    assert (r[1].title, r[1].messages, r[1].kept, r[1].subject, r[1].created_at, r[1].updated_at) == ("question 10", 50, 40, "", 10, 49)
    assert (r[2].title, r[2].book_name, r[3].title, r[3].updated_at) == ("新会话", "b", "新会话", None)
    assert [x.conv_id for x in learning.conversation_index(t, book="b", limit=5).collect()] == [2, 3]

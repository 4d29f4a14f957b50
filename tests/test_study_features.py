"""Titles and numerals, trees, heading scopes, packing, damage reports, related mistakes: literal cases and plain re-statements."""

import random

import pytest
from pyspark.sql import functions as F

from scholia.functions import numerals
from scholia.functions import text as ft
from scholia.operators import graph, ingest, learning, review, tree
from scholia.sources import tables


def chinese(n):
    d = "零一二三四五六七八九"
    out, zero = "", False
    for unit, v in (("百", 100), ("十", 10), ("", 1)):
        x = n // v % 10
        if x:
            out += ("零" if zero and out else "") + d[x] + unit
            zero = False
        else:
            zero = True
    return out


def test_numerals_to_999(spark):
    rows = [(chinese(n), n) for n in range(1, 1000)] + [("十", 10), ("十二", 12), ("百零三", 103), ("两百", 200), ("二〇五", 205), ("一二", 12), ("12", 12), ("007", 7), ("三千零四", 3004), ("", None), ("十百", None), ("x", None), ("12345", None), (None, None)]
    got = spark.createDataFrame(rows, "s string, n int").select("s", "n", numerals.number(F.col("s")).alias("v")).collect()
    assert [(r.s, r.v) for r in got] == rows
    t = spark.createDataFrame([("第十二章 极限",), ("第3章",), ("附第3章",), ("第章",), (None,)], "t string").select(numerals.titled_number(F.col("t"), "章").alias("n"))
    assert [r.n for r in t.collect()] == [12, 3, None, None, None]


def test_chapter_of_concept_ties_and_fallback(spark):
    rows = [("a", 2, "第二章 导数", "s"), ("a", 1, "第一章 极限", "s"), ("a", 3, "习题", "s"), ("b", 1, None, "x" * 40), ("b", 2, "", "习题"), ("c", 1, "附录", None), ("d", 5, "plain", None), ("d", 6, "plain", None), ("d", 1, "other", "z")]
    got = {r.concept_id: (r.chapter, r.by) for r in tree.chapter_of_concept(spark.createDataFrame(rows, "concept_id string, o int, chapter string, section string"), ["o"]).collect()}
    assert got == {"a": ("第一章", "chapter"), "b": ("x" * 30, "section"), "d": ("plain", "chapter")}


def test_section_tree(spark):
    chapters = spark.createDataFrame([("b", 0, "第一章 极限"), ("b", 1, "Plain"), ("b", 2, "第十二章 导数"), ("b", 3, "第十二章 again"), ("e", 0, "No sections")], "book_id string, pos int, title string")
    sections = spark.createDataFrame([("b", 0, 0, "第二节 x"), ("b", 0, 1, "free"), ("b", 0, 2, "第十节"), ("b", 3, 0, "第一节")], "book_id string, chapter_pos int, pos int, title string")
    concepts = spark.createDataFrame([("c1", "b", "第一章 极限"), ("c2", "b", "第12章"), ("c3", "b", "第十二章"), ("c4", "b", "极"), ("c5", "b", "none"), ("c6", "b", None), ("c7", "e", "No sections"), ("c8", "f", "x")], "concept_id string, book_id string, chapter string")
    got = {tuple(r) for r in tree.section_tree(concepts, chapters, sections).collect()}
    assert {(p, c) for p, c, n in got if n == 2} == {("b", "b/第1章"), ("b", "b/第2章"), ("b", "b/第12章"), ("b", "b/未分类"), ("e", "e/第1章"), ("e", "e/未分类"), ("f", "f/未分类")}
    assert {(p, c) for p, c, n in got if n == 3 and "::" not in c} == {("b/第1章", "b/第1章.2"), ("b/第1章", "b/第1章.10"), ("b/第12章", "b/第12章.1")}  # of two second sections the last stays
    under = {c.split("::")[1]: p for p, c, n in got if "::" in c}
    # 第12章 meets no title by number and words; keys are compared as texts
    assert under == {"c1": "b/第1章.10", "c2": "b/未分类", "c3": "b/第12章.1", "c4": "b/第1章.10", "c5": "b/未分类", "c6": "b/未分类", "c7": "e/未分类", "c8": "f/未分类"}


def folded(parts, most):
    out, cur = [], ""
    for t in parts:
        if cur == "":
            cur = t
        elif len(cur) + len(t) + 1 <= most:
            cur += "\n" + t
        else:
            out.append(cur)
            cur = t
    return out + ([cur] if cur else [])


@pytest.mark.parametrize("most", [1, 7, 40])
def test_packing_equals_the_fold(spark, most):
    r = random.Random(most)
    keys = {k: ["x" * r.choice([0, 0, 1, 2, 3, 5, 9, 60]) for _ in range(r.choice([0, 1, 2, 17, 60]))] for k in range(30)}
    rows = [(k, i, t) for k, ts in keys.items() for i, t in enumerate(ts)] + [(99, 0, None)]
    got = {}
    for x in sorted(ingest.pack_text(spark.createDataFrame(rows, "key int, pos int, text string"), most).collect(), key=lambda x: (x.key, x.batch)):
        got.setdefault(x.key, []).append(x.text)
    assert got == {k: f for k, ts in keys.items() if (f := folded(ts, most))}


def visible(text):
    import re

    kept, skip = [], None
    for line in re.split(r"\r\n|[\n\r]", text):
        line = line.rstrip()
        m = re.match(r"^(#{1,6})\s+(.+?)\s*$", line)
        level = len(m[1]) if m else 0
        if skip is not None and not (m and level <= skip):
            continue
        skip = None
        if m and any(x in re.sub(r"[\s*$`]", "", m[2]) for x in ingest.UNWANTED):
            skip = level
        elif not m or level > 2:
            kept.append(line)
    return "\n".join(kept)


def test_heading_scopes(spark):
    r = random.Random(5)
    line = lambda: r.choice(["text", "", "more  ", "# Title", "## Two", "### Three", "#### Four", "## 本章重点", "### **整体 总结** x", "# $本章学习要点$", "#none", "##### `学习要点参考`"])
    texts = ["\n".join(line() for _ in range(r.randrange(0, 25))) for _ in range(60)] + ["## 本章重点\ngone\n### also\ngone\n## Next\nstays", "", "a\r\nb"]
    got = ingest.without_unwanted(spark.createDataFrame([*enumerate(texts), (999, None)], "k int, text string"), "k")
    assert {x.k: x.text for x in got.collect()} == {**{i: visible(t) for i, t in enumerate(texts)}, 999: ""}
    n = spark.createDataFrame([(["s"], 1, "## 本章总结\nlost\n## x\nkept"), (["s"], 2, "next")], "section_ids array<string>, batch int, text string")
    assert ingest.assemble_notes(n, spark.createDataFrame([("s",), ("t",)], "section_id string")).orderBy("section_id").collect()[0].text == "kept\n\nnext"


def test_damaged_lines_and_marks(spark):
    t = "﻿ok\nÃ© one\r\nfine\x85???? two\n" + "\n".join(f"�{i}" for i in range(9)) + "\n" + "锛" * 300
    r = spark.createDataFrame([(t,), ("clean",), (None,)], "t string").select(ft.has_mark(F.col("t")).alias("bom"), ft.damaged_lines(F.col("t")).alias("x"), ft.damaged_lines(F.lit("锛" * 300)).alias("y")).collect()
    assert [x.bom for x in r] == [True, False, False]
    assert [(x.line, x.text) for x in r[0].x] == [(2, "Ã© one"), (4, "???? two"), (5, "�0"), (6, "�1"), (7, "�2"), (8, "�3")]
    assert r[1].x == [] and r[2].x is None and len(r[0].y[0].text) == 220


def test_mistakes_naming(spark):
    m = spark.createDataFrame([(1, "about limits", None), (1, "about limits", "x"), (1, None, "the limit"), (2, "limit", None)] + [(3, f"q{i} limit", None) for i in range(60)], "user_id int, q string, e string")
    names = spark.createDataFrame([(1, "limit"), (1, "limits"), (1, ""), (2, "limits"), (3, "limit"), (4, "limit")], "user_id int, concept string")
    assert {tuple(r) for r in learning.mistakes_naming(names, m, ["q", "e"]).collect()} == {(1, "limit", 3), (1, "limits", 2), (3, "limit", 50)}


def test_mistake_stats(spark):
    rows = [("u", "2024-01-31", ["a", " "], ["t"], ["t", "c"], 3), ("u", "2024-02-01", None, [], None, None), ("u", None, ["a"], ["t"], [], 3)]
    d = spark.createDataFrame(rows, "user_id string, next_review string, mistake_types array<string>, tags array<string>, linked array<string>, difficulty int").withColumn("next_review", F.to_date("next_review"))
    got = {(r.kind, r.value): r.n for r in review.mistake_stats(d, "2024-01-31", ["user_id"]).collect()}
    assert got == {("all", "all"): 3, ("due", "due"): 1, ("cause", "a"): 2, ("tag", "t"): 3, ("tag", "c"): 1, ("difficulty", "3"): 2, ("difficulty", None): 1}


def test_definitions_fall_back(spark):
    c = spark.createDataFrame([("a",), ("b",), ("c",)], "concept_id string")
    mined = spark.createDataFrame([("a", "x" * 600)], "concept_id string, definition string")
    chapters = spark.createDataFrame([("a", "第一章"), ("b", "第二章"), ("c", "")], "concept_id string, chapter string")
    got = {r.concept_id: (r.definition, r.mined) for r in graph.definitions(c, mined, chapters).collect()}
    assert got == {"a": ("x" * 500, True), "b": ("《第二章》中的核心概念", False), "c": ("（暂无摘要）", False)}


def test_scratch_is_cleared(spark):
    df = tables.written(spark.range(5), "cleared")
    path = next(p for _, p in tables._made if "/cleared-" in p)
    assert df.count() == 5 and tables.exists(spark, path)
    assert tables.clear_scratch(spark) >= 1
    assert not tables.exists(spark, path) and tables.clear_scratch(spark) == 0

"""What the review of round 3 found."""

import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholia import plans
from scholia.operators import graph, ingest, mentions, similar
from scholia.sources import study, tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_names_are_not_broadcast(spark, monkeypatch):
    plans = []

    def kept(df, name):
        if name == "similar":
            plans.append(plan_of(df))
        return tables.written(df, name)

    monkeypatch.setattr(similar, "written", kept)
    names = spark.createDataFrame([("derivativ",), ("integrals",)], "name string")
    aliases = spark.createDataFrame([("derivative", "c1"), ("integral", "c2")], "alias string, concept_id string")
    assert {(r.name, r.concept_id) for r in similar.similar_names(names, aliases).collect()} == {("derivativ", "c1"), ("integrals", "c2")}
    assert plans and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)


FILES = {"a.md": "one\r\ntwo\rthree\n\nfour", "b.md": "x\n", "c.md": "x\r", "d.md": "\r\n", "e.md": "é\r\r\ny\r\n", "f.md": "no end", "g.md": "".join(f"line {i}\n" for i in range(5000)) + "end"}


@pytest.mark.parametrize("most", ["128m", "1000"])
def test_markdown_is_read_in_splits(spark, tmp_path, most):
    for n, t in FILES.items():
        (tmp_path / n).write_bytes(t.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    try:
        d = tables.read_markdown(spark, str(tmp_path))
        got = sorted((r.file.rsplit("/")[-1], r.pos, r.text) for r in d.collect())
        assert "wholetext" not in d._jdf.queryExecution().logical().toString().lower() and spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= (40 if most == "1000" else 1)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((n, i, x) for n, t in FILES.items() for i, x in enumerate(re.sub("\r\n?", "\n", t).split("\n")))


def test_a_large_markdown_file_is_no_single_row(spark, tmp_path, monkeypatch):
    (tmp_path / "a.md").write_text("some line of text\n" * 200_000)
    sizes = []
    monkeypatch.setattr(tables, "written", lambda df, name, w=tables.written: (sizes.append(df.agg(F.max(F.length("text"))).first()[0]), w(df, name))[1])
    assert tables.read_markdown(spark, str(tmp_path)).count() == 200_001 and sizes == [17]


def test_chunks_of_one_place_are_ordered(spark):
    chunks = [("b", "1", "1_0", 0, 0, "example", "z" * 6000), ("b", "1", "1_0", 0, 0, "example", "a"), ("b", "1", "1_1", 1, 0, "example", "later")]
    c = spark.createDataFrame(chunks, "book_id string, chapter string, chunk_id string, chunk_index int, page_idx int, role string, content string").coalesce(1)
    s = spark.createDataFrame([("b", "1", 0, 0, 1)], "book_id string, chapter string, section_no int, start_page int, end_page int")
    r = ingest.section_examples(c, s).first()
    assert r.text == ("[1_0; example]\na\n\n[1_0; example]\n" + "z" * 6000)[:5000] and r.cut


def test_words_after_words_need_no_order(spark, sf_dir):
    for q in ("kg6_resolve_relations", "kg9_graph_from_candidates"):
        assert "Window" not in plan_of(plans.QUERIES[q](spark, sf_dir))


def test_texts_are_not_ranked_with_their_words(spark, sf_dir):
    p = plans.QUERIES["kg8_evidence_graph"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    ranked = re.findall(r"Window \[.*\n(?:.*WindowGroupLimit.*\n)?.*?Project \[(.*)\]", p)
    assert ranked and not any(re.search(r"(^|, )content#\d+(,|$)", x) for x in ranked)


def test_definitions_are_kept_by_name(spark, sf_dir):
    p = plan_of(plans.QUERIES["kg9_merge_candidates"](spark, sf_dir))
    keys = re.findall(r"SortAggregate\(key=\[(.*?)\], functions=\[[^\]]*min_by", p)
    assert keys and all("," not in k for k in keys)


def test_only_the_best_places_get_texts(spark, sf_dir):
    assert "WindowGroupLimit" in plan_of(plans.QUERIES["kg18_concept_card"](spark, sf_dir))


def test_cards_of_a_repeated_chunk(spark):
    o = spark.createDataFrame([("c", "b", "1", "k1", 0, "definition"), ("c", "b", "1", "k2", 1, "definition"), ("c", "b", "2", "k3", 0, "theorem"), ("c", "b", "2", "k4", 1, "example")], "concept_id string, book_id string, chapter string, chunk_id string, chunk_index int, role string")
    chunks = spark.createDataFrame([("k1", "same"), ("k1", "same"), ("k2", "two"), ("k3", "three"), ("k4", "four")], "chunk_id string, content string")
    r = graph.concept_card(spark.createDataFrame([("c", "name")], "concept_id string, canonical_name string"), o, chunks).first()
    assert (r.definition, r.definitions, r.examples, r.chapters) == ("same", ["k1", "k1", "k2"], ["k4"], ["1", "2"])


def test_repeated_ids_of_documents(spark, tmp_path):
    words = [(i, f"shared wordings {i} shared\nshared other", "s1") for i in range(12)]
    rows = [*words, (3, "shared again\nshared other", "s1"), (3, "shared", "s2"), (None, "shared other", "s1"), (5, None, "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    sql = "concept_id, canonical_name, book_id, chapter, chunk_index, page_idx, role FROM occurrences WHERE chapter IS NOT NULL"
    want = c.execute(study.with_study("occurrences") + " SELECT " + sql).fetchall()
    got = study.occurrences(spark, str(tmp_path)).where("chapter is not null").select("concept_id", "canonical_name", "book_id", "chapter", "chunk_index", "page_idx", "role")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "again" in plan_of(got)


def test_searches_go_by_number_not_by_text(spark, monkeypatch):
    seen = []

    def kept(queries, concepts, f=graph.concept_search):
        seen.append(dict(queries.dtypes)["query_id"])
        return f(queries, concepts)

    monkeypatch.setattr(graph, "concept_search", kept)
    texts = spark.createDataFrame([("t1", "what is a limit", ["limits"]), ("t2", "what is a limit", ["lim"])], "text_id string, question string, tags array<string>")
    concepts = spark.createDataFrame([("c1", "limit", ["limit", "limits"])], "concept_id string, canonical_name string, aliases array<string>")
    got = {r.text_id: (r.concept_id, r.source, r.evidence) for r in graph.link_concepts(texts, concepts).collect()}
    assert seen == ["bigint", "bigint"]
    assert got == {"t1": ("c1", "question_mention", "what is a limit"), "t2": ("c1", "question_mention", "what is a limit")}


def test_findings_of_few_rows_are_held():
    class Sent:
        value = ["a", "b", "ab"]

    batch = pa.RecordBatch.from_pydict({"k": list(range(1200)), "t": ["ab"] * 1200})
    out = list(mentions._found(Sent, "t", ["k"])(iter([batch])))
    assert len(out) == 3 and max(b.num_rows for b in out) == 1500 and sum(b.num_rows for b in out) == 3600


def test_pieces_are_given_in_lots():
    import pandas as pd

    sections = pd.DataFrame({"key": ["1", "2"], "part": [0, 0], "section_path": [["t"], ["t"]], "body": ["word " * 350_000, "short"]})
    out = list(ingest._split_batches(700, 80)(iter([sections])))
    assert len(out) > 1 and max(map(len, out)) <= ingest.PIECES
    d = pd.concat(out)
    assert list(d[d.key == "1"].content) == ingest.split_text(sections.body[0], 700, 80) and list(d.idx[d.key == "1"]) == list(range(len(d) - 1))

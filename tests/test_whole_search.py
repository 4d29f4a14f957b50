"""Searches go over all books, whatever their names."""

from scholia.operators import retrieve

CHUNKS = "book_id string, chapter string, chunk_id string, chunk_index int, content string"


def chunks(spark):
    texts = [("src1", "alpha beta gamma"), ("another book", "alpha beta gamma delta"), (None, "alpha beta"), ("src1", "nothing here"), ("another book", "alpha " * 3), (None, "one two")]
    return spark.createDataFrame([(b, str(i), f"{i}_0", 0, t) for i, (b, t) in enumerate(texts)], CHUNKS)


def test_every_book_is_searched(spark):
    q = spark.createDataFrame([(1, "alpha beta"), (2, "two"), (3, "absent")], "query_id long, text string")
    r = retrieve.bm25_search_all(q, chunks(spark)).collect()
    assert {x.chunk_id for x in r if x.query_id == 1} == {"0_0", "1_0", "2_0", "4_0"}
    assert [x.chunk_id for x in r if x.query_id == 2] == ["5_0"] and not [x for x in r if x.query_id == 3]
    assert sorted(x.rank for x in r if x.query_id == 1) == [1, 2, 3, 4]
    few = retrieve.bm25_search_all(q, chunks(spark), 2).collect()
    assert {(x.query_id, x.chunk_id, x.score) for x in few} == {(x.query_id, x.chunk_id, x.score) for x in r if x.rank <= 2}


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    q = spark.createDataFrame([(i, "alpha beta two"[: 5 + 3 * i]) for i in range(4)], "query_id long, text string")
    want = sorted(map(tuple, retrieve.bm25_search_all(q, chunks(spark)).collect()), key=str)
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 1)
    monkeypatch.setattr(retrieve, "WEIGHTS", 2)
    monkeypatch.setattr(retrieve, "SCORES", 1)
    assert sorted(map(tuple, retrieve.bm25_search_all(q, chunks(spark)).collect()), key=str) == want


def test_gold_is_the_whole_passage_of_any_book(spark):
    q = spark.createDataFrame([(1, "alpha beta gamma delta")], "query_id long, text string")
    assert [tuple(x) for x in retrieve.gold_chunks(q, chunks(spark)).collect()] == [(1, "1_0")]

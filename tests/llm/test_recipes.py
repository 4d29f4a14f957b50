"""op7: a document's recipe comes from the task that cuts it and isn't put together by a shuffle."""

from scholia.llm import token_store


def test_recipes_are_told_once(spark, tmp_path, monkeypatch):
    kept = {}
    monkeypatch.setattr(token_store, "staged", lambda df, name, codec="zstd", s=token_store.staged: kept.setdefault(name, s(df, name, codec)))
    text = " ".join(f"word{i % 977} {i * i % 1009}" for i in range(6000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "short"), (4, None)], "doc_id long, text string").coalesce(1)
    token_store.write_store(docs, str(tmp_path / "store"))
    rows = kept["chunked"].collect()
    assert sorted(r.doc_id for r in rows if r.chunks) == [1, 2, 3, 4]
    assert all(r.payload or r.chunks for r in rows) and sum(r.payload is not None for r in rows) == len({r.digest for r in rows if r.payload})
    of = {r.doc_id: r.chunks for r in rows if r.chunks}
    assert of[1] == of[2] and len(of[1]) > 1 and [c.seq for c in of[1]] == list(range(len(of[1])))

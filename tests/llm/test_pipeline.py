"""The pipeline's stages, each on what its predecessor kept."""

import zlib
from collections import Counter

import corpus_pipeline
from scholia.llm import packing
from scholia.llm.common import connected_components

from .test_operators import DOCS, corpus


def extra(spark):
    rows = [(*r, i, "c") for i, r in enumerate(corpus())]
    return spark.createDataFrame(rows, DOCS + ", n_words int, row_key string")


def test_stages_keep_columns(spark):
    docs = extra(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert docs.count() > 0


CLASHING = "size place mix_place mix_source mix_full mix_below full below _s copies nth target source_size rules rule_counts kept base_failed host host_ok judged_host _host _host_ok n_words base_spans spans row_key row _row _key _id key fp component m found".split()


def test_stages_with_every_internal_name(spark):
    """Columns named like the stages' own ones pass through unchanged."""
    rows = [(*r, *(f"{c}-{i}" for c in CLASHING)) for i, r in enumerate(corpus())]
    docs = spark.createDataFrame(rows, DOCS + ", " + ", ".join(f"`{c}` string" for c in CLASHING))
    known = {tuple(r[-len(CLASHING) :]) for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert {tuple(r[-len(CLASHING) :]) for r in out.collect()} <= known, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_decisions_take_effect(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = extra(spark)
    kept = stages["quality_rules"](spark, docs, "")
    assert all(len((r.text or "").split()) >= 40 for r in kept.collect())
    one = stages["simhash"](spark, docs, "").collect()
    assert Counter(r.doc_id for r in one if r.doc_id is not None).most_common(1)[0][1] == 1
    assert 12 not in {r.doc_id for r in one} and 0 in {r.doc_id for r in one}
    clean = {r.doc_id: r for r in stages["secret_scan"](spark, docs, "").collect()}
    secret = next(r for r in docs.collect() if "AKIA" in (r.text or ""))
    assert "AKIA" not in clean[secret.doc_id].text and clean[secret.doc_id].n_chars == len(clean[secret.doc_id].text)
    assert clean[0].text == next(r.text for r in docs.collect() if r.doc_id == 0)


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_run(spark, sf_dir):
    r = corpus_pipeline.run(spark, sf_dir)
    assert r.count() > 0 and r.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096
    assert r.groupBy("row_key", "piece").count().where("count > 1").count() == 0
    whole = {x.sequence_id: x.ids for x in packing.sequences(r).collect()}
    for x in r.select("sequence_id", "offset", "length", "ids", "ids_crc32").collect():
        assert bytes(whole[x.sequence_id])[4 * x.offset : 4 * (x.offset + x.length)] == bytes(x.ids) and zlib.crc32(x.ids) == x.ids_crc32


def test_components(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(8, 60)]
    e = spark.createDataFrame([*path, *star, (5, 5), (1, 2), (2, 1)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 60)}, 1: 1, 2: 1}

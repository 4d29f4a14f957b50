"""Cases at the edge of the numbered operators: null ids, infinite components, dense clusters, clashing columns."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import chat_format, embedding_dedup, entries, language_id, mixing, secret_scan

from .test_operators import DOCS, corpus, folder


def test_op2_null_conversation(spark, tmp_path):
    rows = [(None, 1, "assistant", "b"), (None, 0, "user", "a"), (3, 0, "user", None)]
    got = {r.conv_id: r for r in entries.QUERIES["op2_chat_format"](spark, folder(spark, tmp_path, conversations=(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert set(got) == {None, 3, chat_format.PROBE_ID}
    assert got[None].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest() and got[None].loss_chars == 1
    assert got[3].n_turns == 1 and got[3].loss_chars == 0


def test_op6_null_ids_and_infinite_components(spark):
    rows = [(1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [float("inf"), 1.0], 0), (3, [float("-inf"), 1.0], 0), (4, [1.0, 0.001], 0), (5, [1.0, 0.0], None)]
    got = sorted(map(tuple, embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (None, 0, None, None), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 1, False), (5, 0, 5, True)], key=str)


@pytest.mark.parametrize("n, part", [(700, 4096), (700, 150)])
def test_op6_dense_cluster(spark, monkeypatch, n, part):
    """Near copies of one vector, whole and in pairs of parts: every link is counted once."""
    monkeypatch.setattr(embedding_dedup, "PART", part)
    r = np.random.default_rng(4)
    c = r.normal(size=32)
    x = (c + 0.2 * r.normal(size=(n, 32))).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.93
    want, got = near.sum(1) - 1, np.zeros(n, np.int64)
    for r in embedding_dedup.link_vectors(d).collect():
        got[r.vec_id] = r.n_links
        assert r.component_id == (0 if near[r.vec_id].sum() > 1 else r.vec_id)
    assert (got <= want).all() and got.sum() >= 0.97 * want.sum()


def test_op8_null_ids_share_one_place(spark, tmp_path):
    """A source whose rows have no ids is taken whole, as often as its target holds it and once more or not; no document passes twice its size."""
    rows = [(None, "w " * 10, "en", "a", 1)] * 9 + [(i, "w " * 10, "en", "b", 1) for i in range(90)] + [(None, None, None, None, None)]
    out = entries.QUERIES["op8_mixing"](spark, folder(spark, tmp_path, documents=(rows, DOCS))).collect()
    a = [r for r in out if r.source_size == 90]
    assert len(a) == 9 and len({r.taken for r in a}) == 1 and all(r.taken <= 2 * r.size for r in out)
    assert abs(sum(r.taken for r in a) - a[0].target) <= 90


def test_clashing_columns(spark):
    d = spark.createDataFrame(corpus(), DOCS)
    for name in ("row", "spans", "score", "lang_pred", "held_out", "kind", "at", "words", "text_", "start"):
        d = d.withColumn(name, F.lit("x"))
    assert secret_scan.secrets_stage(spark, d, "").columns == d.columns
    assert mixing.mixing_stage(spark, d, "").columns == d.columns


def test_fitting_bound_is_what_the_docstring_says():
    assert "TRAIN_ROWS" in language_id.__doc__

"""Rows of one doc_id with unequal or null texts don't share what is found in one of them."""

from collections import Counter

import pytest

from scholia.llm import substring_dedup

from .test_operators import op1_wanted, prose


@pytest.mark.parametrize("broadcast", [True, False])
def test_op1_one_id_with_other_texts(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(substring_dedup, "MOST_IDS", -1)
    base = prose(120, 1)
    rows = [(1, base), (2, prose(50, 2) + " " + base), (2, prose(200, 3)), (2, "short text"), (2, None), (3, base), (3, base), (3, ""), (None, base)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substring_dedup.dedup_substrings(d).collect())) == op1_wanted(rows)

"""Collocations against counting by hand, with small least counts so that many phrases qualify."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scholia.llm import collocations as C
from scholia.llm import entries

from .test_operators import DOCS, corpus, folder


def wanted(pairs, least, top, share=100):
    f, n = Counter(), Counter()
    for t, lang in pairs:
        lang = "und" if lang is None else lang
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, p), a in cand.items():
        for k in range(2, len(p)):
            covered |= {(lang, p[i : i + k]) for i in range(len(p) - k + 1) if 100 * a >= share * f[lang, p[i : i + k]]}
    out = Counter()
    for lang in n:
        rows = []
        for (c, p), a in cand.items():
            if c == lang and (c, p) not in covered:
                score, _, left, right = min((1000 * a * n[c] // (f[c, p[:k]] * f[c, p[k:]]), k, f[c, p[:k]], f[c, p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out[lang, rank, p.decode(), -a, left, right, n[lang], -s] += 1
    return out


def texts(seed, n):
    r = random.Random(seed)
    words = ["a", "b", "c", "dd", "É", "é", "x\x1cy", "Z", "q"]
    some = lambda k: "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", " \x0b"]) for _ in range(k))
    rows = [(some(r.randrange(0, 60)), r.choice(["en", "de", None, "und", ""])) for _ in range(n)]
    return [*rows, (None, "en"), ("", "fr"), (" . ,\n", "fr"), ("a b c dd É " * 900, "en"), ("Passage one two three four five six seven.", "nl"), *[("passage ONE two three four five six seven", "nl")] * 9, *[rows[0]] * 3]


def test_counts_by_hand(spark):
    rows = texts(1, 250)
    d = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    for least, top, share in ((2, 10**6, 100), (7, 30, 100), (4, 50, 80)):
        got = Counter(map(tuple, C.mine_collocations(d, least, top, share).collect()))
        assert got == wanted(rows, least, top, share)


def test_split_groups_and_small_batches(spark, monkeypatch):
    """Hot leading words move grams apart, and batches of a few rows leave partial sums that are added up."""
    rows = texts(2, 120)
    monkeypatch.setattr(C, "HOT_SHARE", 10)
    monkeypatch.setattr(C, "GRAMS_A_PART", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert Counter(map(tuple, C.mine_collocations(spark.createDataFrame(rows, "text string, lang string"), 3, 10**6).collect())) == wanted(rows, 3, 10**6)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hashes_in_place_of_numbers(spark, monkeypatch):
    """More frequent words than are listed: bits and hashes."""
    rows = texts(4, 100)
    monkeypatch.setattr(C, "LISTED", 3)
    monkeypatch.setattr(C, "BITS", 8)
    assert Counter(map(tuple, C.mine_collocations(spark.createDataFrame(rows, "text string, lang string"), 2, 10**6).collect())) == wanted(rows, 2, 10**6)


def test_packing_of_any_width(spark):
    lex = C.Lexicon.__new__(C.Lexicon)
    for bits in (1, 5, 12, 13, 21, 22, 31, 32, 64):
        lex.bits = bits
        lex._lay_out()
        w = [np.random.default_rng(i).integers(0, 2**64, 50, np.uint64) >> np.uint64(64 - bits) for i in range(C.LONGEST)]
        assert (lex.unpacked(lex.packed(w)) == np.stack(w)).all()


def test_words_whose_names_clash(spark, monkeypatch):
    """A seed that gives two words one name is left for the next."""
    d = spark.createDataFrame(texts(3, 40), "text string, lang string")
    monkeypatch.setattr(C, "word_counts", lambda docs, seed, f=C.word_counts: f(docs, seed).withColumn("h", F.lit(5).cast("long") if seed == 0 else F.col("h")))
    assert C.counted_words(d, 3)[2] == 1


def test_exact_beyond_64_bits(spark):
    big = 3 * 10**17
    row = spark.sql(f"select cast({big} as decimal(19,0)) * cast({big} as decimal(19,0)) * 1000 up, cast(701 as decimal(19,0)) * cast({big} as decimal(19,0)) down").selectExpr("up div down as s").first()
    assert row.s == 1000 * big * big // (701 * big)


def test_cut_words_of_slices():
    t = pa.array(["x", "Ab c.d", None, "", "é\tF"]).slice(1)
    w, doc, piece = C.cut_words(t)
    assert w.to_pylist() == [b"ab", b"c", b"d", "é".encode(), b"f"] and doc.tolist() == [0, 0, 0, 3, 3]
    assert np.diff(piece).astype(bool).tolist() == [False, True, True, False]


def test_query_on_awkward_rows(spark, tmp_path):
    rows = corpus() * 4
    d = folder(spark, tmp_path, documents=(rows, DOCS))
    assert Counter(map(tuple, entries.QUERIES["op12_collocations"](spark, d).collect())) == wanted([(r[1], r[2]) for r in rows], 100, 2000)

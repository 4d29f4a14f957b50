"""What the review of round 3 found about work that one task did alone or that was shuffled without need."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia import plans
from scholia.operators import graph, mentions, retrieve
from scholia.plans import streams
from scholia.sources import study
from scholia.streaming import sessions


def test_session_batches_are_spread_over_files(spark, sf_dir, monkeypatch):
    files = []
    run = sessions.run_sessions

    def seen(stream, kept, state):
        run(stream, kept, state)
        files.append(state)

    monkeypatch.setattr(sessions, "run_sessions", seen)
    monkeypatch.setattr(study, "session_events", lambda s, d, f=study.session_events: f(s, d).repartition(3))
    got = streams.st3_stream_sessions(spark, sf_dir)
    assert len(files) == 3 and len(set(files)) == 1  # three batches, one checkpoint
    want = sessions.session_states(study.session_events(spark, sf_dir)).drop("exercise_ids")
    assert {tuple(r[c] for c in want.columns) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_postings_are_counted_in_their_line(spark):
    """Only chunks that are there twice are shuffled by term; both give the same counts."""
    rows = [("b", "1", f"1_{i}", i, " ".join(f"w{j % 5}" for j in range(i))) for i in range(9)] + [("b", "2", "2_0", 0, "x y x")] * 2 + [(None, None, "3_0", 0, "x z")]
    c = spark.createDataFrame(rows, "book_id string, chapter string, chunk_id string, chunk_index int, content string")
    p, stats = retrieve.build_postings(c)
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.book_id, r.term, r.chunk_id): (r.tf, r.dl) for r in p.collect()}
    want = {}
    for b, _, k, _, text in rows:
        for w in text.split():
            want[b, w, k] = (want.get((b, w, k), (0, 0))[0] + 1, len(text.split()))
    assert got == want and p.count() == len(want) and "MapInArrow" in plan
    assert stats.count() == 2


def test_few_distances_are_held_at_a_time(spark, monkeypatch):
    """Tiles shrink as batches of vectors grow; the nearest are the same."""
    sizes = []
    monkeypatch.setattr(np, "partition", lambda d, *a, p=np.partition, **k: (sizes.append(d.size), p(d, *a, **k))[1])
    rng = np.random.default_rng(3)
    q, x = rng.normal(size=(300, 8)), rng.normal(size=(4000, 8))
    found = [set(zip(*(a.tolist() for a in t))) for t in retrieve._tiles(q, x, 5)]
    assert max(sizes) <= retrieve.CELLS and len(found) > 1
    d = np.round(1 - q @ x.T, 6)
    assert set().union(*found) == {(i, j, d[i, j]) for i in range(300) for j in np.flatnonzero(d[i] <= np.sort(d[i])[4]).tolist()}


def test_occurrences_are_worked_out_for_what_was_found(spark, sf_dir, monkeypatch):
    known = []
    monkeypatch.setattr(study, "occurrences", lambda s, d, k=None, *a, f=study.occurrences: (known.append(k), f(s, d, k, *a))[1])
    ranked, o = plans.retrieve._ranked(spark, sf_dir)
    met = {r.concept_id for r in known[0].collect()}
    assert len(known) == 1 and {r.concept_id for r in ranked.collect()} <= met and len(met) < study.concepts(spark, sf_dir).count()
    assert {r.concept_id for r in o.collect()} == met


@pytest.mark.parametrize("chars", [4_000_000, 6])
def test_concepts_of_a_chunk_are_counted_in_its_line(spark, monkeypatch, chars):
    """Names are counted in the task, also in several blocks and where concepts share a name."""
    monkeypatch.setattr(mentions, "NAME_CHARS", chars)
    names = {"c1": ["ab", "abc"], "c2": ["b", "ab", ""], "c3": ["zz"], "c4": ["é"], "c5": ["aé"], "c6": ["q"]}
    c = spark.createDataFrame([(k, max(v, key=len), v) for k, v in names.items()] + [("c7", "none", None)], "concept_id string, canonical_name string, aliases array<string>")
    texts = {"1": "xxabcéz", "2": "abaé", "3": "", "4": None, "5": "zz zz b"}
    d = graph.candidate_concepts_per_chunk(spark.createDataFrame(list(texts.items()), "chunk_id string, content string"), c, 2, 1)
    want = set()
    for k, t in texts.items():
        found = sorted((-sum(n in (t or "") for n in set(v) if n), len(max(v, key=len)), max(v, key=len), i) for i, v in names.items() if any(n in (t or "") for n in v if n))
        want |= {(k, i, -s, r + 1) for r, (s, _, _, i) in enumerate(found[:2])}
    assert {(r.chunk_id, r.concept_id, r.score, r["rank"]) for r in d.collect()} == want
    assert "Join" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_normalised_without_patterns(spark):
    """Trailing punctuation also goes before a line separator that a pattern's end would pass over, and stays inside."""
    want = {"a,b.,;": "a,b", " （x）：　": "(x)", "a\t 　b\n": "ab", "，。": "", "x.\u2028": "x.\u2028", "［｛y｝］、.": "[{y}]"}
    d = spark.createDataFrame([(k,) for k in want], "w string").select("w", graph.normalise_name(F.col("w")).alias("n"))
    assert {r.w: r.n for r in d.collect()} == want
    assert "regexp" not in d._jdf.queryExecution().optimizedPlan().toString().lower()


def test_clusters_equal_plain_comparison_book_by_book(spark):
    """Bounds are worked out for all seeds at once and books aren't put into one task; clusters are those of comparing one by one."""
    rng = random.Random(4)
    rows = [(f"b{k}", "".join(rng.choice("abcd") for _ in range(rng.randrange(2, 9))), i) for k in range(3) for i in range(120)]
    d = graph.cluster_concepts(spark.createDataFrame(rows, "book_id string, name string, pos long"))
    want = set()
    for k in range(3):
        seeds = []
        for name in dict.fromkeys(n for b, n, _ in rows if b == f"b{k}"):
            own = next((s for s in seeds if SequenceMatcher(None, name, s[0]).ratio() >= graph.SIMILAR), None)
            own.append(name) if own else seeds.append([name])
        want |= {(f"b{k}", m, min(s, key=lambda x: (-len(x), x))) for s in seeds for m in s}
    assert {tuple(r) for r in d.collect()} == want
    assert "REPARTITION_BY_NUM" in d._jdf.queryExecution().executedPlan().toString()

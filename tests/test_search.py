"""The search tiers against brute force: whole texts, and vectors where no text is the same."""

import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from conftest import rows_of, sql_rows

from lorekeep.operators import search
from lorekeep.plans import catalogue


def folder(spark, at, docs, vectors) -> str:
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def test_whole_texts_and_vectors(spark, tmp_path):
    head = "the same header of every page, " * 10
    texts = {i: f"{head}{i}" for i in range(0, 301, 7)} | {0: head + "a", 1: head + "a", 50: head + "b", 51: head + "c", 100: None, 101: None, 150: "x", 200: "y", 250: "z", 300: "same"} | {i: "same" for i in range(400, 408)}
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 16))
    vectors = {i: (base[i % 4] + 0.5 * rng.normal(size=16)).astype(np.float32).tolist() for i in range(0, 420) if i != 150}
    docs = [(i, t, len(t or "")) for i, t in texts.items()]
    at = folder(spark, tmp_path, docs, list(vectors.items()))
    same = defaultdict(list)
    for i, t in sorted(texts.items()):
        same[t].append(i)
    found = {tuple(r) for r in catalogue.exact_lookup(spark, at).collect()}
    assert found == {(i, e, n + 1) for i, t in texts.items() if t is not None for n, e in enumerate(same[t][:5])}
    unit = {i: np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) for i, v in vectors.items()}
    expected = set()
    for i in (i for i in texts if i % 50 == 0):
        others = [e for e in same[texts[i]] if e != i] if texts[i] is not None else []
        near = sorted((-float(unit[i] @ unit[e]), e) for e in unit if e != i) if i in unit else []
        hits = [(e, "fingerprint") for e in others] or [(e, "semantic") for s, e in near if -s >= 0.2]
        expected |= {(i, e, n + 1, via) for n, (e, via) in enumerate(hits[:5])}
    assert {x[3] for x in expected} == {"fingerprint", "semantic"}
    assert {tuple(r)[:4] for r in catalogue.search_tiers(spark, at).collect()} == expected


def test_queries_and_entries_come_in_parts(spark, monkeypatch):
    """Groups and slices give the nearest of all, ties to the smaller id; no row carries a pair of blocks."""
    monkeypatch.setattr(search, "HELD", 7)
    rng = np.random.default_rng(5)
    vectors = {i: rng.integers(-2, 3, size=4).astype(float).tolist() for i in range(1, 1_500)} | {i: rng.normal(size=3).tolist() for i in range(1_500, 1_600)}
    odd = [(2_000, None), (2_001, [0.0] * 4), (2_002, [float("nan"), 1.0, 1.0, 1.0]), (2_003, [None, 1.0, 1.0, 1.0]), (2_004, [])]
    entries = spark.createDataFrame(list(vectors.items()) + odd, "entry_id long, vec array<double>")
    found = search.semantic_hits(entries.where("entry_id % 40 = 0").withColumnRenamed("entry_id", "query_id"), entries, 0.5, 6)
    assert "NestedLoop" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items() if any(v)}
    expected = set()
    for q in (i for i in unit if i % 40 == 0):
        near = sorted((-round(float(unit[q] @ v), 12), i) for i, v in unit.items() if len(v) == len(unit[q]))
        expected |= {(q, i, n + 1) for n, (s, i) in enumerate(near[:6]) if -s >= 0.5}
    assert {(r.query_id, r.entry_id, r["rank"]) for r in found.collect()} == expected


@pytest.mark.parametrize("name", ["strong_hits", "relevant_hits"])
def test_queries_of_hits_pair_no_blocks(spark, sf_dir, name):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ["strong_hits", "relevant_hits"])
def test_scores_that_agree_in_nine_digits_are_ties(spark, tmp_path, name):
    """The higher an id, the nearer, by less than the ninth digit; and more copies than an answer has places."""
    near = [(i, [1.0, 1e-6 * (20 - i), 0.0, 0.0]) for i in range(1, 20)]
    copies = [(i, [0.0, 0.0, 1.0, 1.0]) for i in range(100, 3_000)]
    at = folder(spark, tmp_path, [], [(0, [1.0, 0.0, 0.0, 0.0]), *near, (50, [0.0, 1.0, 0.0, 0.0]), *copies])
    found = catalogue.QUERIES[name](spark, at)
    vectors = f"read_parquet('{at}/embeddings.parquet/*.parquet')"
    sql = catalogue.SQL[name].replace("FROM embeddings", f"FROM {vectors}").replace("q, embeddings", f"q, {vectors}")
    assert rows_of(found) == sql_rows(sql, found.columns)
    assert {r.entry_id for r in found.where("query_id = 0").collect()} == {1, 2, 3, 4, 5}


def test_a_block_of_copies_takes_no_more_room():
    """Of copies only as many are kept as have a place, so memory is that of a few arrays of scores; ties to the smaller id."""
    scores, ids = np.ones((512, 1_024)), np.arange(1_024) * 3
    best = np.full((512, 6), -np.inf), np.zeros((512, 6), np.int64)
    tracemalloc.start()
    for later in (0, 4_000):
        search._merged(best, scores, ids + later, 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (best[0] == 1).all() and (best[1] == ids[:6]).all()
    assert peak < 4 * scores.nbytes

"""The stored index against brute force: recall, exact scores, batches that are appended and written again, crowded cells."""

from __future__ import annotations

import numpy as np
import pytest
from lorekeep.operators import vector_index
from lorekeep.plans import catalogue

ROWS = "entry_id long, vec array<float>"
ASKED = "query_id long, vec array<float>"


def clusters(n, dims=24, centers=40, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((centers, dims))
    return [(i, (base[i % centers] + 0.35 * rng.standard_normal(dims)).astype(np.float32).tolist()) for i in range(n)]


def brute(rows, asked, k):
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for q, v in asked:
        u = np.array(v, dtype=np.float64)
        scores = x @ (u / np.linalg.norm(u))
        order = sorted(range(len(rows)), key=lambda i: (-round(scores[i], 9), rows[i][0]))[:k]
        found[q] = [(rows[i][0], scores[i]) for i in order]
    return found


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.entry_id, r.score))
    return out


def share(found, true):
    return sum(len({e for e, _ in found.get(q, [])} & {e for e, _ in v}) for q, v in true.items()) / sum(map(len, true.values()))


def test_recall_and_appended_batches(spark, tmp_path):
    rows = clusters(4000)
    first, second = rows[:2500], rows[2500:]
    asked = [(i, v) for i, v in rows if i % 50 == 0]
    path = str(tmp_path / "index")
    vector_index.create(spark.createDataFrame(first, ROWS), path, "a")
    centres = spark.read.parquet(f"{path}/centres").collect()
    for _ in range(2):  # written again under its name
        vector_index.append(spark.createDataFrame(second, ROWS), path, "b")
    assert spark.read.parquet(f"{path}/centres").collect() == centres and spark.read.parquet(f"{path}/codes").count() == spark.read.parquet(f"{path}/exact").count() == 4000
    queries, true = spark.createDataFrame(asked, ASKED), brute(rows, asked, 5)
    found = listed(vector_index.probe(queries, path, 5))
    probes = spark.read.parquet(f"{path}/probes").first().probes
    assert probes < len(centres) / 2 and vector_index.tune(spark.createDataFrame(rows, ROWS), path) < len(centres) / 2
    assert share(found, true) >= 0.95 and all(len(x) == 5 for x in found.values())
    scores = {q: dict(x) for q, x in brute(rows, asked, 4000).items()}
    assert all(abs(s - scores[q][e]) < 1e-9 for q, x in found.items() for e, s in x)
    every = listed(vector_index.probe(queries, path, 5, probes=vector_index.MOST_CELLS))
    assert share(every, true) >= 0.999  # codes alone lose next to nothing
    size = vector_index.bytes_read(queries.limit(1), path, probes=4).first()
    assert 0 < size.code_bytes < size.all_bytes / 20
    assert vector_index.recall(vector_index.probe(queries, path, 5), vector_index.probe(queries, path, 5, probes=999)) >= 0.95
    assert listed(vector_index.probe(queries, path, 5, least=0.9)) == {q: y for q, x in found.items() if (y := [z for z in x if z[1] >= 0.9])}


def test_crowded_cells_and_odd_rows(spark, tmp_path, monkeypatch):
    """A third of all entries are one vector; tasks meet few of them and few queries at a time. Rows without a direction stay out."""
    monkeypatch.setattr(vector_index, "BLOCK", 64)
    monkeypatch.setattr(vector_index, "PART", 8)
    rows = clusters(900, dims=8, centers=12)
    rows += [(1000 + i, rows[0][1]) for i in range(450)]
    odd = [(5000, None), (5001, [0.0] * 8), (5002, [float("nan")] * 8), (5003, [None] * 8), (5004, [1.0] * 5), (5005, []), (5006, [float("inf")] + [1.0] * 7)]
    path = str(tmp_path / "index")
    vector_index.create(spark.createDataFrame(rows + odd, ROWS), path)
    asked = [(i, v) for i, v in rows if i % 7 == 0]
    found = listed(vector_index.probe(spark.createDataFrame(asked + [(9000 + i, v) for i, v in odd], ASKED), path, 5, probes=999))
    true = brute(rows, asked, 5)
    assert set(found) == set(true)
    # Of equal vectors the smaller entry_ids come first.
    assert all([s for _, s in found[q]] == pytest.approx([s for _, s in true[q]], abs=1e-9) for q in true)


def test_nothing_to_find(spark, tmp_path):
    path = str(tmp_path / "index")
    vector_index.create(spark.createDataFrame([(1, None), (2, [0.0, 0.0])], ROWS), path)
    assert vector_index.probe(spark.createDataFrame([(1, [1.0, 2.0])], ASKED), path).collect() == []
    with pytest.raises(ValueError, match="no cells"):
        vector_index.append(spark.createDataFrame([(1, [1.0])], ROWS), path, "b")
    one = str(tmp_path / "one")
    vector_index.create(spark.createDataFrame([(1, [1.0, 2.0])], ROWS), one)
    assert [(r.entry_id, r.rank) for r in vector_index.probe(spark.createDataFrame([(7, [1.0, 2.0]), (8, [1.0])], ASKED), one).collect()] == [(1, 1)]


def test_query(spark, sf_dir):
    """What the stored index finds of the whole search: at least 0.95."""
    true = catalogue.QUERIES["semantic_topk"](spark, sf_dir)
    assert vector_index.recall(catalogue.QUERIES["indexed_neighbours"](spark, sf_dir), true) >= 0.95

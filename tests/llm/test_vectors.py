"""Exact search and vector codes against plain loops over whole numbers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from conftest import rows_of, sql_rows
from pyspark.sql import functions as F

from lorekeep.llm import exact_search, queries, vector_codes


def odd_vectors():
    """Clusters, ties, copies, zeros, other lengths, vectors that take no part, repeated and missing identifiers."""
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((6, 16))
    rows = [(i, [float(x) for x in centers[i % 6] * (1 + i % 3) / 4 + 0.05 * rng.standard_normal(16)], i % 5) for i in range(240)]
    rows += [(300 + i, rows[0][1], None) for i in range(70)] + [(400 + i, [0.0] * 16, 1) for i in range(30)] + [(500 + i, [float(x) for x in rng.integers(-1, 2, 16)], 2) for i in range(60)]
    rows += [(600, None, 1), (601, [float("nan")] + [1.0] * 15, 1), (602, [None] + [1.0] * 15, None), (603, [float("inf")] + [1.0] * 15, 1), (604, [1e300, -1e300] + [0.5] * 14, 3)]
    rows += [(700 + i, [0.1 * i, -0.2, 0.3 * (i % 4)], 4) for i in range(25)] + [(740, [], 1), (741, [], 1)]
    return rows + [(20, rows[20][1], 0), (20, rows[40][1], 1), (21, rows[0][1], 2), (None, rows[0][1], 3), (None, [0.0] * 16, None)]


def whole(vector, scale, most):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [max(-most, min(most, math.floor(x * scale))) for x in vector]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS row", "2 AS q", "'x' AS name", "3 AS part", "4 AS vec", "5 AS dims").repartition(3)


def brute_search(rows, asked, k):
    sound = [(i, whole(v, exact_search.SCALE, exact_search.MOST)) for i, v, _ in rows]
    sound = [(i, v) for i, v in sound if v is not None]
    found = []
    for a, (q, x) in enumerate(sound):
        if q is not None and asked(q):
            others = [(-sum(map(int.__mul__, x, y)), i is None, i) for b, (i, y) in enumerate(sound) if b != a and len(x) == len(y)]
            found += [(q, rank + 1, i, -less) for rank, (less, _, i) in enumerate(sorted(others, key=lambda o: (o[0], o[1], o[2] or 0))[:k])]
    return sorted(found, key=repr)


@pytest.mark.parametrize("limits", [{}, {"SLICE": 24, "GROUP": 7, "READ": 2, "SALTS": 3}])
def test_search(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(exact_search, name, value)
    rows = odd_vectors()
    own = table(spark, rows).select("vec_id", exact_search.whole_numbers(F.col("embedding"), exact_search.SCALE).alias("vec"), (F.col("vec_id") % 3 != 1).alias("asked"))
    for k in (1, 20):
        found = [tuple(r) for r in exact_search.exact_top_k(own, k).collect()]
        assert sorted(found, key=repr) == brute_search(rows, lambda i: i % 3 != 1, k)
    assert exact_search.exact_top_k(own.where("false")).count() == 0
    assert exact_search.exact_top_k(own.withColumn("asked", F.lit(None).cast("boolean"))).count() == 0


def test_search_query(spark, tmp_path):
    rows = odd_vectors()
    table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = [tuple(r) for r in queries.QUERIES["op11_exact_search"](spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == brute_search(rows, lambda i: i % 20 == 0, 20)


def test_bounds_hold():
    """Every product lies within its bounds; wide cells and huge numbers included."""
    import pandas as pd

    rng = np.random.default_rng(6)
    for most, d in ((3, 1), (40, 7), (1 << 20, 64), (1 << 24, 33)):
        x, q = rng.integers(-most, most + 1, (200, d)), rng.integers(-most, most + 1, (9, d))
        slice_ = exact_search.approximated(pd.DataFrame({"c": np.arange(200), "least": np.arange(200), "vec": list(x), "slice": 0}))
        cells, bounds = np.frombuffer(slice_["cells"][0], dtype=np.uint8).reshape(200, -1), np.frombuffer(slice_["bounds"][0], dtype=np.int64).reshape(2, d, -1)
        low, high = exact_search.bounded(q, cells, bounds)
        true = 2 * (q @ x.T)
        assert (low <= true).all() and (true <= high).all()
        if most == 3:
            assert (low == high).all()  # each value has a cell of its own


@pytest.mark.parametrize("name", ["op11_exact_search", "op13_vector_codes"])
def test_sql(spark, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir)
    assert rows_of(found) == sql_rows(queries.SQL[name], found.columns, sf_dir)


def brute_codes(rows, parts, entries, rounds):
    found = []
    sound = [(i, whole(v, vector_codes.SCALE, vector_codes.MOST), label) for i, v, label in rows]
    sound = sorted((r for r in sound if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for dims in {len(v) for _, v, _ in sound}:
        own, edges = [r for r in sound if len(r[1]) == dims], [dims * i // parts for i in range(parts + 1)]
        codes, error, text = [""] * len(own), [0] * len(own), []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            points = [v[a:b] for _, v, _ in own]
            book = [list(p) for p in points[:entries]]
            for last in range(rounds + 1):
                distance = [[sum((x - y) ** 2 for x, y in zip(p, e, strict=True)) for e in book] for p in points]
                near = [min(range(len(book)), key=lambda j, d=d: (d[j], j)) for d in distance]
                if last == rounds:
                    break
                for j in range(len(book)):
                    mine = [p for p, n in zip(points, near, strict=True) if n == j]
                    if mine:
                        book[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
            codes = [c + f"{n:02x}" for c, n in zip(codes, near, strict=True)]
            error = [e + d[n] for e, d, n in zip(error, distance, near, strict=True)]
            text += [str(x) for e in book for x in e]
        sha = hashlib.sha256(",".join(text).encode()).hexdigest()
        found += [(i, label, c, e, sha) for (i, _, label), c, e in zip(own, codes, error, strict=True)]
    return sorted(found, key=repr)


@pytest.mark.parametrize(("parts", "entries", "rounds", "limits"), [(8, 16, 6, {}), (3, 5, 2, {"BLOCK": 40, "LEAF": 2, "BOOK_BYTES": 100}), (5, 3, 0, {"LEAF": 1})])
def test_codes(spark, monkeypatch, parts, entries, rounds, limits):
    for name, value in limits.items():
        monkeypatch.setattr(vector_codes, name, value)
    rows = odd_vectors()
    own = table(spark, rows).select("vec_id", "label", exact_search.whole_numbers(F.col("embedding"), vector_codes.SCALE, vector_codes.MOST).alias("vec"))
    found = [tuple(r) for r in vector_codes.vector_codes(own, parts, entries, rounds).collect()]
    assert sorted(found, key=repr) == brute_codes(rows, parts, entries, rounds)
    assert vector_codes.vector_codes(own.where("false")).collect() == []


def test_codes_query(spark, tmp_path):
    rows = odd_vectors()
    table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.QUERIES["op13_vector_codes"](spark, str(tmp_path)).collect()
    expected = brute_codes(rows, 8, 16, 6)
    sums = {label: sum(r[3] for r in expected if r[1] == label) for label in {r[1] for r in expected}}
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found), key=repr) == sorted(((i, c, e, sums[label], sha) for i, label, c, e, sha in expected), key=repr)


def test_trees():
    """Every point is covered within its node's radius, sums are of what is below, and whole subtrees are in fact assigned."""
    rng = np.random.default_rng(1)
    points = rng.integers(-500, 500, (3000, 2))
    tree = vector_codes.cover_tree(points)
    assert (tree["points"][tree["of"]] == points).all() and tree["many"][0] == 3000 and (tree["sums"][0] == points.sum(axis=0)).all()
    entries = rng.integers(-500, 500, (7, 2))
    sums, many = vector_codes.summed(tree, entries)
    code, squared = vector_codes.assigned(tree, entries)
    true = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (code == np.argmin(true, axis=1)).all() and (squared == true.min(axis=1)).all()
    assert many.tolist() == np.bincount(code, minlength=7).tolist() and all((sums[j] == points[code == j].sum(axis=0)).all() for j in range(7))
    whole_ones = [n for nodes, _ in vector_codes.walked(tree, entries) for n in nodes.tolist()]
    assert sum(tree["many"][whole_ones]) == 3000 and len(whole_ones) < len(tree["points"]) // 2

"""Runs of words against every period tried out, one after the other."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lorekeep.llm import periodic_runs as runs
from lorekeep.llm import queries

from . import fixtures


def brute(words, least=6, exponent=4):
    """(start, length, period) of all runs, by start, then period."""
    _, ids = np.unique(np.array(words, dtype=object), return_inverse=True) if words else (None, np.zeros(0, int))
    found = {}
    for q in range(1, len(ids) // exponent + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b + q - a >= max(least, exponent * q):
                found.setdefault((a, b + q - a), q)  # of equal stretches the smallest period
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda x: (x[0], x[2]))


def collapsed(words, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeated(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def found_in(words, least=6, exponent=4):
    data = " ".join(map(str, words)).encode()
    n, found, _ = runs.document_runs(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), least, exponent)
    assert n.tolist() == [len(words)]
    return [tuple(x) for x in found[:, 1:].tolist()]


def test_against_all_periods():
    rng = random.Random(4)
    for _ in range(1500):
        n, kinds = rng.randrange(60), rng.choice([1, 2, 3, 8])
        words = [rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.6:
            p, a = rng.randrange(1, 8), rng.randrange(n)
            words = [w if i < a else words[min(n - 1, a + (i - a) % p)] for i, w in enumerate(words)]
        least, exponent = rng.choice([1, 4, 6]), rng.choice([2, 3, 4])
        expected = brute(words, least, exponent)
        assert found_in(words, least, exponent) == expected, words
        trees = runs.runs_of([np.array(x, dtype=np.int64) for x in ([], words, words[:9])], least, exponent)
        assert [tuple(x[1:]) for x in trees.tolist() if x[0] == 1] == expected, words


def test_long_periods():
    rng = random.Random(5)
    for _ in range(60):
        words = [rng.randrange(rng.choice([5, 30, 3000])) for _ in range(rng.randrange(200, 900))]
        for _ in range(2):
            p, a = rng.randrange(1, 130), rng.randrange(len(words) - 50)
            for i in range(a + p, min(len(words), a + rng.randrange(p, 8 * p + 10))):
                words[i] = words[i - p]
        assert found_in(words) == brute(words)


def test_documents_do_not_touch():
    """A run that two documents would make together is none; many documents side by side have what each has alone."""
    texts = [b"a b a b a b", b"a b a b a b a", b"", b"x", b" a  b\ta b\na b a b ", b"b a b a b a b a"]
    data, edges = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    n, found, (begun, left) = runs.document_runs(data, edges)
    assert n.tolist() == [6, 7, 0, 1, 8, 8]
    assert found.tolist() == [[4, 0, 8, 2], [5, 0, 8, 2]]
    assert [left[a:b].tobytes() for a, b in zip(begun[:-1], begun[1:], strict=True)] == [b"a b a b a b", b"a b a b a b a", b"", b"x", b"a b", b"b a"]


@pytest.mark.parametrize("at_once", [2_000_000, 50])
def test_cases(spark, monkeypatch, at_once):
    monkeypatch.setattr(runs, "BYTES_AT_ONCE", at_once)
    monkeypatch.setattr(runs, "WORDS_IN_TREE", at_once)
    rows = [(None, "x y " * 9), (1, None), (2, ""), (3, " \t\n"), (4, "a " * 5), (5, "a " * 6), (5, "a " * 6), (6, "A a " * 20), (7, "é ß 漢 " * 12), (8, fixtures.text(1, 400) + " q r s" * 5000), (9, ("l m n\n" * 4 + "z ") * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS n_words", "'x' AS collapsed")
    found = runs.periodic_runs(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        words = next(re.findall(runs.WORD, t or "") for i, t in rows if i == r.doc_id)
        expected = brute(words)
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(words), expected, collapsed(words, expected)), r.doc_id
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, exponent=1)


def test_query(spark, sf_dir):
    found = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    for r in docs:
        words = repeated(r.doc_id, re.findall(runs.WORD, r.text or ""))
        all_runs, mine = brute(words), found[r.doc_id]
        best = min(all_runs, key=lambda x: (-x[1], x[0], x[2])) if all_runs else (None, None, None)
        assert (mine.n_runs, mine.start, mine.length, mine.period) == (len(all_runs), *best), r.doc_id
        assert mine.exponent_milli == (1000 * best[1] // best[2] if all_runs else None)
        assert mine.runs_sha256 == digest("".join(f"{a},{n},{q}\n" for a, n, q in all_runs))
        assert mine.collapsed_sha256 == digest(collapsed(words, all_runs))


def test_query_over_odd_rows(spark, tmp_path):
    fixtures.odd(spark).unionByName(fixtures.twice(spark), allowMissingColumns=True).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    assert len(found) == 22 and all(r.runs_sha256 and r.collapsed_sha256 for r in found)
    assert all((r.start is None) == (r.n_runs == 0) for r in found)

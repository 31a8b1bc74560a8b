"""Small tables with what operators must bear: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SEQ_WORDS = [f"w{i}" for i in range(400)]


def text(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(SEQ_WORDS) for _ in range(n))


def odd_rows() -> list[tuple]:
    base = text(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    passage = text(2, 80)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, near, "en", None, 1), (4, "", "en", "b", 0), (5, None, None, "b", None),
        (6, "one", "de", "b", 3), (7, " \t\n ", "de", "c", 3), (8, text(3, 30) + " " + passage, "de", "c", 9), (9, passage + " " + text(4, 30), "fr", "c", 9),
        (10, "x" * 1000, "fr", "c", 1000), (11, text(5, 6000), "en", "a", 9), (12, "Ünïcödé ßtraße — 漢字 \U0001f600 naïve", "de", "d", 9), (13, "one", "de", "b", 3),
        (14, "ONE", "de", "b", 3), (15, text(6, 50) + "\n" + text(6, 50), "en", "a", 9), (16, "don't <|endoftext|> stop 12 ½ x", "en", "a", 9),
    ]
    return rows


def odd(spark):
    """With columns whose names operators use themselves."""
    docs = spark.createDataFrame(odd_rows(), DOCS)
    return docs.selectExpr("*", "1 AS row", "2 AS size", "'x' AS shard", "3 AS count", "'y' AS component")


def twice(spark):
    """Repeated rows and null identifiers."""
    rows = [(1, text(9, 50), "en", "a", 1)] * 2 + [(None, text(9, 50), "en", "a", 1), (None, None, None, None, None), (2, text(8, 40), None, None, 1), (2, text(7, 40), "en", "a", 1)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)

"""Stages of the pipeline against brute force on the fixtures, and the whole pipeline where no row has a language."""

import corpus_pipeline
import pytest

from . import fixtures
from .test_texts import brute_near


def unlabelled():
    return [(i, t, None, s, n) for i, t, _, s, n in fixtures.odd_rows()]


def with_letters(rows):
    return [r for r in rows if any(c.isalpha() for c in r[1] or "")]


def first_of_equals(rows):
    best = {}
    for r in sorted(rows, key=lambda r: r[0]):
        best.setdefault(r[1] or "", r)
    return list(best.values())


def least_of_near(rows):
    stay = {i for i, _, _, kept in brute_near([r[:2] for r in rows], 5, 80) if kept}
    return [r for r in rows if r[0] in stay]


@pytest.mark.parametrize("stage, brute", [("language_id", with_letters), ("exact", first_of_equals), ("near", least_of_near)])
def test_stage(spark, stage, brute):
    rows = unlabelled()
    found = getattr(corpus_pipeline, stage)(spark, spark.createDataFrame(rows, fixtures.DOCS), "")
    assert found.columns == corpus_pipeline.COLUMNS
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute(rows))
    assert getattr(corpus_pipeline, stage)(spark, fixtures.empty(spark), "").count() == 0


def test_run_without_languages(spark, tmp_path):
    spark.createDataFrame(unlabelled(), fixtures.DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    stay = {r[0] for r in least_of_near(first_of_equals(with_letters(unlabelled())))}
    found = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found and found <= stay

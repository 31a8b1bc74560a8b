"""The index of substrings finds what a scan finds, and reads little."""

import random

import numpy as np
import pytest
from lorekeep.functions.lines import keyword_match, keywords
from lorekeep.operators import text_index
from pyspark.sql import functions as F

TEXTS = "entry_id long, text string"


def scanned(spark, rows, asked):
    texts, queries = spark.createDataFrame(rows, TEXTS), spark.createDataFrame(asked, "query_id long, query string")
    both = queries.select("query_id", keywords(F.col("query")).alias("words"), F.lit(0).alias("any")).join(texts.withColumn("any", F.lit(0)), "any")
    both = both.where(F.size("words") > 0)  # others filter nothing
    return sorted(tuple(r) for r in both.where(keyword_match(F.col("words"), F.col("text"))).select("query_id", "entry_id").collect())


def test_what_a_scan_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "FEW", 40)  # both kinds of containers
    rng = random.Random(2)
    syllables = ["ab", "ra", "ca", "da", "Bra", "xyz", "_1.", "é", "ß", "漢字", "İ", " ", "  ", "\n", "-"]
    rows = [(i, "".join(rng.choice(syllables) for _ in range(rng.randrange(60)))) for i in range(700)] + [(700, None), (701, ""), (5, "again abraca"), (702, "abraca" * 30_000)]
    asked = [(i, "".join(rng.choice(syllables[:7] + [" "]) for _ in range(rng.randrange(1, 9)))) for i in range(40)] + [(100, "abra abra"), (101, "abra"), (102, "zzz abra"), (103, "of a"), (104, ""), (105, "ABRACA, dabra!")]
    path = str(tmp_path / "index")
    for batch, part in (("a", rows[:300]), ("b", rows[300:]), ("a", rows[:300])):  # the first one again
        text_index.append(spark.createDataFrame(part, TEXTS).repartition(3), path, batch)
    queries = spark.createDataFrame(asked, "query_id long, query string")
    assert sorted(tuple(r) for r in text_index.matches(queries, path).collect()) == scanned(spark, rows, asked)


def test_few_texts_are_read(spark, sf_dir, tmp_path):
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("entry_id"), "text"), str(tmp_path / "index")
    text_index.append(docs, path)
    words = [w for r in docs.orderBy(F.desc("entry_id")).limit(10).collect() for w in (r.text or "").split()[3:5]]
    queries = spark.createDataFrame([(i, f"{a} {b}") for i, (a, b) in enumerate(zip(words[::2], words[1::2], strict=False))], "query_id long, query string")
    read, found = text_index.candidates(queries, path).count(), text_index.matches(queries, path).count()
    pairs = docs.count() * queries.where(F.size(keywords(F.col("query"))) > 0).count()
    assert found <= read <= max(1.5 * found, 0.2 * pairs)


@pytest.mark.parametrize("many", [0, 1, 2_047, 2_048, 1 << 15])
def test_containers(many):
    places = np.random.default_rng(many).choice(1 << 15, many, replace=False)
    assert np.flatnonzero(text_index.unpacked(text_index.packed(places))).tolist() == sorted(places.tolist())

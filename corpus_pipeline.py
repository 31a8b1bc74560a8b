"""From documents to packed training sequences, in five stages; each is written as Parquet and read again by the next.

All stages but the last return the columns of documents. Null doc_ids and repeated ones are rows of their own throughout;
columns other than those of documents are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import kept, lean, numbered, read_table
from lorekeep.llm.exact_dedup import exact_dedup
from lorekeep.llm.language_id import UNKNOWN, grams, identify, train
from lorekeep.llm.mixing import WORD, mix
from lorekeep.llm.near_dedup import near_duplicates
from lorekeep.llm.packing import pack_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents none of whose languages has this share are rejected, and those without letters.
LEAST_SHARE = 0.5


@lean
def _with_letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[[len(grams(text)[0]) > 0 for text in batch["text"]]]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those without a leading language; learns from all labelled rows.
    Where no row is labelled there is nothing to learn from, and all documents with letters stay."""
    docs = docs.select(*COLUMNS)
    langs, logs = train(docs)
    if not langs:
        return docs.mapInPandas(_with_letters, docs.schema)
    return identify(docs, langs, logs, COLUMNS).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    rows = numbered(docs.select(*COLUMNS))
    stay = exact_dedup(rows.select("row", "text"), keep="smallest", id_col="row").where("kept").select(F.col("doc_id").alias("row"))
    return rows.join(stay, "row", "left_semi").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on shingles of five words, that with the smallest doc_id stays."""
    rows = numbered(docs.select(*COLUMNS))
    stay = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), words=5, percent=80).where("kept").select(F.col("doc_id").alias("row"))
    return rows.join(stay, "row", "left_semi").select(*COLUMNS)


@lean
def _first_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        cut = []
        for text, n in zip(batch["text"], batch["taken"], strict=True):
            ends = [m.end() for _, m in zip(range(n), re.finditer(WORD, text), strict=False)]
            cut.append(text[: ends[-1]])
        yield batch[COLUMNS].assign(text=cut, n_chars=[len(t) for t in cut])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them. The document at which a source's quota is reached (one a source and
    epoch) is cut to its words within the quota."""
    rows = numbered(docs.select(*COLUMNS))
    draws, _ = mix(rows.select(F.col("row").alias("doc_id"), "source", "text"))
    drawn = draws.where("taken > 0").groupBy(F.col("doc_id").alias("row")).agg(F.collect_list(F.struct("taken", "size")).alias("draws"))
    rows = rows.join(drawn, "row").select(*COLUMNS, F.explode("draws").alias("draw")).select(*COLUMNS, "draw.taken", "draw.size")
    rows = kept(rows, "mix")
    return rows.where("taken = size").select(*COLUMNS).unionByName(rows.where("taken < size").select(*COLUMNS, "taken").mapInPandas(_first_words, docs.select(*COLUMNS).schema))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences of at most 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0)


STAGES = [("language ID", language_id), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing", mixing), ("best-fit packing", packing)]

#: Languages, signatures, draws and packing are not expressible in SQL; see tests/llm/test_pipeline.py for the brute-force
#: versions of the first three stages, and test_records.py and test_texts.py for the mix and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept(docs, f"stage-{k}")
    return docs

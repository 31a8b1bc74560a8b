"""An index of substrings: trigram posting lists that are intersected, so that a keyword filter reads few texts.

Texts get numbers in the order in which they are stored, and lie in buckets of 2^15 of them. For each trigram of the lower-case
text and each bucket there is one container of places: 16-bit numbers where they are few, a bitmap of 4 kB where they are
many. A word that is a substring of a text has all its trigrams there, so the texts of a query are among those in which enough of
its words have all of theirs; these are read and compared as the scan compares them. Results are those of the scan.

Batches are appended and replace themselves when they are written again. A container, and what a task intersects for a query and
bucket, are bounded by the bucket and the query's words. Words of less than three characters are no keywords (lines.keywords).
Null texts hold no word. A query without keywords filters nothing: it has no rows here, and its caller shows the feed as it is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lines import keyword_match, keywords

BUCKET_BITS = 15
#: Places of a container up to which they are stored as numbers: shorter than a bitmap.
FEW = 2_047


@F.pandas_udf(T.ArrayType(T.LongType()))
def trigrams(text: pd.Series) -> pd.Series:
    """The distinct trigrams of each text, as numbers."""

    def one(t: str) -> np.ndarray:
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) > 2 else np.zeros(0, dtype=np.int64)

    return text.map(one, na_action="ignore")


def packed(places: np.ndarray) -> bytes:
    if len(places) <= FEW:
        return np.sort(places).astype(np.uint16).tobytes()
    found = np.zeros(1 << BUCKET_BITS, dtype=np.uint8)
    found[places] = 1
    return np.packbits(found).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """One byte a place: whether it is there."""
    if len(data) == 1 << BUCKET_BITS - 3:
        return np.unpackbits(np.frombuffer(data, dtype=np.uint8))
    found = np.zeros(1 << BUCKET_BITS, dtype=np.uint8)
    found[np.frombuffer(data, dtype=np.uint16)] = 1
    return found


@F.pandas_udf(T.BinaryType())
def _container(places: pd.Series) -> pd.Series:
    return places.map(lambda p: packed(np.asarray(p, dtype=np.int64)))


def append(texts: DataFrame, path: str, batch: str = "0") -> None:
    """Stores a batch under its name. texts: entry_id, text."""
    spark = texts.sparkSession
    once = lambda rows, name: rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")
    once(texts.select(F.monotonically_increasing_id().alias("number"), "entry_id", "text"), "texts")
    rows = spark.read.parquet(f"{path}/texts").where(F.col("batch") == batch)
    grams = rows.select("number", F.explode(trigrams(F.lower("text"))).alias("gram"))
    bucket, place = F.shiftright("number", BUCKET_BITS), F.col("number").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))
    lists = grams.select("gram", bucket.alias("bucket"), place.cast("int").alias("place")).groupBy("gram", "bucket").agg(F.collect_list("place").alias("places"))
    held = lists.select("gram", "bucket", _container("places").alias("places"))
    once(held.repartitionByRange("gram", "bucket").sortWithinPartitions("gram", "bucket"), "postings")  # so that a filter on grams prunes


_CANDIDATES = "query_id long, batch string, number long"


def _intersected(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a query and a bucket: the texts in which enough words have all their trigrams."""
    enough = min(2, int(rows["words"].iloc[0]))
    total = np.zeros(1 << BUCKET_BITS, dtype=np.int32)
    for _, own in rows.groupby("word"):
        if len(own) == own["grams"].iloc[0]:
            every = unpacked(own["places"].iloc[0]).copy()
            for data in own["places"].iloc[1:]:
                every &= unpacked(data)
            total += every.astype(np.int32) * int(own["times"].iloc[0])
    at = np.flatnonzero(total >= enough)
    return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "batch": rows["batch"].iloc[0], "number": (int(rows["bucket"].iloc[0]) << BUCKET_BITS) + at})


def candidates(queries: DataFrame, path: str) -> DataFrame:
    """query_id, batch, number of the texts that are to be read. queries: query_id, query, with a keyword."""
    words = queries.select(F.col("query_id").cast("long").alias("query_id"), keywords(F.col("query")).alias("all")).where(F.size("all") > 0)
    words = words.select("query_id", F.size("all").alias("words"), F.explode("all").alias("word")).groupBy("query_id", "words", "word").agg(F.count("*").alias("times"))
    words = words.withColumn("gram_list", trigrams("word"))
    asked = words.select("query_id", "words", "word", "times", F.size("gram_list").alias("grams"), F.explode("gram_list").alias("gram"))
    postings = queries.sparkSession.read.parquet(f"{path}/postings")
    found = asked.join(postings.withColumn("batch", F.col("batch").cast("string")), "gram")  # folders' names may read as numbers
    return found.groupBy("query_id", "batch", "bucket").applyInPandas(_intersected, _CANDIDATES)


def matches(queries: DataFrame, path: str) -> DataFrame:
    """query_id, entry_id of the texts in which at least two of a query's keywords (all, if there are fewer) are substrings."""
    texts = queries.sparkSession.read.parquet(f"{path}/texts").withColumn("batch", F.col("batch").cast("string"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), keywords(F.col("query")).alias("words"))
    read = candidates(queries, path).join(texts, ["batch", "number"]).join(asked, "query_id")
    return read.where(keyword_match(F.col("words"), F.col("text"))).select("query_id", "entry_id")

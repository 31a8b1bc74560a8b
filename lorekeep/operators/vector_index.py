"""A stored index for nearest neighbours by cosine: an inverted file of residual codes, grown by appending.

Entries are unit vectors. Cells are the clusters of a bounded sample (FIT_ROWS rows, fitted once by Spark's KMeans); every entry goes
to the nearest one. What is stored of it are a code, a byte a component of its distance from the cell's centre with one scale
a row, and beside it the exact vector, in a table of its own; both lie in the order of cells, so a filter on cells prunes row
groups. A batch of entries is appended without touching what is there, and a batch that is written again under its name replaces
itself.

A probe reads the codes of the cells that are nearest to each query, keeps the most promising RESCORED * k, reads these entries'
exact vectors, and returns the k best by exact cosine. So every score is exact; what can be missed are neighbours in cells that were
not read. How many cells a probe reads is measured, too: for AUDITED entries the true neighbours are searched in all entries, and so
many cells are read as hold TARGET of them (`tune`; the number is stored, and can be measured again once the index has grown). Large cells are dealt into blocks and queries of one cell into parts,
so that a task meets a bounded number of both. What is broadcast are a row a cell, at most MOST_CELLS.

Entries without a vector, with null or non-finite components, of another length than the index's, or zero, are left out, and so are such
queries. Repeated entry_ids are entries of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import cosine, semantic_hits

FIT_ROWS, MOST_CELLS, CENTRE_BYTES = 100_000, 4_096, 32 << 20
RESCORED = 4
#: Entries whose true neighbours are looked up to see how many cells a probe must read, and the share of neighbours it is to find.
AUDITED, NEIGHBOURS, TARGET = 256, 5, 0.98
BLOCK, PART = 8_192, 1_024


def _sound(vec: Column) -> Column:
    whole = ~F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(vec, lambda v: v != 0)
    return vec.isNotNull() & F.coalesce(whole, F.lit(False))


def _matrix(vecs: pd.Series) -> np.ndarray:
    found = np.stack(vecs.to_numpy()).astype(np.float64)
    found /= np.abs(found).max(axis=1, keepdims=True)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def create(entries: DataFrame, path: str, batch: str = "0") -> None:
    """Fits the cells and stores the first batch. entries: entry_id, vec; the length of most vectors is the index's."""
    rows = entries.select("entry_id", F.col("vec").cast("array<double>").alias("vec")).where(_sound(F.col("vec")))
    sizes = rows.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    spark = entries.sparkSession
    if not sizes:
        spark.createDataFrame([], "cell int, center array<double>").write.parquet(f"{path}/centres")
        return
    dims, many = sizes[0]["dims"], sizes[0]["count"]
    cells = max(1, min(MOST_CELLS, CENTRE_BYTES // (8 * dims), int(np.ceil(np.sqrt(many)))))
    own = rows.where(F.size("vec") == dims)
    share = F.pmod(F.xxhash64("entry_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = own.where(share < F.lit(min(1.0, FIT_ROWS / many))).select(array_to_vector("vec").alias("features"))
    fitted = KMeans(k=cells, distanceMeasure="cosine", seed=7, maxIter=12).fit(sample) if cells > 1 else None
    centres = [np.asarray(c) for c in fitted.clusterCenters()] if fitted else [np.full(dims, dims**-0.5)]
    spark.createDataFrame([(i, (c / (np.linalg.norm(c) or 1)).tolist()) for i, c in enumerate(centres)], "cell int, center array<double>").coalesce(1).write.parquet(f"{path}/centres")
    append(entries, path, batch)
    tune(own, path)


def tune(entries: DataFrame, path: str, k: int = NEIGHBOURS, target: float = TARGET) -> int:
    """Stores and returns the number of cells that a probe reads, by the true neighbours of a sample. entries: all that the index holds."""
    spark, centres = entries.sparkSession, _centres(entries.sparkSession, path)
    rows = entries.select(F.col("entry_id").cast("long").alias("entry_id"), F.col("vec").cast("array<double>").alias("vec")).where(_sound(F.col("vec")) & (F.size("vec") == centres.shape[1]))
    sample = rows.orderBy(F.xxhash64("entry_id"), "entry_id").limit(AUDITED).collect()
    asked = spark.createDataFrame([(r["entry_id"], r["vec"]) for r in sample], "query_id long, vec array<double>")
    true = semantic_hits(asked, rows, -1.0, k + 1).where("query_id <> entry_id").select("query_id", "entry_id")

    @F.pandas_udf("int")
    def place(vec: pd.Series, cell: pd.Series) -> pd.Series:
        near = _matrix(vec) @ centres.T
        return pd.Series((near > near[np.arange(len(near)), cell.to_numpy()][:, None]).sum(axis=1) + 1)

    held = true.join(spark.read.parquet(f"{path}/codes").select("entry_id", "cell"), "entry_id").join(asked, "query_id")
    places = sorted(r["place"] for r in held.select(place("vec", "cell").alias("place")).collect())  # k for each of AUDITED
    probes = places[min(len(places) - 1, int(target * len(places)))] if places else 1
    spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")
    return probes


def _probes(spark: SparkSession, path: str, probes: int | None) -> int:
    return probes or spark.read.parquet(f"{path}/probes").first()["probes"]


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["cell"])
    return np.array([r["center"] for r in rows], dtype=np.float64)


def append(entries: DataFrame, path: str, batch: str) -> None:
    """Stores a batch under its name."""
    centres = _centres(entries.sparkSession, path)
    if not len(centres):
        raise ValueError("an index without entries has no cells")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = _matrix(rows["vec"])
            cell = np.argmax(x @ centres.T, axis=1)
            rest = x - centres[cell]
            scale = np.abs(rest).max(axis=1) / 127
            code = np.rint(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "entry_id": rows["entry_id"], "scale": scale, "code": [c.tobytes() for c in code], "vec": rows["vec"]})

    rows = entries.select(F.col("entry_id").cast("long").alias("entry_id"), F.col("vec").cast("array<double>").alias("vec")).where(_sound(F.col("vec")) & (F.size("vec") == centres.shape[1]))
    coded = rows.mapInPandas(run, "cell int, entry_id long, scale double, code binary, vec array<double>")
    placed = coded.repartitionByRange("cell", "entry_id").sortWithinPartitions("cell", "entry_id").withColumn("batch", F.lit(batch))
    for name, columns in (("codes", ["cell", "entry_id", "scale", "code"]), ("exact", ["cell", "entry_id", "vec"])):
        placed.select(*columns, "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")


def _nearest_cells(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """query_id, vec, cell: each query with the cells that it reads."""
    m = min(probes, len(centres))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            near = np.argpartition(-(_matrix(rows["vec"]) @ centres.T), m - 1, axis=1)[:, :m]
            yield pd.DataFrame({"query_id": np.repeat(rows["query_id"].to_numpy(), m), "vec": rows["vec"].repeat(m), "cell": near.ravel().astype(np.int32)})

    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec")).where(_sound(F.col("vec")) & (F.size("vec") == centres.shape[1]))
    return rows.mapInPandas(run, "query_id long, vec array<double>, cell int")


def _promising(centres: np.ndarray, most: int):
    def run(asked: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(codes):
            return pd.DataFrame(columns=["query_id", "cell", "entry_id", "about"], dtype=object)
        cell = int(codes["cell"].iloc[0])
        code = np.frombuffer(b"".join(codes["code"]), dtype=np.int8).reshape(len(codes), -1)
        q = _matrix(asked["vec"])
        about = (q @ centres[cell])[:, None] + (q.astype(np.float32) @ code.T.astype(np.float32)) * codes["scale"].to_numpy()
        m = min(most, len(codes))
        best = np.argpartition(-about, m - 1, axis=1)[:, :m]
        return pd.DataFrame({"query_id": np.repeat(asked["query_id"].to_numpy(), m), "cell": cell, "entry_id": codes["entry_id"].to_numpy()[best.ravel()], "about": np.take_along_axis(about, best, axis=1).ravel()})

    return run


def probe(queries: DataFrame, path: str, k: int = NEIGHBOURS, probes: int | None = None, least: float = -1.0) -> DataFrame:
    """query_id, entry_id, score (exact cosine, least or more), rank of the k best that were found. queries: query_id, vec."""
    spark = queries.sparkSession
    centres = _centres(spark, path)
    if not len(centres):
        return spark.createDataFrame([], "query_id long, entry_id long, score double, rank int")
    asked = _nearest_cells(queries, centres, _probes(spark, path, probes))
    codes = spark.read.parquet(f"{path}/codes").select("cell", "entry_id", "scale", "code")
    # Entries and queries of a cell, counted; a row a cell.
    entries_of = codes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = F.broadcast(entries_of.join(asked.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "cell"))
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda what, n: F.pmod(F.xxhash64(what), F.col(n)).cast("int")
    left = asked.join(dealt, "cell").select("query_id", "vec", "cell", deal("query_id", "parts").alias("part"), up_to("blocks").alias("block"))
    right = codes.join(dealt, "cell").select("cell", "entry_id", "scale", "code", deal("entry_id", "blocks").alias("block"), up_to("parts").alias("part"))
    key = ["cell", "block", "part"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_promising(centres, RESCORED * k), "query_id long, cell int, entry_id long, about double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("about"), "entry_id"))
    near = near.withColumn("at", best).where(f"at <= {RESCORED * k}").select("query_id", "cell", "entry_id").distinct()
    exact = spark.read.parquet(f"{path}/exact").select("cell", "entry_id", F.col("vec").alias("entry_vec"))
    asked_once = queries.select(F.col("query_id").cast("long").alias("query_id"), "vec")
    scored = near.join(exact, ["cell", "entry_id"]).join(asked_once, "query_id").select("query_id", "entry_id", cosine(F.col("vec"), F.col("entry_vec")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "entry_id"))
    return scored.where(F.col("score") >= least).withColumn("rank", rank).where(f"rank <= {k}")


def bytes_read(queries: DataFrame, path: str, probes: int | None = None) -> DataFrame:
    """One row: code_bytes that a probe reads (of each cell once, however many queries ask for it), all_bytes of exact vectors."""
    spark = queries.sparkSession
    centres = _centres(spark, path)
    asked = _nearest_cells(queries, centres, _probes(spark, path, probes)).select("cell").distinct().withColumn("read", F.lit(True))
    rows = spark.read.parquet(f"{path}/codes").join(asked, "cell", "left")
    size = F.when(F.col("read"), F.octet_length("code") + 8)
    return rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("code_bytes"), (F.count("*") * centres.shape[1] * 8).alias("all_bytes"))


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of true (query_id, entry_id) that was found."""
    both = true.select("query_id", "entry_id").distinct()
    many = both.count()
    return both.join(found, ["query_id", "entry_id"], "left_semi").count() / many if many else 1.0

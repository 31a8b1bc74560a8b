"""Exact top-k search by inner product with vector-approximation files.

Components are whole numbers. Rows with equal vectors are one class; of a class only its k + 1 rows that come first can be in a
result, so no more of them are looked at, however many copies there are.

1. File. Classes are dealt into slices. Of each dimension of a slice the values are parted into CELLS cells with about
   as many values; a slice's approximation holds a byte a component, and the lowest and the highest value of each cell.
2. Scan. Each group of distinct query vectors meets each slice: one product with the middles of the cells and one with
   their widths bound every score from below and above. A slice hands on what can be among the k + 1 best of the
   slice; of that, what can be among those of all slices remains.
3. Read. Exact vectors are read in the order of their bounds, the most promising first, READ of them, then as many again as
   have been read, until the last of the k + 1 best is certain: no vector that was not read has a bound as good as it. The
   table of candidates is written before, each round's result after; a round reads for queries that are still open.

A row is asked for as a query or not, and is no candidate of its own: k + 1 results with itself are k without. Order: higher
scores first, then smaller vec_id, null last. Results are exact at every size; nothing is capped, and a query for which bounds
say little (a zero vector, of which all scores tie) reads on until it is certain.

Cases: vectors that are null or hold null or non-finite components take no part; those of another length than the query's are no
candidates of it; an empty vector scores 0 with other empty ones; a query with fewer candidates than k has all of them; rows that
repeat a vec_id are rows of their own, candidates of each other; a null vec_id is never asked for, but can be found. Numbers are
held to +-MOST, so that sums stay whole. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, kept, read_table

TOP = 20
SCALE = 64
MOST = 1 << 24
CELLS = 64
#: Classes of a slice and query vectors of a group, on average.
SLICE, GROUP = 8_192, 512
#: Exact vectors that a query reads at first.
READ = 32
#: Parts that a large class is first looked at in.
SALTS = 32

_LAST = (1 << 63) - 1


def whole_numbers(vector: Column, scale: int, most: int = MOST) -> Column:
    """Each component times scale, rounded down; null for vectors that are null or hold null or non-finite components."""
    sound = vector.isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(sound, F.transform(vector, lambda v: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(v.cast("double") * scale))).cast("long")))


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """c, dims, vec, asked, least (the first key), members (the first k + 1 rows: key, row, vec_id). rows: row, vec_id, vec, name, asked."""
    first = rows.select("name", F.coalesce("vec_id", F.lit(_LAST)).alias("key"), "row", "vec_id", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    for by in (["name", "salt"], ["name"]):  # a class of any size passes k + 1 rows a task and part
        first = first.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("key", "row"))).where(f"at <= {k + 1}")
    members = first.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("key", "row", "vec_id"))).alias("members"))
    found = rows.groupBy("name").agg(F.first("vec").alias("vec"), F.max("asked").alias("asked")).join(members, "name")
    return found.select(F.monotonically_increasing_id().alias("c"), "name", F.size("vec").alias("dims"), "vec", "asked", F.col("members")[0]["key"].alias("least"), "members")


def approximated(rows: pd.DataFrame) -> pd.DataFrame:
    """A slice: its classes by their first key, a cell a component, and the values that cells are bounded by."""
    rows = rows.sort_values(["least", "c"])
    x = np.stack(rows["vec"].to_numpy()).astype(np.int64).reshape(len(rows), -1)
    n, d = x.shape
    codes, bounds = np.zeros((n, d), dtype=np.uint8), np.zeros((2, d, CELLS), dtype=np.int64)
    for i in range(d):
        column = np.sort(x[:, i])
        cuts = np.unique(column[np.arange(1, CELLS) * n // CELLS])
        codes[:, i] = np.searchsorted(cuts, x[:, i], side="right")
        begun = np.concatenate([[0], np.searchsorted(column, cuts)])
        cell = np.minimum(np.arange(CELLS), len(cuts))
        bounds[0, i] = column[np.minimum(begun, n - 1)][cell]
        bounds[1, i] = column[np.concatenate([begun[1:], [n]])[cell] - 1]
    return pd.DataFrame({"dims": [d], "slice": rows["slice"].iloc[:1].to_numpy(), "ids": [rows["c"].to_numpy()], "least": [rows["least"].to_numpy()], "cells": [codes.tobytes()], "bounds": [bounds.tobytes()]})


def bounded(queries: np.ndarray, cells: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the lowest and twice the highest inner product that a query can have with a vector in these cells."""
    d = queries.shape[1]
    low, high = (b[np.arange(d), cells] for b in bounds)
    largest = 2 * max(d, 1) * int(np.abs(queries).max(initial=1)) * 2 * int(np.abs(bounds).max(initial=1))
    kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64  # sums are whole in each
    middle = queries.astype(kind) @ (low + high).astype(kind).T
    width = np.abs(queries).astype(kind) @ (high - low).astype(kind).T
    return middle - width, middle + width


def promising(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """What can be among the k of a row with the highest scores, earlier columns first where scores tie."""
    n = low.shape[1]
    if n <= k:
        return np.ones(low.shape, dtype=bool)
    kth = np.partition(low, n - k, axis=1)[:, n - k, None]
    tied = low == kth
    needed = k - (low > kth).sum(axis=1, keepdims=True)
    last = np.argmax(tied & (np.cumsum(tied, axis=1, dtype=np.int32) == needed), axis=1)
    return (high > kth) | ((high == kth) & (np.arange(n) <= last[:, None]))


_HANDED = "q long, ids array<long>, low array<long>, high array<long>, least array<long>"


def _scan(k: int):
    def run(asked: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(part):
            return pd.DataFrame(columns=["q", "ids", "low", "high", "least"], dtype=object)
        d = int(part["dims"].iloc[0])
        queries = np.frombuffer(asked["vecs"].iloc[0], dtype=np.int64).reshape(-1, d) if d else np.zeros((len(asked["ids"].iloc[0]), 0), np.int64)
        ids, least = (np.asarray(part[x].iloc[0], dtype=np.int64) for x in ("ids", "least"))
        cells = np.frombuffer(part["cells"].iloc[0], dtype=np.uint8).reshape(len(ids), -1)
        low, high = bounded(queries, cells, np.frombuffer(part["bounds"].iloc[0], dtype=np.int64).reshape(2, d, CELLS))
        q, v = np.nonzero(promising(low, high, k))
        cut = np.searchsorted(q, np.arange(1, len(queries)))
        columns = [ids[v], low[q, v].astype(np.int64), high[q, v].astype(np.int64), least[v]]
        return pd.DataFrame({"q": np.asarray(asked["ids"].iloc[0]), **dict(zip(("ids", "low", "high", "least"), (np.split(x, cut) for x in columns), strict=True))})

    return run


def _grouped(rows: pd.DataFrame) -> pd.DataFrame:
    vecs = np.stack(rows["vec"].to_numpy()).astype(np.int64)
    return pd.DataFrame({"dims": rows["dims"].iloc[:1].to_numpy(), "part": rows["part"].iloc[:1].to_numpy(), "ids": [rows["c"].to_numpy()], "vecs": [vecs.tobytes()]})


def _candidates(classes: DataFrame, k: int) -> DataFrame:
    """q, c, high (twice the bound), least, place: what can be among the k best of each query class, the most promising first."""
    sizes = classes.groupBy("dims").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"), F.ceil(F.greatest(F.sum(F.col("asked").cast("int")), F.lit(1)) / GROUP).cast("int").alias("groups"))
    sizes = F.broadcast(kept(sizes, "lengths"))  # a row for each length that vectors have
    dealt = classes.join(sizes, "dims")
    own = dealt.select("c", "dims", "vec", "least", F.pmod(F.xxhash64("c"), F.col("slices")).cast("int").alias("slice"))
    file = kept(own.groupBy("dims", "slice").applyInPandas(approximated, "dims int, slice int, ids array<long>, least array<long>, cells binary, bounds binary"), "approximations")
    asked = dealt.where("asked").select("c", "dims", "vec", F.pmod(F.xxhash64("c"), F.col("groups")).cast("int").alias("part"))
    asked = kept(asked.groupBy("dims", "part").applyInPandas(_grouped, "dims int, part int, ids array<long>, vecs binary"), "query-groups")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    file_tiles = file.join(sizes, "dims").select(*file.columns, up_to("groups").alias("part"))
    asked_tiles = asked.join(sizes, "dims").select(*asked.columns, up_to("slices").alias("slice"))
    tile = ["dims", "part", "slice"]
    scanned = kept(asked_tiles.groupBy(*tile).cogroup(file_tiles.groupBy(*tile)).applyInPandas(_scan(k), _HANDED), "scanned")
    bounds = scanned.select("q", F.inline(F.arrays_zip(F.col("ids").alias("c"), "low", "high", "least")))
    own = Window.partitionBy("q")
    kth = bounds.withColumn("at", F.row_number().over(own.orderBy(F.desc("low"), "least", "c"))).where(f"at <= {k}").where(f"at = {k}")
    kth = kth.select("q", F.col("low").alias("kth"), F.col("least").alias("kth_least"))
    can = F.col("kth").isNull() | (F.col("high") > F.col("kth")) | ((F.col("high") == F.col("kth")) & (F.col("least") <= F.col("kth_least")))
    place = (F.row_number().over(own.orderBy(F.desc("high"), "least", "c")) - 1).cast("long").alias("place")
    found = kept(bounds.join(kth, "q", "left").where(can).select("q", "c", "high", "least", place), "candidates")
    for x in (file, asked, scanned):
        dropped(x)
    return found


def _read(candidates: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """q, score, key, row, vec_id, at: the k best rows of each query class, exactly."""
    exact = classes.select("c", "vec", "members")
    product = F.aggregate(F.zip_with("vec", "asked_vec", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    best, done, still, begun, end = None, None, None, 0, READ
    while True:
        part = candidates.where(f"place >= {begun} AND place < {end}")
        part = part if still is None else part.join(still, "q", "left_semi")
        read = part.select("q", "c").join(exact, "c").join(classes.select(F.col("c").alias("q"), F.col("vec").alias("asked_vec")), "q")
        read = read.select("q", product.alias("score"), F.explode("members").alias("m")).select("q", "score", "m.key", "m.row", "m.vec_id")
        if best is not None:
            read = read.unionByName(best.join(still, "q", "left_semi").drop("at"))
        at = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key", "row"))
        best = kept(read.withColumn("at", at).where(f"at <= {k}"), "best")
        kth = best.where(f"at = {k}").select("q", "score", "key")
        next_best = candidates.where(f"place = {end}").select("q", "high", "least")
        next_best = next_best if still is None else next_best.join(still, "q", "left_semi")
        open_yet = F.col("score").isNull() | (F.col("high") > 2 * F.col("score")) | ((F.col("high") == 2 * F.col("score")) & (F.col("least") <= F.col("key")))
        still = kept(next_best.join(kth, "q", "left").where(open_yet).select("q"), "open")
        if not still.limit(1).count():
            return best if done is None else done.unionByName(best)
        closed = best.join(still, "q", "left_anti")
        done = closed if done is None else done.unionByName(closed)
        begun, end = end, 2 * end


def exact_top_k(rows: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row that is asked for, the k other rows with the highest inner products.
    rows: vec_id long, vec array<long> (null: takes no part), asked boolean."""
    rows = rows.where("vec IS NOT NULL").select("vec_id", "vec", F.coalesce(F.col("asked") & F.col("vec_id").isNotNull(), F.lit(False)).alias("asked"))
    rows = kept(rows.select(F.monotonically_increasing_id().alias("row"), "*", F.sha2(F.concat_ws(",", "vec"), 256).alias("name")), "vectors")
    classes = kept(_classes(rows, k), "vector-classes")
    candidates = _candidates(classes, k + 1)
    best = _read(candidates, classes, k + 1)
    lists = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "key", "row", "vec_id"))).alias("best"))
    lists = lists.join(classes.select(F.col("c").alias("q"), "name"), "q").select("name", "best")
    others = F.slice(F.filter("best", lambda m: m["row"] != F.col("row")), 1, k)
    found = rows.where("asked").join(lists, "name").select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "m"))
    return found.select("query_id", (F.col("at") + 1).alias("rank"), F.col("m.vec_id").alias("vec_id"), (-F.col("m.less")).alias("score"))


def op11_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 other vectors with the highest inner products, for vectors whose vec_id is divisible by 20."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding"), SCALE).alias("vec"))
    return exact_top_k(rows.withColumn("asked", F.col("vec_id") % 20 == 0))


OP11_SQL = """
WITH sound AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM sound q JOIN sound c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

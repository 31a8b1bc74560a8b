"""Mixing sources to target weights by a splitting tree of multivariate hypergeometric draws.

Each source's words are dealt into blocks of documents by hash, and a source's target is a quota of blocks in a seeded
order. From the root down, a node's vector of block quotas (one count a source) is split between its two halves of the
output shards by a multivariate hypergeometric draw, so every shard gets a random, exact share of what remains. A shard
then draws its blocks, disjoint stretches of each source's permuted blocks, and shuffles their documents locally. Where
a target exceeds a source, the blocks are permuted anew for a second epoch. The last block of a quota is taken up to
the word: at most one document of a source and epoch is cut, all others are taken whole.

Sources are a matter of configuration (each has a weight), so a vector has a row a source; documents are only ever
joined and summed by (source, block), in two levels, so a source with a third of all rows is many blocks.

A null text has size 0 and is never taken; a null source is a source of its own, the last. Repeated doc_ids are rows of
their own. The same table gives the same mix. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, read_table

# Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is dealt into blocks of about this many words, and at most MOST_BLOCKS (blocks grow with the data then).
BLOCK_WORDS = 65_536
MOST_BLOCKS = 8_192
SHARDS = 16
SEED = 11


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source (source, source_size): weight and target. Targets are weight times one factor, none above cap times
    the size; the factor is such that they sum to total_share of all sizes (all caps, if those are less)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumns({"most": F.lit(cap) * F.col("source_size"), "ratio": F.lit(cap) * F.col("source_size") / F.col("weight")})
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # With the sources of smaller ratio at their caps, the others share what is left; the first for which that is within
    # its own cap gives the factor for itself and all after it.
    ranked = ranked.withColumns({"all": F.sum("source_size").over(everything) * F.lit(total_share), "capped": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "open": F.sum("weight").over(rest)})
    ranked = ranked.withColumn("factor", (F.col("all") - F.col("capped")) / F.col("open"))
    factor = F.first(F.when(F.col("factor") <= F.col("ratio"), F.col("factor")), ignorenulls=True).over(everything)
    return ranked.withColumn("target", F.least("most", F.coalesce(F.col("weight") * factor, "most"))).select("source", "source_size", "weight", "target")


def _split(counts: np.ndarray, first: int, shards: int, rng: np.random.Generator) -> list[tuple[int, np.ndarray]]:
    """Leaves of the tree under a node: (shard, blocks of each source)."""
    if shards == 1:
        return [(first, counts)]
    half = shards // 2
    left = rng.multivariate_hypergeometric(counts, int(counts.sum()) * half // shards, method="marginals") if len(counts) else counts
    return _split(left, first, half, rng) + _split(counts - left, first + half, shards - half, rng)


def _leaves(shards: int, seed: int) -> Callable:
    def run(vector: pd.DataFrame) -> pd.DataFrame:
        """vector: a row a source and epoch, with its quota of blocks; gives each shard's stretch of permuted places."""
        vector = vector.sort_values(["source", "epoch"], na_position="last").reset_index(drop=True)
        out, place = [], np.zeros(len(vector), dtype=np.int64)
        for shard, counts in _split(vector["blocks"].to_numpy(np.int64), 0, shards, np.random.default_rng(seed)):
            out.append(vector[["source", "epoch"]].assign(shard=shard, first=place, after=place + counts))
            place = place + counts
        return pd.concat(out)

    return run


def _hash01(*what) -> F.Column:
    return F.pmod(F.xxhash64(*what), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _with(left: DataFrame, right: DataFrame, *keys: str, where: F.Column | None = None, how: str = "inner") -> DataFrame:
    """A join on keys that may be null."""
    right = right.withColumnsRenamed({k: f"{k}_" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return left.join(right, on if where is None else [*on, where], how).drop(*(f"{k}_" for k in keys))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = 1.5, cap: float = 2.0, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(draws, targets). draws: a row for each document and epoch with doc_id, source, size, row, epoch, taken words (0
    where it is not drawn), shard and the place in it; targets: source, source_size, weight, target."""
    if not 0 < cap <= 2:
        raise ValueError("cap is over 0 and at most 2: a document is drawn at most twice")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("die"))
    # The die depends on identifier and text: rows without identifiers are spread too, and a rerun agrees. Rows alike in both are
    # told apart by a number that is written, and so stays.
    rows = kept(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    per_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total_share, cap)
    quota = F.round("target").cast("long")
    per_source = kept(per_source.withColumns({"quota": quota, "n_blocks": F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS))).cast("long")}), "targets")
    dealt = _with(rows, per_source.select("source", "n_blocks", "quota", "source_size"), "source")
    dealt = dealt.withColumn("block", F.floor(_hash01("die", F.lit(seed)) * F.col("n_blocks")).cast("int"))
    blocks = dealt.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"), F.first("source_size").alias("source_size"))
    blocks = blocks.withColumn("epoch", F.explode(F.array(F.lit(1), F.lit(2))))
    # Of each epoch: what of the quota it takes, and the order of its blocks (at most MOST_BLOCKS a source).
    wanted = F.when(F.col("epoch") == 1, F.least("quota", "source_size")).otherwise(F.greatest(F.col("quota") - F.col("source_size"), F.lit(0)))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("block", "epoch", F.lit(seed)), "block")
    placed = blocks.withColumns({"wanted": wanted, "place": F.row_number().over(order) - 1, "before": F.sum("words").over(order) - F.col("words")})
    placed = kept(placed.withColumn("left", F.greatest(F.lit(0), F.col("wanted") - F.col("before"))).select("source", "block", "epoch", "place", "left"), "blocks")
    vector = placed.groupBy("source", "epoch").agg(F.count_if(F.col("left") > 0).alias("blocks"))
    leaves = vector.groupBy().applyInPandas(_leaves(shards, seed), "source string, epoch int, shard int, first long, after long")
    inside = (F.col("place") >= F.col("first")) & (F.col("place") < F.col("after"))
    drawn = _with(placed, leaves, "source", "epoch", where=inside, how="left").drop("first", "after")
    both = _with(dealt, drawn, "source", "block").select("doc_id", "source", "size", "row", "die", "block", "epoch", "left", "shard")
    within = Window.partitionBy("source", "block", "epoch").orderBy(F.xxhash64("die", "epoch", F.lit(seed + 1)), "doc_id", "row")
    both = both.withColumn("at", F.sum("size").over(within) - F.col("size"))
    # What no leaf of the tree holds is not drawn.
    taken = F.when(F.col("shard").isNotNull(), F.least("size", F.greatest(F.lit(0), F.col("left") - F.col("at")))).otherwise(0)
    draws = both.select("doc_id", "source", "size", "row", "epoch", taken.alias("taken"), "shard", F.xxhash64("die", "epoch", F.lit(seed + 2)).alias("place_in_shard"))
    return draws, per_source


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws, per_source = mix(read_table(spark, sf_dir, "documents"))
    drawn = F.sort_array(F.collect_set(F.when(F.col("taken") > 0, F.col("shard"))))  # one an epoch
    taken = draws.groupBy("row", "doc_id", "source", "size").agg(F.sum("taken").alias("taken"), drawn.alias("shards"))
    return _with(taken, per_source.select("source", "source_size", "target"), "source").select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "shards")

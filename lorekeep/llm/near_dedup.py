"""Near-duplicate documents by b-bit MinHash.

A document is its set of word shingles. Of PERMUTATIONS minima, bands of ROWS make bucket keys, and the low BITS of each
minimum are packed into a signature. Documents with equal sets are one class, so that copies never meet in pairs. Pairs of
classes come from buckets; their similarity is first estimated from their signatures by counting equal low bits,
corrected for chance, and those that pass (with a margin of six standard deviations) are confirmed on their full sets.
Confirmed links make components; one document of each, that with the smallest identifier, is kept.

No bucket is expanded into all its pairs. First every member is compared with its bucket's smallest member, and what passes the
estimate makes families, what is confirmed makes components. Then, in buckets whose other members are of several families,
those of different families are compared too, by their signatures, and what passes joins their families. So any two
documents that share a bucket and pass the estimate are in one family. A family that is one component has nothing left to find. In
the others, all members outside the largest component are compared with the rest of the family. Both comparisons are made in
blocks of BLOCK members a side that are tasks of their own, and pass over pairs that are joined already; in families
the estimate comes first there too, then the full sets. So a link can be missed only if its documents share no bucket
(at a similarity of 0.8 with a chance of (1 - 0.8^ROWS)^BANDS = 5e-7) or by an estimate six standard deviations off.

Null and empty texts have empty sets and link with nothing. Rows that repeat a doc_id are documents of their own, each with
the set of its own text; component_id is the smallest doc_id of the documents reachable, and a row is kept if its doc_id
is that. Rows with a null doc_id link with nothing, have a null component_id and are kept. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, dropped, kept, lean, read_table
from .shingles import common, mixed, shingle_sets

BANDS, ROWS = 48, 6
PERMUTATIONS = BANDS * ROWS
#: Low bits of each minimum in a signature.
BITS = 4
#: Members of a side of a block.
BLOCK = 500
#: Tasks that the blocks of families are dealt to at most.
MOST_TASKS = 20_000
#: Rows of small buckets that one task compares at a time.
ROWS_AT_ONCE = 2_000
_rng = np.random.default_rng(88)
_XOR = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_TIMES = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_CHUNK = 1 << 15


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """[set, permutation], of sets that aren't empty."""
    out = np.empty((len(sets), PERMUTATIONS), dtype=np.uint32)
    a = 0
    while a < len(sets):
        b, size = a, 0
        while b < len(sets) and (b == a or size + len(sets[b]) <= _CHUNK):
            size += len(sets[b])
            b += 1
        x = np.concatenate(sets[a:b])
        x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[a : b - 1])])
        for p in range(PERMUTATIONS):
            out[a:b, p] = np.minimum.reduceat((x ^ _XOR[p]) * _TIMES[p], starts)
        a = b
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """Low BITS (4) of minima, two to a byte."""
    low = (low & np.uint32(15)).astype(np.uint8)
    return low[:, ::2] | (low[:, 1::2] << np.uint8(4))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (one against many, or row by row), corrected for equal low bits by chance."""
    x = np.bitwise_xor(a, b)
    x |= x >> np.uint8(1)
    x |= x >> np.uint8(2)
    equal = 1 - np.bitwise_count(x & np.uint8(0x11)).sum(axis=-1, dtype=np.int64) / PERMUTATIONS
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def floor_of(threshold: float) -> float:
    """Estimates below this are six standard deviations away from the threshold."""
    equal = threshold + (1 - threshold) * 2.0**-BITS
    return threshold - 6 * (equal * (1 - equal) / PERMUTATIONS) ** 0.5 / (1 - 2.0**-BITS)


def _signatures(k: int) -> Callable:
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2_000):
                part = batch.iloc[at : at + 2_000]
                sets = shingle_sets(part["text"].tolist(), k)
                some = [i for i, s in enumerate(sets) if len(s)]
                low = minima([sets[i] for i in some]) if some else np.zeros((0, PERMUTATIONS), np.uint32)
                keys = np.zeros((len(some), BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    keys = mixed(keys + low[:, r::ROWS].astype(np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                keys, signs = keys.view(np.int64), packed(low)
                bands: list = [None] * len(sets)
                sign: list = [None] * len(sets)
                name: list = [None] * len(sets)
                for row, i in enumerate(some):
                    bands[i], sign[i] = keys[row], signs[row].tobytes()
                    name[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "n_shingles": [len(s) for s in sets], "set_id": name, "bands": bands, "sign": sign})

    return run


def _passing(floor: float) -> Callable:
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                sides = [np.frombuffer(b"".join(batch[c]), dtype=np.uint8).reshape(len(batch), -1) for c in ("sign_a", "sign_b")]
                yield batch.loc[estimate(*sides) >= floor, ["a", "b"]]

    return run


def _blocks(k: int, percent: int, floor: float) -> Callable:
    """Links between different components among the pairs of a block: of its side 0 with its side 1, or within side 2."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        within = bool((rows["side"] == 2).any())
        sides = [rows, rows] if within else [rows[rows["side"] == s] for s in (0, 1)]
        signs = [np.frombuffer(b"".join(s["sign"]), dtype=np.uint8).reshape(len(s), -1) if len(s) else np.zeros((0, 1), np.uint8) for s in sides]
        nodes, labels = [s["node"].to_numpy() for s in sides], [s["label"].to_numpy().copy() for s in sides]
        labels[1] = labels[0] if within else labels[1]
        sets = [shingle_sets(s["text"].tolist(), k) for s in sides[: 1 if within else 2]]
        sets = [sets[0], sets[-1]]
        out = []
        for x in range(len(nodes[0])):
            other = labels[1] != labels[0][x]
            if within:
                other[: x + 1] = False
            other = np.flatnonzero(other)
            if not len(other):
                continue
            near = estimate(signs[0][x], signs[1][other])
            for y in other[near >= floor][np.argsort(-near[near >= floor], kind="stable")]:
                if labels[0][x] == labels[1][y]:
                    continue  # joined meanwhile
                n, m = len(sets[0][x]), len(sets[1][y])
                if 100 * min(n, m) < percent * max(n, m):
                    continue
                both = common(sets[0][x], sets[1][y])
                if 100 * both >= percent * (n + m - both):
                    out.append(sorted((int(nodes[0][x]), int(nodes[1][y]))))
                    old, new = labels[1][y], labels[0][x]
                    for side in labels[: 1 if within else 2]:
                        side[side == old] = new
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _joins(floor: float) -> Callable:
    """Pairs that pass the estimate and join different families of a bucket: of its side 0 with its side 1, or within side 2.
    Blocks of side 2 hold the rows of many buckets."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in rows.groupby("bucket", sort=False):
            within = bool((own["side"] == 2).any())
            sides = [own, own] if within else [own[own["side"] == s] for s in (0, 1)]
            if not min(map(len, sides)):
                continue
            signs = [np.frombuffer(b"".join(s["sign"]), dtype=np.uint8).reshape(len(s), -1) for s in sides]
            nodes, labels = [s["node"].to_numpy() for s in sides], [s["label"].to_numpy().copy() for s in sides]
            labels[1] = labels[0] if within else labels[1]
            for x in range(len(nodes[0])):
                other = labels[1] != labels[0][x]
                if within:
                    other[: x + 1] = False
                other = np.flatnonzero(other)
                if not len(other):
                    continue
                for y in other[estimate(signs[0][x], signs[1][other]) >= floor]:
                    if labels[0][x] != labels[1][y]:
                        out.append(sorted((int(nodes[0][x]), int(nodes[1][y]))))
                        old, new = labels[1][y], labels[0][x]
                        for side in labels[: 1 if within else 2]:
                            side[side == old] = new
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _confirm(k: int, percent: int) -> Callable:
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                known: dict[int, np.ndarray] = {}
                for side in ("a", "b"):
                    new = part.drop_duplicates(side)
                    new = new[~new[side].isin(known)]
                    known |= dict(zip(new[side], shingle_sets(new[f"text_{side}"].tolist(), k), strict=True))
                for a, b in zip(part["a"], part["b"], strict=True):
                    both = common(known[a], known[b])
                    good.append(100 * both >= percent * (len(known[a]) + len(known[b]) - both))
            yield batch.loc[good, ["a", "b"]]

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    a, b = (texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInPandas(_confirm(k, percent), "a long, b long")


def _estimated(pairs: DataFrame, classes: DataFrame, floor: float) -> DataFrame:
    a, b = (classes.select(F.col("node").alias(s), F.col("sign").alias(f"sign_{s}")) for s in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sign_a", "sign_b").mapInPandas(_passing(floor), "a long, b long")


def _dealt(own: DataFrame) -> DataFrame:
    """Rows of the blocks that compare different labels of a group: group, block, side, node, label. own: group, node, label."""
    parts = own.groupBy("group", "label").agg(F.count("*").alias("n"))
    whole = parts.groupBy("group").agg(F.count("*").alias("parts"), F.max_by("label", F.struct("n", -F.col("label"))).alias("major"), F.max("n").alias("majors"), F.sum("n").alias("n"))
    chunks = lambda n: F.ceil(n / BLOCK).cast("int")
    whole = whole.where("parts > 1").select("group", "major", chunks(F.col("majors")).alias("ca"), chunks(F.col("n") - F.col("majors")).alias("co"))
    rows = own.join(whole, "group").withColumn("in_major", F.col("label") == F.col("major"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.when(F.col("in_major"), F.col("ca")).otherwise(F.col("co"))).cast("int"))
    name = lambda kind, i, j: F.concat_ws("-", "group", F.lit(kind), i, j)
    block = lambda key, side: F.struct(key.alias("block"), side.alias("side"))
    outside = F.sequence(F.lit(0), F.col("co") - 1)
    of_major = F.transform(outside, lambda j: block(name("a", F.col("chunk"), j), F.lit(0)))
    with_major = F.transform(F.sequence(F.lit(0), F.col("ca") - 1), lambda i: block(name("a", i, F.col("chunk")), F.lit(1)))
    with_others = F.transform(outside, lambda j: block(name("o", F.least("chunk", j), F.greatest("chunk", j)), F.when(F.col("chunk") == j, 2).otherwise((F.col("chunk") > j).cast("int"))))
    rows = rows.withColumn("at", F.explode(F.when(F.col("in_major"), of_major).otherwise(F.concat(with_major, with_others))))
    return rows.select("group", "at.block", "at.side", "node", "label")


def _between(families: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame) -> tuple[DataFrame, int]:
    """Rows of the blocks that compare different components of a family: block, side, node, label, sign, text. With a number of
    tasks for them: their work is in the pairs, not in the bytes by which adaptive execution would put them together."""
    own = families.select("node", F.col("label").alias("group")).join(labels, "node", "left").select("node", "group", F.coalesce("label", "node").alias("label"))
    rows = kept(_dealt(own).drop("group"), "blocks")
    tasks = max(1, min(MOST_TASKS, rows.count() // BLOCK, rows.select("block").distinct().count()))
    rows = rows.join(classes.select("node", "sign"), "node").join(texts.withColumnRenamed("doc_id", "node"), "node")
    return rows.select("block", "side", "node", "label", "sign", "text"), tasks


def _across(members: DataFrame, families: DataFrame, classes: DataFrame, floor: float) -> DataFrame:
    """Pairs that join families which meet in a bucket: written, a long, b long. The lead of a bucket has met all of it."""
    own = members.where("n > 2 AND node <> lead").select("key", "node", "n").join(families, "node", "left")
    own = own.select("key", "node", F.coalesce("label", "node").alias("label"), "n")
    several = own.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("key")
    own = kept(own.join(several, "key"), "meetings")
    some = max(1, own.count() // ROWS_AT_ONCE)
    few = own.where(f"n <= {BLOCK}").select(F.col("key").alias("bucket"), F.concat(F.lit("few-"), F.pmod(F.xxhash64("key"), F.lit(some))).alias("block"), F.lit(2).alias("side"), "node", "label")
    many = _dealt(own.where(f"n > {BLOCK}").select(F.col("key").alias("group"), "node", "label")).withColumnRenamed("group", "bucket")
    rows = few.unionByName(many).join(classes.select("node", "sign"), "node")
    found = kept(rows.groupBy("block").applyInPandas(_joins(floor), "a long, b long").distinct(), "across")
    dropped(own)
    return found


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Links hold at 100 * intersection >= percent * union.

    The bands are set for a percent of 80 or more."""
    if percent < 80:
        raise ValueError("the bands lose links below 80 %")
    floor = floor_of(percent / 100)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        return _with_repeated_ids(rows, words, percent)
    signed = kept(rows.mapInPandas(_signatures(words), "doc_id long, n_shingles long, set_id binary, bands array<long>, sign binary"), "signatures")
    sets = signed.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    of_set = sets.groupBy("set_id").agg(F.min("doc_id").alias("node"))
    # One row a class: its smallest document, and what is known of its set.
    named = sets.select("set_id", F.col("doc_id").alias("node"), "bands", "sign")
    classes = kept(named.join(of_set, ["set_id", "node"]).dropDuplicates(["set_id"]), "classes")
    banded = classes.select("node", F.explode("bands").alias("key"))
    # Written first, so that the join shuffles both its sides and a large bucket's members are split among tasks.
    buckets = kept(banded.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = kept(banded.join(buckets, "key"), "members")
    dropped(buckets)
    # Only texts that share a bucket are shuffled on.
    texts = kept(rows.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    pairs = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    near = kept(_estimated(pairs, classes, floor), "near")
    links = kept(_confirmed(near, texts, words, percent), "links")
    labels, families = connected_components(links), connected_components(near)
    across = _across(members, families, classes, floor)
    if across.limit(1).count():
        families = connected_components(near.unionByName(across))
    blocks, tasks = _between(families, labels, classes, texts)
    more = kept(blocks.repartition(tasks, "block").groupBy("block").applyInPandas(_blocks(words, percent, floor), "a long, b long"), "more-links")
    if more.limit(1).count():
        labels = connected_components(links.unionByName(more))
    for x in (members, near, texts):
        dropped(x)
    # Written too: copies of one text, a third of all rows perhaps, are then split among tasks at the join.
    ids = kept(of_set.join(labels, "node", "left").select("set_id", F.coalesce("label", "node").alias("component")), "component-of-set")
    found = signed.select("doc_id", "n_shingles", "set_id").join(ids, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _with_repeated_ids(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Each row under a number of its own; then the smallest doc_id of each component."""
    rows = kept(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    some = rows.where("doc_id IS NOT NULL").select(F.col("row").alias("doc_id"), "text")
    found = kept(near_duplicates(some, words, percent).select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("of")), "of-rows")
    named = rows.select("row", "doc_id").join(found, "row")
    least = kept(named.groupBy("of").agg(F.min("doc_id").alias("component_id")), "least-ids")
    named = named.join(least, "of").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    null = near_duplicates(rows.where("doc_id IS NULL").select("doc_id", "text"), words, percent)
    return named.unionByName(null)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=2, percent=80)

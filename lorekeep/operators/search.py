"""The search tiers as joins: exact key, then vectors for what is left, and what is done with the hits.

Per-query branching is an anti join: queries with a surviving exact hit do not reach the second tier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import names_conflict
from ..functions.versions import canonical_runtime, major_of

# Fixed values of the contract.
PER_KEY = 64
PER_ANSWER = 5
MIN_SCORE, SPREAD = 0.6, 0.15
STRONG_SCORE = 0.85
TASK_SCORE = 0.55
START_SCORE, START_OVERLAP = 0.9, 0.6


def exact_hits(queries: DataFrame, entries: DataFrame, key: str = "fp", most: int = PER_ANSWER) -> DataFrame:
    """The strongest entries of each query's key, of at most PER_KEY a key. Names, where both sides have them, must not conflict.

    queries: query_id, key[, names]; entries: entry_id, key, strength[, names]. A key's entries, PER_KEY at most, are one row in
    their order: so a query's answer is a part of it, nothing is ranked after the join, and of a key that very many queries
    share the join's side of queries can be split. Rows without a key have no hits."""
    strongest = (F.desc("strength"), F.asc("entry_id"))
    capped = entries.where(F.col(key).isNotNull()).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*strongest))).where(F.col("n") <= PER_KEY)
    capped = capped.withColumnRenamed("names", "entry_names") if "names" in capped.columns else capped
    others = [c for c in capped.columns if c not in (key, "n")]
    lists = capped.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", *others))).alias("entries"))
    hits = queries.join(lists, key)
    found = F.col("entries")
    if "names" in queries.columns and "entry_names" in capped.columns:
        found = F.filter(found, lambda e: ~names_conflict(F.col("names"), e["entry_names"]))
    hits = hits.select(*queries.columns, F.posexplode(F.slice(found, 1, most)).alias("at", "entry"))
    hits = hits.select(*queries.columns, *(F.col(f"entry.{c}") for c in others), (F.col("at") + 1).alias("rank"))
    return hits.withColumns({"via": F.lit("fingerprint"), "score": F.lit(1.0)})


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a zero vector."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


#: Vectors of a block, of which a matrix is made, and how many queries a task holds, or some more.
BLOCK, HELD = 1_024, 4_096
#: Decimals of a score that its rank goes by; of scores that agree in them, the smaller id is first.
DIGITS = 9


def _merged(best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, least: float) -> None:
    """Puts a block's entries among the best of each query, in their place: scores (free places -inf) and ids, by rank.
    Entries come by id, so of equal scores those that came before stay, and of a block of copies only as many go on as have a place."""
    top, top_ids = best
    most, rounded = top.shape[1], np.round(scores, DIGITS)
    open_for = (scores >= least) & (rounded > np.round(top[:, -1:], DIGITS))
    if open_for.sum() > scores.shape[0] * most and scores.shape[1] > most:
        last = np.partition(rounded, -most, axis=1)[:, -most, None]
        above, tied = rounded > last, rounded == last
        open_for &= above | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= most - above.sum(axis=1, keepdims=True)))
    q, k = np.nonzero(open_for)
    if not len(q):
        return
    old_q, old_k = np.nonzero(np.isfinite(top))
    q, found, of = np.concatenate([q, old_q]), np.concatenate([scores[q, k], top[old_q, old_k]]), np.concatenate([ids[k], top_ids[old_q, old_k]])
    order = np.lexsort((of, -np.round(found, DIGITS), q))
    q, found, of = q[order], found[order], of[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    q, found, of, rank = (x[rank < most] for x in (q, found, of, rank))
    top[:] = -np.inf
    top[q, rank], top_ids[q, rank] = found, of


def _unit(rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dim, ids, unit vectors by the block; without those that are zero or not finite."""
    for dim, own in rows.groupby(rows["vec"].map(len)):
        for at in range(0, len(own) if dim else 0, BLOCK):
            part = own.iloc[at : at + BLOCK]
            x = np.stack(part["vec"].to_numpy()).astype(np.float64)
            norms = np.linalg.norm(x, axis=1)
            good = np.isfinite(norms) & (norms > 0)
            if good.any():
                yield dim, part["id"].to_numpy()[good], x[good] / norms[good, None]


def _nearest(least: float, most: int) -> Callable:
    """Cells one after the other, each cell's queries before its entries, by id: the queries are held, block by block, with the best
    entries of each; entries are read and left."""

    def told(held: dict[int, list]) -> Iterator[pd.DataFrame]:
        for blocks in held.values():
            for ids, _, (top, top_ids) in blocks:
                q, k = np.nonzero(np.isfinite(top))
                yield pd.DataFrame({"query_id": ids[q], "entry_id": top_ids[q, k], "score": top[q, k]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, {}
        for batch in batches:
            for (cell, entry), own in batch.groupby(["cell", "entry"]):  # in their order
                if cell != current:
                    yield from told(held)
                    current, held = cell, {}
                for dim, ids, x in _unit(own):
                    if not entry:
                        held.setdefault(dim, []).append((ids, x, (np.full((len(ids), most), -np.inf), np.zeros((len(ids), most), np.int64))))
                        continue
                    for _, asked, best in held.get(dim, []):
                        _merged(best, asked @ x.T, ids, least)
        yield from told(held)

    return run


def query_groups(queries: DataFrame) -> int:
    """In how many groups queries are dealt, so that a task can hold one."""
    return max(1, -(-queries.count() // HELD))


def semantic_hits(queries: DataFrame, entries: DataFrame, least: float, most: int = PER_ANSWER, groups: int | None = None) -> DataFrame:
    """The nearest entries of each query by cosine. queries is a stated set (a batch of requests) that is compared with every
    entry, block by block as products of matrices. Queries are dealt to groups by their id, entries to slices; a task has a group, which
    it holds, and a slice, which it reads as it comes, and only the best of each query and slice are shuffled. Vectors that are null,
    zero, or hold nulls or no finite numbers are near nothing, as are those of another length."""
    groups = groups or query_groups(queries)
    slices = max(1, -(-2 * queries.sparkSession.sparkContext.defaultParallelism // groups))

    def dealt(rows: DataFrame, name: str, entry: bool) -> DataFrame:
        vec = F.col("vec") if dict(rows.dtypes)["vec"] == "array<float>" else F.col("vec").cast("array<double>")
        whole = rows.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda v: v.isNull())).select(F.col(name).cast("long").alias("id"), vec.alias("vec"))
        own, every = (slices, groups) if entry else (groups, slices)
        at, other = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(every - 1)))
        cells = whole.select("id", "vec", at.alias("own"), other.alias("other"))
        group, piece = ("other", "own") if entry else ("own", "other")
        return cells.select((F.col(group) * slices + F.col(piece)).alias("cell"), F.lit(entry).alias("entry"), "id", "vec")

    rows = dealt(queries, "query_id", False).unionByName(dealt(entries, "entry_id", True))
    cells = rows.repartitionById(groups * slices, F.col("cell")).sortWithinPartitions("cell", "entry", "id")
    scored = cells.mapInPandas(_nearest(least, most), "query_id long, entry_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), F.asc("entry_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).withColumn("via", F.lit("semantic"))


def with_fallback(queries: DataFrame, exact: DataFrame, rest: DataFrame) -> DataFrame:
    """Exact hits, and for queries without any, those of the second tier."""
    columns = ["query_id", "entry_id", "rank", "via", "score"]
    open_queries = queries.select("query_id").join(exact.select("query_id"), "query_id", "left_anti")
    return exact.select(*columns).unionByName(rest.join(open_queries, "query_id", "left_semi").select(*columns))


def tiers(queries: DataFrame, entries: DataFrame, least: float = MIN_SCORE, most: int = PER_ANSWER) -> DataFrame:
    """Both tiers, of entries other than the query's own: exact hits, and for queries without any, the nearest by vector.

    queries: query_id, fp, vec; entries: entry_id, fp, strength, vec. A null key hits nothing, a null vector is near nothing."""
    exact = exact_hits(queries.select("query_id", "fp"), entries.select("entry_id", "fp", "strength"), most=PER_KEY).where("entry_id <> query_id")
    exact = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= most)
    open_queries = queries.join(exact.select("query_id"), "query_id", "left_anti")
    near = semantic_hits(open_queries, entries, least, most + 1, query_groups(queries)).where("entry_id <> query_id")  # itself is one of them at most
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= most)
    return with_fallback(queries, exact, near)


def relevant(hits: DataFrame, least: float = MIN_SCORE, spread: float = SPREAD) -> DataFrame:
    """Hits that are good and near the best of their query; hits without a score stay."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("best", best).where(F.col("score").isNull() | ((F.col("score") >= least) & (F.col("score") >= F.col("best") - spread))).drop("best")


def strong(via: Column, score: Column) -> Column:
    return (via == "fingerprint") | (score >= STRONG_SCORE)


def environment_overlap(mine: Column, other: Column) -> Column:
    """0 to 1 over what mine states: system .2, architecture .15, runtime .25 and its major .2, shared packages .2 (our weights)."""
    names = lambda e: F.array_distinct(F.transform(e["packages"], lambda p: F.lower(p["name"])))
    a, b = F.coalesce(names(mine), F.array().cast("array<string>")), F.coalesce(names(other), F.array().cast("array<string>"))
    both = F.size(F.array_union(a, b))
    shared = F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)
    same = lambda x, y, weight: F.when(x == y, weight).otherwise(0.0)
    runtime = canonical_runtime(mine["runtime"]["name"]) == canonical_runtime(other["runtime"]["name"])
    return (
        same(mine["os"], other["os"], 0.2)
        + same(mine["arch"], other["arch"], 0.15)
        + F.when(runtime, 0.25).otherwise(0.0)
        + F.when(runtime & (major_of(mine["runtime"]["version"]) == major_of(other["runtime"]["version"])), 0.2).otherwise(0.0)
        + 0.2 * shared
    )


def rank_score(strength: Column, overlap: Column, mismatched: Column) -> Column:
    """Strength, halved without any overlap, a tenth lower for another major version (our formula)."""
    return strength * (0.5 + 0.5 * F.coalesce(overlap, F.lit(1.0))) * F.when(mismatched, 0.9).otherwise(1.0)


def start_here(via: Column, score: Column, overlap: Column, mismatched: Column) -> Column:
    """What is said of the first hit: start, or caution."""
    near = (score >= START_SCORE) & (overlap.isNull() | (overlap >= START_OVERLAP))
    return F.when(mismatched, "caution: other version").when(via == "fingerprint", "start: exact").when(near, "start: closest").otherwise("caution: similar only")


def strongest_flags(flags: Column) -> Column:
    """Of array<struct<command_index, flag, level, detail>>: per command the most severe, the first of equals; unknown levels are high."""
    rank = lambda f: F.when(f["level"] == "low", 1).when(f["level"] == "medium", 2).otherwise(3)
    indexed = F.transform(flags, lambda f, i: F.struct((-rank(f)).alias("worst"), i.alias("i"), f.alias("flag")))
    commands = F.array_sort(F.array_distinct(F.transform(flags, lambda f: f["command_index"])))
    return F.transform(commands, lambda c: F.array_min(F.filter(indexed, lambda x: x["flag"]["command_index"] == c))["flag"])


def safe_commands(commands: Column, flags: Column) -> Column:
    """Commands without a flag other than low or medium; without an analysis (null flags), none."""
    bad = F.transform(F.filter(flags, lambda f: ~F.coalesce(f["level"].isin("low", "medium"), F.lit(False))), lambda f: f["command_index"])
    return F.when(flags.isNull(), F.slice(commands, 1, 0)).otherwise(F.filter(commands, lambda c, i: ~F.array_contains(bad, i)))


def successors(edges: DataFrame, strength: DataFrame, most: int = 3) -> DataFrame:
    """Per entry, what amends it: strongest first, then newest. edges: entry_id, amends, at; strength: entry_id, strength."""
    w = Window.partitionBy("amends").orderBy(F.desc_nulls_last("strength"), F.desc("at"), F.asc("entry_id"))
    ranked = edges.join(strength, "entry_id", "left").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    lists = F.transform(F.sort_array(F.collect_list(F.struct("n", "entry_id"))), lambda x: x["entry_id"])
    return ranked.groupBy(F.col("amends").alias("entry_id")).agg(lists.alias("amended_by"))


def expand_successors(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Keys of old entries find their successors too, one hop: hits (query_id, entry_id) and those of what amends them, if it comes from the
    old one's author or is about the same error by the check of a search. edges: entry_id, author, text, amends, old_author, old_text."""
    same = F.coalesce(F.col("author") == F.col("old_author"), F.lit(False)) | about_the_same(F.col("old_text"), F.col("text"), F.lit(0.0))
    newer = edges.where(same).select(F.col("amends").alias("entry_id"), F.col("entry_id").alias("newer")).distinct()
    more = hits.join(newer, "entry_id").select("query_id", F.col("newer").alias("entry_id"))
    return hits.select("query_id", "entry_id").unionByName(more).distinct()


# --- What a search may ask for, and what is withheld ------------------------------------------------------------------

MOST_ASKED = 10
NEARLY_SAME = 0.95
#: Words that many error lines have (our own list); others of four letters and more are distinctive.
COMMON_WORDS = "error errors failed failure cannot could found with from this that file line exception warning while does name value invalid unable missing module named type null none".split()


def asked(hits: DataFrame, min_strength: float = 0.0, limit: int = PER_ANSWER) -> DataFrame:
    """Each query's hits of some strength, the first of them by rank: limit is 1 to 10."""
    if not 0 <= min_strength <= 1 or not 1 <= limit <= MOST_ASKED:
        raise ValueError("min_strength is 0 to 1, limit is 1 to 10")
    order = Window.partitionBy("query_id").orderBy("rank", "entry_id")
    return hits.where(F.coalesce("strength", F.lit(0.0)) >= min_strength).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def task_hits(queries: DataFrame, entries: DataFrame, most: int = PER_ANSWER) -> DataFrame:
    """Hits of tasks in words: their own threshold, and none of the filters for error lines."""
    return semantic_hits(queries, entries, TASK_SCORE, most).withColumn("via", F.lit("task"))


def distinctive_words(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_.]+"), lambda w: F.length(w) >= 4)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, COMMON_WORDS)))


def about_the_same(query: Column, entry: Column, score: Column) -> Column:
    """For a hit by vectors: they share a distinctive word, unless nearly identical; and where the query looks like an error line and
    most words are shared, not each has a name that the other lacks."""
    a, b = distinctive_words(query), distinctive_words(entry)
    shared = F.size(F.array_intersect(a, b))
    named = lambda own, other: F.size(F.array_except(own, other)) > 0
    sibling = query.rlike("[:'\"`]") & (shared * 2 >= F.size(F.array_union(a, b)) - shared) & (shared > 0) & named(a, b) & named(b, a)
    return ((shared > 0) | (score >= NEARLY_SAME)) & ~sibling


def unseen(hits: DataFrame, shown: DataFrame, by: str = "query_id") -> DataFrame:
    """Without entries that were shown before to the same asker: shown has the column by and entry_id."""
    return hits.join(shown.select(by, "entry_id").distinct(), [by, "entry_id"], "left_anti")


def served(entries: DataFrame, amendments: DataFrame) -> DataFrame:
    """Entries without a high-risk command in prose (flag at index -1), and not replaced by their own author.

    entries: entry_id, author, flags; amendments: entry_id, amends, author."""
    risky = F.exists(F.coalesce("flags", F.array()), lambda f: (f["command_index"] == -1) & ~F.coalesce(f["level"].isin("low", "medium"), F.lit(False)))
    replaced = amendments.select(F.col("amends").alias("entry_id"), "author").distinct()
    return entries.where(~risky).join(replaced, ["entry_id", "author"], "left_anti")


def public_hit(optional: dict[str, Column], **always: Column) -> Column:
    """A hit as JSON: fields that are always there, and optional ones only where they are not null."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in always.items()), *(c.alias(n) for n, c in optional.items())), {"ignoreNullFields": "true"})

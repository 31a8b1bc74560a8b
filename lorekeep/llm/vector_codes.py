"""Vector codes by product quantisation: Lloyd's rounds over cover trees.

Components are whole numbers; vectors are cut into PARTS parts, each with a codebook of its own. A codebook begins as that part
of the ENTRIES vectors with the smallest vec_ids. A round assigns every part to the nearest entry (squared distance, ties to
the lower index) and replaces each entry by the mean of its parts, rounded down; unused entries stay.

Trees. Each task builds, of blocks of the rows that it reads, a cover tree for each part position: equal parts are one point
with a count; a node's children are centres that lie further apart than half its scale, the node's own first, and every point
goes to the first centre that covers it within that. A node knows its radius, and the sum and number of the parts
below it. Trees are written once.

Rounds. A task walks its trees from the root. If the nearest entry is nearer to a node's centre than any other by more than
twice its radius, then by the triangle inequality it is the nearest for all that is below, and the node's sum is taken
whole; only other nodes descend, at last to single points, which are compared exactly in whole numbers. Tasks hand on sums
and counts by entry, added up in Spark; what the driver sees of a round are the codebooks alone. Codebooks go to the tasks
with the function. Their size does not grow with the rows; should vectors have so many lengths that the codebooks of all of
them pass BOOK_BYTES, lengths are taken in lots.

Cases: vectors that are null or hold null or non-finite components are dropped; each length of vectors has codebooks of
its own; of a length that PARTS does not divide, parts differ by one component, and may be empty (distance 0, entry 0); with fewer
vectors than ENTRIES there are as many entries; rows that repeat a vec_id count each, and begin a codebook in the order of their
components; null vec_ids come last. Numbers are held to +-MOST, so that sums stay whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, kept, lean, read_table
from .exact_search import whole_numbers

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
MOST = 1 << 22
#: Rows of a block, and points that a node has below it without inner nodes.
BLOCK, LEAF = 8_192, 8
BOOK_BYTES = 64 << 20


def cuts(dims: int, parts: int = PARTS) -> list[int]:
    return [dims * i // parts for i in range(parts + 1)]


def cover_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes of a tree over whole-numbered points, parents before children, children of a node side by side.

    points: the distinct ones, of: which one each given point is; at: a node's centre; radius, many, first (child), children;
    sums: of nodes with children, in their order.
    """
    if points.shape[1]:
        distinct, of, copies = np.unique(points, axis=0, return_inverse=True, return_counts=True)
    else:
        distinct, of, copies = points[:1], np.zeros(len(points), dtype=np.int64), np.array([len(points)])
    real = distinct.astype(np.float64)

    def away(centre: int, those: np.ndarray) -> np.ndarray:
        return np.sqrt(((real[those] - real[centre]) ** 2).sum(axis=1))

    start = int(np.argmin(((real - real.mean(axis=0)) ** 2).sum(axis=1)))
    every = np.arange(len(distinct))
    waiting, at, radius, many, first, children, sums = [(every, away(start, every))], [start], [], [], [], [], []
    for node, centre in enumerate(at):  # grows
        below, far = waiting[node]
        waiting[node] = ()
        radius.append(far.max())
        many.append(copies[below].sum())
        if len(below) == 1:
            first.append(0)
            children.append(0)
            continue
        first.append(len(at))
        sums.append((distinct[below] * copies[below, None]).sum(axis=0))
        if len(below) <= LEAF:
            at.extend(below.tolist())
            waiting.extend((below[i : i + 1], np.zeros(1)) for i in range(len(below)))
        else:
            half = 2.0 ** (np.ceil(np.log2(radius[node])) - 1)
            while len(below):
                near = far <= half
                at.append(centre)
                waiting.append((below[near], far[near]))
                below = below[~near]
                if len(below):
                    centre = int(below[0])
                    far = away(centre, below)
        children.append(len(at) - first[node])
    return {
        "points": distinct.astype(np.int32), "of": of.astype(np.int32).ravel(), "at": np.array(at, dtype=np.int32), "radius": np.array(radius), "many": np.array(many, dtype=np.int64),
        "first": np.array(first, dtype=np.int32), "children": np.array(children, dtype=np.int32), "sums": np.array(sums, dtype=np.int64).reshape(len(sums), points.shape[1]),
    }


def _squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    gap = points[:, None, :].astype(np.int64) - entries[None, :, :]
    return np.einsum("nkd,nkd->nk", gap, gap)


def _below(tree: dict[str, np.ndarray], nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of the nodes, and which of the nodes each belongs to."""
    count = tree["children"][nodes].astype(np.int64)
    of = np.repeat(np.arange(len(nodes)), count)
    return tree["first"][nodes][of] + np.arange(count.sum()) - (np.cumsum(count) - count)[of], of


def walked(tree: dict[str, np.ndarray], entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes that are assigned whole, and their entries; together they cover every point once."""
    front = np.zeros(1, dtype=np.int64)
    while len(front):
        squared = _squared(tree["points"][tree["at"][front]], entries)
        best = np.argmin(squared, axis=1)  # of ties the lower index
        away = np.sqrt(squared)
        nearest = away[np.arange(len(front)), best]
        away[np.arange(len(front)), best] = np.inf
        lead = away.min(axis=1) - nearest
        sure = (tree["children"][front] == 0) | (lead > 2 * tree["radius"][front] * (1 + 1e-9) + 1e-6)
        yield front[sure], best[sure]
        front = _below(tree, front[~sure])[0]


def summed(tree: dict[str, np.ndarray], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of the parts that are nearest to each entry."""
    sums, many = np.zeros(entries.shape, dtype=np.int64), np.zeros(len(entries), dtype=np.int64)
    inner = np.cumsum(tree["children"] > 0) - 1
    for nodes, best in walked(tree, entries):
        leaf = tree["children"][nodes] == 0
        own = np.empty((len(nodes), entries.shape[1]), dtype=np.int64)
        own[leaf] = tree["points"][tree["at"][nodes[leaf]]].astype(np.int64) * tree["many"][nodes[leaf], None]
        own[~leaf] = tree["sums"][inner[nodes[~leaf]]]
        np.add.at(sums, best, own)
        np.add.at(many, best, tree["many"][nodes])
    return sums, many


def assigned(tree: dict[str, np.ndarray], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each given point, and the squared distance."""
    code = np.zeros(len(tree["points"]), dtype=np.int64)
    for nodes, best in walked(tree, entries):
        while len(nodes):
            leaf = tree["children"][nodes] == 0
            code[tree["at"][nodes[leaf]]] = best[leaf]
            nodes, of = _below(tree, nodes[~leaf])
            best = best[~leaf][of]
    gap = tree["points"].astype(np.int64) - entries[code]
    return code[tree["of"]], np.einsum("nd,nd->n", gap, gap)[tree["of"]]


def _packed(trees: list[dict[str, np.ndarray]]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{f"{i}/{name}": x for i, tree in enumerate(trees) for name, x in tree.items()})
    return out.getvalue()


def _unpacked(data: bytes) -> list[dict[str, np.ndarray]]:
    found: dict[int, dict[str, np.ndarray]] = {}
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        for key in held.files:
            i, name = key.split("/")
            found.setdefault(int(i), {})[name] = held[key]
    return [found[i] for i in sorted(found)]


def _planted(parts: int):
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(batch["vec_id"], batch["label"], batch["vec"], strict=True):
                own = held.setdefault(len(row[2]), [])
                own.append(row)
                if len(own) == BLOCK:
                    yield _block(held.pop(len(row[2])), parts)
        for rows in held.values():
            yield _block(rows, parts)

    return run


def _block(rows: list[tuple], parts: int) -> pd.DataFrame:
    x = np.stack([v for _, _, v in rows]).astype(np.int64)
    edges = cuts(x.shape[1], parts)
    trees = [cover_tree(x[:, a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    ids, labels = ([None if pd.isna(r[i]) else int(r[i]) for r in rows] for i in (0, 1))
    return pd.DataFrame({"dims": [x.shape[1]], "ids": [ids], "labels": [labels], "trees": [_packed(trees)]})


Books = dict[int, list[np.ndarray]]


def _round(books: Books):
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for dims, data in zip(batch["dims"], batch["trees"], strict=True):
                for part, (tree, entries) in enumerate(zip(_unpacked(data), books[dims], strict=True)):
                    new = summed(tree, entries)
                    old = found.setdefault((dims, part), [np.zeros_like(x) for x in new])
                    for a, b in zip(old, new, strict=True):
                        a += b
        for (dims, part), (sums, many) in found.items():
            used = np.flatnonzero(many)
            yield pd.DataFrame({"dims": dims, "part": part, "entry": used, "many": many[used], "sums": list(sums[used])})

    return run


def _coded(books: Books):
    digests = {dims: digest(own) for dims, own in books.items()}

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, data, ids, labels in zip(batch["dims"], batch["trees"], batch["ids"], batch["labels"], strict=True):
                codes, error = [], 0
                for tree, entries in zip(_unpacked(data), books[dims], strict=True):
                    code, squared = assigned(tree, entries)
                    codes.append(code.astype(np.uint8))
                    error = error + squared
                whole = np.ascontiguousarray(np.stack(codes, axis=1))
                yield pd.DataFrame({"vec_id": pd.array(ids, dtype="Int64"), "label": pd.array(labels, dtype="Int64"), "code": [x.tobytes().hex() for x in whole], "error": error, "codebooks_sha256": digests[dims]})

    return run


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for entries in books for x in entries.ravel().tolist()).encode()).hexdigest()


def _first_books(rows: DataFrame, lengths: list[int], parts: int, entries: int) -> Books:
    """Parts of the first vectors of each length: as many rows a length as a codebook has entries."""
    at = F.row_number().over(Window.partitionBy("dims").orderBy(F.asc_nulls_last("vec_id"), "vec"))
    own = rows.where(F.col("dims").isin(lengths)).select("dims", "vec_id", "vec").withColumn("at", at).where(f"at <= {entries}")
    found: dict[int, list] = {}
    for r in sorted(own.collect(), key=lambda r: (r["dims"], r["at"])):
        found.setdefault(r["dims"], []).append(r["vec"])
    books: Books = {}
    for dims, vecs in found.items():
        x, edges = np.array(vecs, dtype=np.int64).reshape(len(vecs), dims), cuts(dims, parts)
        books[dims] = [x[:, a:b].copy() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return books


def _next(trees: DataFrame, books: Books) -> Books:
    sums = trees.select("dims", "trees").mapInPandas(_round(books), "dims int, part int, entry int, many long, sums array<long>")
    sums = sums.select("dims", "part", "entry", "many", F.posexplode_outer("sums").alias("at", "value")).groupBy("dims", "part", "entry", "at").agg(F.sum("many").alias("many"), F.sum("value").alias("value"))
    new = {dims: [entries.copy() for entries in own] for dims, own in books.items()}
    for r in sums.collect():  # as many rows as the codebooks have components
        if r["at"] is not None:
            new[r["dims"]][r["part"]][r["entry"], r["at"]] = r["value"] // r["many"]
    return new


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 (of the vector's length). rows: vec_id long, label, vec array<long> (null: dropped)."""
    if not 0 < entries <= 256:
        raise ValueError("an index is a byte")
    rows = rows.where("vec IS NOT NULL").select("vec_id", F.col("label").cast("long").alias("label"), "vec", F.size("vec").alias("dims"))
    trees = kept(rows.select("vec_id", "label", "vec").mapInPandas(_planted(parts), "dims int, ids array<long>, labels array<long>, trees binary"), "cover-trees")
    lengths = sorted(r["dims"] for r in trees.select("dims").distinct().collect())
    lots: list[list[int]] = []
    for dims in lengths:
        if not lots or (sum(lots[-1]) + dims) * entries * 8 > BOOK_BYTES:
            lots.append([])
        lots[-1].append(dims)
    found = None
    for lot in lots:
        own, books = trees.where(F.col("dims").isin(lot)), _first_books(rows, lot, parts, entries)
        for _ in range(rounds):
            books = _next(own, books)
        coded = kept(own.mapInPandas(_coded(books), "vec_id long, label long, code string, error long, codebooks_sha256 string"), "codes")
        found = coded if found is None else found.unionByName(coded)
    dropped(trees)
    return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256")).limit(0) if found is None else found


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, with the error of each and of each label."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "label", whole_numbers(F.col("embedding"), SCALE, MOST).alias("vec"))
    codes = vector_codes(rows)
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    near = "SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.y, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts p JOIN b{i} b USING (part) QUALIFY row_number() OVER (PARTITION BY p.vec_id, p.part ORDER BY d, b.entry) = 1"
    mean = "SELECT part, entry, list(m ORDER BY pos) AS e FROM (SELECT part, entry, pos, CAST(floor(sum(y[pos]) / count(*)) AS BIGINT) AS m FROM n{i} JOIN parts USING (vec_id, part), (SELECT unnest(range(1, 1 + (SELECT max(len(y)) FROM parts))) AS pos) GROUP BY part, entry, pos) GROUP BY part, entry"
    rounds = ",\n".join(f"n{i} AS MATERIALIZED ({near.format(i=i)}),\nm{i} AS ({mean.format(i=i)}),\nb{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.e, b.e) AS e FROM b{i} b LEFT JOIN m{i} m USING (part, entry))" for i in range(ROUNDS))
    return f"""
WITH whole AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (SELECT vec_id, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS y FROM whole, (SELECT unnest(range({PARTS})) AS part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, y AS e FROM parts QUALIFY entry < {ENTRIES}),
{rounds},
last AS ({near.format(i=ROUNDS)}),
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN whole USING (vec_id), books
"""


OP13_SQL = _sql()

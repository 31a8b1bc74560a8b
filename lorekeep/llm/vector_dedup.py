"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors are one class. All classes of one dimension begin as one shard. A shard of over MOST_IN_SHARD members is parted
by centroids that are fitted on a bounded sample of it: each member goes to the shards of the OVERLAP nearest centroids
(two on deeper levels). Levels follow until all shards are small, so centroids grow with the table. What LEVELS levels do
not part, vectors that are nearly all alike, is dealt into chunks, and each two chunks make a shard.

In each shard a graph is built: a node's neighbours are robustly pruned (one is left out if a nearer one is ALPHA times
nearer to it than the node is). The adjacency lists of all shards are united by node. A shard also gets the nodes of other
shards that its members' lists lead to, if they are near enough for a link with a member to be possible. Then each shard
is searched for its members: a greedy beam search over the united lists from the shard's medoid, widened into a range
search that goes on, along edges in both directions, from every vector found within the range. What is found is verified by cosine in double precision.

Links are not written pair by pair. A pair that shares shards belongs to the first of them; a shard hands on, for each
member, the number of its links, and edges that keep linked members connected. Only pairs that share no shard are
written, once. The recall is audited for a sample of vectors against all vectors, with more of them until AUDIT_LINKS true
links have been seen; while it is below AUDIT_FLOOR, the graph is built again with more overlap; after ATTEMPTS the best
is taken, if its recall is at least LEAST_RECALL, else an error is raised.

Vectors that are null, zero, or hold null or non-finite components link with nothing, as do those of another
dimension than their partner. Rows that repeat a vec_id are vectors of their own with regard to n_links. A null vec_id
links with nothing. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, dropped, kept, lean, read_table

#: Members of a shard, on average and at most.
SHARD, MOST_IN_SHARD = 1_500, 3_000
#: Vectors of a shard that its centroids are fitted on, and centroids of one level; a task assigns ROWS vectors.
SAMPLE, MOST_CENTROIDS, ROWS = 16_384, 1_024, 50_000
LEVELS = 4
OVERLAP, MORE_OVERLAP, ATTEMPTS = 4, 3, 3
DEGREE, CANDIDATES, ALPHA = 24, 64, 1.2
BEAM, STEPS = 8, 24
#: Edges that the range search follows at once.
PAIRS_AT_ONCE = 1_000_000
#: Found vectors this much below the range still lead on.
SLACK = 0.03
AUDITED, MOST_AUDITED, AUDIT_LINKS, AUDIT_FLOOR, LEAST_RECALL = 400, 6_400, 200, 0.99, 0.9


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["vec"].to_numpy()).astype(np.float64)


def centroids(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 9) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    rng = np.random.default_rng(seed)
    found = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(sample[a : a + 2048] @ found.T, axis=1) for a in range(0, len(sample), 2048)])
        order = np.argsort(own, kind="stable")
        used, first = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(sample[order], first, axis=0)
        norms = np.linalg.norm(sums, axis=1)
        found[used[norms > 1e-9]] = sums[norms > 1e-9] / norms[norms > 1e-9, None]
    return found


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("node")
    found = centroids(unit(_matrix(rows)).astype(np.float32), int(rows["k"].iloc[0]))
    return pd.DataFrame({"shard": rows["shard"].iloc[:1], "centers": [found.ravel().tolist()]})


def _assign(overlap: int) -> Callable:
    """The shards below that the members of one go to, as a place among its centroids."""

    def run(rows: pd.DataFrame, centers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(centers):
            return pd.DataFrame({"node": [], "shard": [], "place": []})
        x = unit(_matrix(rows)).astype(np.float32)
        c = np.asarray(centers["centers"].iloc[0], dtype=np.float32).reshape(-1, x.shape[1])
        m = min(overlap, len(c))
        near = np.concatenate([np.argpartition(-(x[a : a + 2048] @ c.T), m - 1, axis=1)[:, :m] for a in range(0, len(x), 2048)])
        return pd.DataFrame({"node": np.repeat(rows["node"].to_numpy(), m), "shard": rows["shard"].iloc[0], "place": near.ravel()})

    return run


def _parted(placed: DataFrame, classes: DataFrame, overlap: int) -> DataFrame | None:
    """One level more for (node, shard); none if all shards are small. Pairs of chunks are not parted."""
    sizes = kept(placed.groupBy("shard").count(), "shard-sizes")
    large = sizes.where(F.col("count") > MOST_IN_SHARD)
    if not large.limit(1).count():
        return None
    own = placed.join(large.withColumn("salts", F.ceil(F.col("count") / ROWS).cast("int")), "shard").join(classes.select("node", "vec"), "node")
    own = kept(own.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")), "large-shards")
    share = F.pmod(F.xxhash64("node", F.lit(9)), F.lit(1 << 30)) / F.lit(1 << 30)
    k = F.least(F.lit(MOST_CENTROIDS), F.ceil(F.col("count") * overlap / SHARD)).cast("int")
    centers = own.where(share < F.lit(SAMPLE) / F.col("count")).select("shard", "node", "vec", k.alias("k")).groupBy("shard").applyInPandas(_fit, "shard long, centers array<float>")
    centers = centers.join(large, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("count") / ROWS).cast("int") - 1))).select("shard", "salt", "centers")
    below = own.select("shard", "salt", "node", "vec").groupBy("shard", "salt").cogroup(centers.groupBy("shard", "salt")).applyInPandas(_assign(overlap), "node long, shard long, place int")
    small = placed.join(large.select("shard"), "shard", "left_anti").select("node", "shard")
    found = kept(below.select("node", F.xxhash64("shard", "place").alias("shard")).unionByName(small), "placed")
    dropped(own)
    return found


def _chunked(placed: DataFrame) -> DataFrame:
    """Shards that are still too large become pairs of chunks."""
    sizes = placed.groupBy("shard").count()
    sizes = sizes.select("shard", F.when(F.col("count") > MOST_IN_SHARD, F.ceil(F.col("count") / (MOST_IN_SHARD // 2))).otherwise(1).cast("int").alias("chunks"))
    dealt = placed.join(kept(sizes, "chunks"), "shard").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    other = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: o != F.col("chunk"))
    pair = F.transform(other, lambda o: F.xxhash64("shard", F.least("chunk", o), F.greatest("chunk", o)))
    return dealt.select("node", F.explode(F.when(F.col("chunks") > 1, pair).otherwise(F.array("shard"))).alias("shard"))


def pruned(x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Neighbours of each unit vector, nearest first, without those that a chosen one is much nearer to; and their cosines."""
    out, cosines = [], []
    m = min(CANDIDATES, len(x) - 1)
    for a in range(0, len(x), 512):
        near = x[a : a + 512] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -2
        for row, cand in enumerate(np.argpartition(-near, m - 1, axis=1)[:, :m] if m else [np.zeros(0, int)] * len(near)):
            cand = cand[np.argsort(-near[row, cand], kind="stable")]
            gap = 1 - near[row, cand]
            among = 1 - x[cand] @ x[cand].T
            live, chosen = np.ones(len(cand), dtype=bool), []
            for i in range(len(cand)):
                if live[i]:
                    chosen.append(i)
                    if len(chosen) == DEGREE:
                        break
                    live &= ALPHA * among[i] > gap
            out.append(cand[np.array(chosen, dtype=np.int64)])
            cosines.append(near[row, out[-1]])
    return out, cosines


def _build(reach: float) -> Callable:
    """near: a node's neighbours; close: those of them from which a link of the node may lead on, by the triangle inequality."""
    bound = float(np.cos(min(np.pi, 2 * np.arccos(max(-1.0, reach - SLACK)))))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        nodes = rows["node"].to_numpy()
        lists, cosines = pruned(unit(_matrix(rows)).astype(np.float32))
        return pd.DataFrame({"node": nodes, "near": [nodes[x].tolist() for x in lists], "close": [nodes[x[c >= bound]].tolist() for x, c in zip(lists, cosines, strict=True)]})

    return run


def both_ways(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a graph in both directions: where each node's begin, and what they lead to."""
    n = len(lists)
    a, b = np.repeat(np.arange(n), [len(x) for x in lists]), np.array([v for x in lists for v in x], dtype=np.int64)
    edge = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.searchsorted(edge, np.arange(n + 1) * n), edge % n


def search(x: np.ndarray, near: np.ndarray, around: tuple[np.ndarray, np.ndarray], reach: float, asked: int) -> np.ndarray:
    """Pairs (query, found) within the range, queries being the first rows of x; near: neighbours of each row, filled up with
    the row itself, for the beam; around: edges in both directions, for what lies in the range."""
    n = len(x)
    medoid = int(np.argmax(x @ unit(x.sum(axis=0, keepdims=True) + 1e-12)[0]))
    every = np.arange(asked)
    beam = np.full((asked, BEAM), medoid)
    value = np.full((asked, BEAM), -2.0, dtype=np.float32)
    value[:, 0] = x[:asked] @ x[medoid]
    seen = np.zeros((asked, n), dtype=bool)  # a shard is bounded
    seen[:, medoid] = True
    spent = np.ones((asked, BEAM), dtype=bool)
    spent[:, 0] = False
    for _ in range(STEPS):
        best = np.argmax(np.where(spent, -3, value), axis=1)
        active = np.flatnonzero(~spent[every, best])
        if not len(active):
            break
        spent[active, best[active]] = True
        new = near[beam[active, best[active]]]
        known = seen[active[:, None], new]
        score = np.matmul(x[new], x[active][:, :, None])[:, :, 0]
        score[known] = -2
        seen[active[:, None], new] = True
        names = np.concatenate([beam[active], new], axis=1)
        values = np.concatenate([value[active], score], axis=1)
        done = np.concatenate([spent[active], known], axis=1)
        top = np.argpartition(-values, BEAM - 1, axis=1)[:, :BEAM]
        beam[active], value[active], spent[active] = (np.take_along_axis(z, top, axis=1) for z in (names, values, done))
    hit = np.flatnonzero((value >= reach - SLACK).ravel())
    front = np.unique(np.concatenate([hit // BEAM * n + beam.ravel()[hit], every * n + every]))
    found = np.zeros(asked * n, dtype=bool)
    found[front] = True
    starts, ends = around
    while len(front):
        grown = []
        sizes = np.cumsum(np.diff(starts)[front % n])
        for part in np.split(front, np.searchsorted(sizes, np.arange(PAIRS_AT_ONCE, sizes[-1], PAIRS_AT_ONCE))):
            q, v = np.divmod(part, n)
            count = starts[v + 1] - starts[v]
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - starts[v], count)
            key = np.repeat(q, count) * n + ends[place]
            key = np.unique(key[~found[key]])
            q, v = np.divmod(key, n)
            key = key[np.einsum("pd,pd->p", x[q], x[v]) >= reach - SLACK]
            found[key] = True
            grown.append(key)
        front = np.concatenate(grown)
    return np.stack(np.divmod(np.flatnonzero(found), n), axis=1)


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is connected with."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        for side in (a, b, label[a], label[b]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


_FOUND = "kind int, a long, b long, n long"
COUNT, EDGE, CROSS, AUDIT = range(4)


def _find(threshold: float) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["guest", "node"]).reset_index(drop=True)
        shard, asked = rows["shard"].iloc[0], int((~rows["guest"]).sum())
        nodes, exact = rows["node"].to_numpy(), unit(_matrix(rows))
        place = {v: i for i, v in enumerate(nodes.tolist())}
        lists = [sorted({place[v] for part in x for v in part if v in place}) for x in rows["near"]]
        near = np.repeat(np.arange(len(rows))[:, None], max(1, max(map(len, lists))), axis=1)
        for i, x in enumerate(lists):
            near[i, : len(x)] = x
        pairs = search(exact.astype(np.float32), near, both_ways(lists), threshold, asked)
        # Each pair once: from its smaller node, or from its member if the other is a guest. What either side found counts.
        a, b = pairs.T
        swap = (a > b) & (b < asked)
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        key = np.unique((a * len(rows) + b)[a != b])
        a, b = np.divmod(key, len(rows))
        good = np.concatenate([np.einsum("pd,pd->p", exact[a[i : i + 50_000]], exact[b[i : i + 50_000]]) >= threshold for i in range(0, len(a) + 1, 50_000)])
        a, b = a[good], b[good]
        most = max(map(len, rows["homes"]))
        homes = np.array([[*x, *[np.iinfo(np.int64).max] * (most - len(x))] for x in rows["homes"]], dtype=np.int64)
        first = np.full(len(a), np.iinfo(np.int64).max)
        for i in range(most):
            mine = homes[a, i]
            shared = (homes[b] == mine[:, None]).any(axis=1)
            first = np.where(shared, np.minimum(first, mine), first)
        own = first == shard
        cross = (first == np.iinfo(np.int64).max) & (b >= asked)
        copies = rows["copies"].to_numpy()
        count = np.bincount(a[own], copies[b[own]], len(rows)) + np.bincount(b[own], copies[a[own]], len(rows))
        label = connected(len(rows), a[own], b[own])
        at, child = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(rows)))
        told = rows["audited"].to_numpy()
        told = (told[a] | told[b]) & (own | cross)
        out = [(COUNT, nodes[at], nodes[at], count[at].astype(np.int64)), (EDGE, nodes[label[child]], nodes[child], 0), (CROSS, nodes[a[cross]], nodes[b[cross]], 0), (AUDIT, nodes[a[told]], nodes[b[told]], 0)]
        return pd.concat([pd.DataFrame({"kind": k, "a": np.minimum(x, y), "b": np.maximum(x, y), "n": n}) for k, x, y, n in out])

    return run


def _audit(names: np.ndarray, vectors: np.ndarray, threshold: float) -> Callable:
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch[[len(v) == vectors.shape[1] for v in batch["vec"]]]
            if len(own):
                q, v = np.nonzero(vectors @ unit(_matrix(own)).T >= threshold)
                other = own["node"].to_numpy()[v]
                pairs = pd.DataFrame({"a": np.minimum(names[q], other), "b": np.maximum(names[q], other)})
                yield pairs[pairs["a"] < pairs["b"]]

    return run


def _found(classes: DataFrame, overlap: int, threshold: float, audited: DataFrame) -> DataFrame:
    """What the shards hand on: kind, a, b, n."""
    placed = kept(classes.select("node", F.xxhash64(F.size("vec")).alias("shard")), "placed")
    for level in range(LEVELS):
        below = _parted(placed, classes, overlap if level == 0 else 2)
        if below is None:
            break
        dropped(placed)
        placed = below
    placed = _chunked(placed).distinct()
    homes = placed.groupBy("node").agg(F.sort_array(F.collect_set("shard")).alias("homes"))  # a node is in a bounded number of shards
    known = classes.select("node", "vec", "copies").join(homes, "node").join(F.broadcast(audited.select("node", F.lit(True).alias("audited"))), "node", "left")
    known = kept(known.withColumn("audited", F.coalesce("audited", F.lit(False))), "known")
    members = kept(known.withColumn("shard", F.explode("homes")), "members")
    graph = kept(members.select("shard", "node", "vec").groupBy("shard").applyInPandas(_build(threshold), "node long, near array<long>, close array<long>"), "graph")
    united = graph.groupBy("node").agg(F.collect_list("near").alias("near"))
    member = F.lit(False).alias("guest")
    ways = graph.select("node", F.explode("close").alias("to")).distinct().join(known.select("node", F.explode("homes").alias("shard")), "node").select("shard", F.col("to").alias("node")).distinct()
    guests = ways.join(known, "node").where(~F.array_contains("homes", F.col("shard"))).select("shard", *known.columns, F.lit(True).alias("guest"))
    rows = members.select("shard", *known.columns, member).unionByName(guests).join(united, "node")
    found = kept(rows.groupBy("shard").applyInPandas(_find(threshold), _FOUND), "found")
    for x in (placed, known, members, graph):
        dropped(x)
    return found


def near_vectors(rows: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. rows: vec_id, embedding."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    sound = F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull())
    # -0.0 is 0.0 here.
    same = F.sha2(F.concat_ws(",", F.transform("vec", lambda v: v + F.lit(0.0))), 256)
    rows = kept(rows.withColumn("name", F.when(F.col("sound"), same)), "vectors")
    classes = rows.where("sound").groupBy("name").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = kept(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    found = _audited(classes, threshold)
    cross = found.where(f"kind = {CROSS}").select("a", "b").distinct()
    both = cross.unionByName(cross.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(classes.select(F.col("node").alias("b"), F.col("copies").alias("n")), "b").select("a", "n")
    others = found.where(f"kind = {COUNT}").select("a", "n").unionByName(both).groupBy("a").agg(F.sum("n").alias("others"))
    labels = connected_components(found.where(f"kind IN ({EDGE}, {CROSS})").select("a", "b"))
    own = classes.select("name", "node", "copies", "least").join(others.withColumnRenamed("a", "node"), "node", "left").join(labels, "node", "left")
    own = kept(own.select("name", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("label", "node").alias("label")), "of-class")
    # Nodes are numbers without an order; a component is named after its smallest vec_id.
    least = kept(own.groupBy("label").agg(F.min("least").alias("component")), "least-ids")
    joined = rows.join(own.join(least, "label").select("name", "n_links", "component"), "name", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _truth(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, int]:
    """(audited nodes, their links with all vectors, how many these are). Both are bounded: by MOST_AUDITED, and that times the links of a vector."""
    most = AUDITED
    while True:
        sample = classes.select("node", "vec").orderBy(F.xxhash64("node", F.lit(9)), "node").limit(most).toPandas()
        truth = None
        for _, own in sample.groupby(sample["vec"].map(len)):
            part = classes.select("node", "vec").mapInPandas(_audit(own["node"].to_numpy(), unit(_matrix(own)), threshold), "a long, b long")
            truth = part if truth is None else truth.unionByName(part)
        nodes = classes.sparkSession.createDataFrame(sample[["node"]].astype("int64"), "node long")
        truth = kept((classes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0) if truth is None else truth).distinct(), "audit")
        links = truth.count()
        if links >= AUDIT_LINKS or most >= MOST_AUDITED or len(sample) < most:
            return nodes, truth, links
        most *= 4
        dropped(truth)


def _audited(classes: DataFrame, threshold: float) -> DataFrame:
    audited, truth, expected = _truth(classes, threshold)
    best: tuple[float, DataFrame] | None = None
    for attempt in range(ATTEMPTS):
        found = _found(classes, OVERLAP + attempt * MORE_OVERLAP, threshold, audited)
        told = found.where(f"kind = {AUDIT}").select("a", "b").distinct()
        recall = truth.join(told, ["a", "b"], "left_semi").count() / expected if expected else 1.0
        if best is None or recall > best[0]:
            best = recall, found
        if recall >= AUDIT_FLOOR:
            break
    if best[0] < LEAST_RECALL:
        raise RuntimeError(f"the graph's recall is {best[0]:.4f} of {expected} audited links")
    return best[1]


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))

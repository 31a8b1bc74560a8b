"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces shorter than a sequence are dealt by hash to shards of a bounded number of pieces. Each shard is the problem of a
few islands, which are rows of their own and run as tasks of their own. An island's genome is the grouping itself: which
piece is in which bin. Crossover injects whole bins of one parent, from among its fullest, into the other, takes out bins that
now hold duplicates, and puts the displaced pieces back by best fit, longest first; mutation empties some badly filled
bins and puts their pieces back in the same way, or bin by bin with the piece or pair of pieces that fits best. An island ends an
epoch when it has as few bins as the sum of lengths allows, or when STAGNATION generations have bettered nothing. After
each epoch an island's elite migrates to the next island of its shard. The best grouping of a shard wins. Bins that remain
badly filled, a few a shard, are opened and their pieces packed once more together, by the same steps, as long as that leaves
much fewer.

A piece has a length of 1 to capacity; a length of 0 takes no room and is put anywhere; longer ones are an error (the
caller cuts them). Pieces alike in everything are told apart by row. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, lean, read_table
from .tokens import table

CAPACITY = 2048
#: Pieces of a shard, and islands that work on it.
SHARD_PIECES = 4_096
ISLANDS = 3
POPULATION = 8
#: Generations of an epoch at most, and without a better grouping.
GENERATIONS, STAGNATION = 40, 6
EPOCHS = 2
#: A bin at least this full is well filled: it is passed on whole; at the end others are opened and packed once more.
WELL_FILLED = 0.995
#: How often what is badly filled is packed again; by then 8^MOST_LEVELS shards and more have become one.
MOST_LEVELS = 6
SEED = 3


def best_fit(lengths: list[int], room: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Puts lengths, in the order given, each into the bin with the least room that suffices, else into a new one.

    room: of the bins that exist; gives the bin of each length, and the room left in all bins."""
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    has = 0  # bit r: some bin has room r
    room = list(room)
    for b, r in enumerate(room):
        with_room[r].append(b)
        has |= 1 << r
    out = []
    for n in lengths:
        fits = has >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = with_room[r].pop()
            if not with_room[r]:
                has ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(r)
        room[b] = r - n
        with_room[r - n].append(b)
        has |= 1 << (r - n)
        out.append(b)
    return out, room


def fit_by_pairs(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each length: each new bin gets the longest that is left, then the one or two that leave the least room."""
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, n in enumerate(lengths):
        waiting[n].append(i)
    count = np.array([len(x) for x in waiting])
    sizes = np.arange(capacity + 1)
    out, b, left = [0] * len(lengths), 0, len(lengths)

    def take(n: int) -> None:
        nonlocal left
        out[waiting[n].pop()] = b
        count[n] -= 1
        left -= 1

    while left:
        take(room_taken := int(np.flatnonzero(count)[-1]))
        room = capacity - room_taken
        while left:
            largest = np.maximum.accumulate(np.where(count[: room + 1] > 0, sizes[: room + 1], -1))  # that is waiting and no longer than so much
            one = int(largest[room])
            if one < 0:
                break
            first = np.flatnonzero(count[: room + 1])
            second = largest[room - first]
            again = (second == first) & (count[first] == 1)  # only one of that length is left
            second[again] = np.where(first[again] > 0, largest[np.minimum(first[again] - 1, room - first[again])], -1)
            both = np.where(second >= 0, first + second, -1)
            best = int(np.argmax(both))
            if both[best] > one:
                take(int(first[best]))
                take(int(second[best]))
                room -= int(both[best])
            else:
                take(one)
                room -= one
        b += 1
    return out


class Island:
    """Groupings of one shard's pieces. A grouping is an array: the bin of each piece, bins numbered from 0."""

    def __init__(self, lengths: np.ndarray, capacity: int, rng: np.random.Generator):
        self.lengths, self.capacity, self.rng = lengths.astype(np.int64), capacity, rng

    def fresh(self, noise: float) -> np.ndarray:
        """Best fit, longest first; with noise, the order is a little off."""
        order = np.argsort(-self.lengths * (1 + noise * self.rng.standard_normal(len(self.lengths))), kind="stable")
        bins, _ = best_fit(self.lengths[order].tolist(), [], self.capacity)
        out = np.empty(len(order), dtype=np.int64)
        out[order] = bins
        return out

    def fills(self, group: np.ndarray) -> np.ndarray:
        return np.bincount(group, weights=self.lengths).astype(np.int64)

    def value(self, group: np.ndarray) -> tuple[int, float]:
        """Fewer bins, then fuller ones: larger is better."""
        fill = self.fills(group)
        return -int((np.bincount(group) > 0).sum()), float(((fill / self.capacity) ** 2).sum())

    def put_back(self, group: np.ndarray, loose: np.ndarray) -> np.ndarray:
        """loose: pieces without a bin, whatever group says; the bins of the others are renumbered."""
        out = group.copy()
        stay = np.ones(len(group), dtype=bool)
        stay[loose] = False
        names, out[stay] = np.unique(group[stay], return_inverse=True)
        room = self.capacity - np.bincount(out[stay], weights=self.lengths[stay], minlength=len(names)).astype(np.int64)
        loose = loose[np.argsort(-self.lengths[loose], kind="stable")]
        out[loose], _ = best_fit(self.lengths[loose].tolist(), room.tolist(), self.capacity)
        return out

    def paired(self, group: np.ndarray, loose: np.ndarray) -> np.ndarray:
        """loose as in put_back, but put into new bins, by pairs."""
        out = group.copy()
        out[loose] = group.max() + 1 + np.array(fit_by_pairs(self.lengths[loose].tolist(), self.capacity), dtype=np.int64)
        return np.unique(out, return_inverse=True)[1]

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Some of the fuller half of b's bins go into a whole; a's bins that share a piece with them are taken out."""
        fill = self.fills(b)
        bins = np.flatnonzero(np.bincount(b))
        fullest = bins[np.argsort(-fill[bins], kind="stable")][: -(-len(bins) // 2)]
        given = np.isin(b, self.rng.choice(fullest, -(-len(fullest) // 2), replace=False))
        out_of_a = np.isin(a, np.unique(a[given])) & ~given
        child = np.where(given, b + a.max() + 1, a)
        return self.put_back(child, np.flatnonzero(out_of_a))

    def mutate(self, group: np.ndarray) -> np.ndarray:
        """The least filled bins and a few others are opened."""
        fill = self.fills(group)
        bins = np.flatnonzero(fill)
        worst = bins[np.argsort(fill[bins], kind="stable")[: max(2, len(bins) // 20)]]
        some = self.rng.choice(bins, max(1, len(bins) // 20), replace=False)
        loose = np.flatnonzero(np.isin(group, np.concatenate([worst, some])))
        return self.put_back(group, loose) if self.rng.random() < 0.5 else self.paired(group, loose)

    def evolve(self, start: list[np.ndarray]) -> np.ndarray:
        bound = -(-int(self.lengths.sum()) // self.capacity)
        whole = np.arange(len(self.lengths))
        first: list[Callable] = [lambda: self.fresh(0.0), lambda: self.paired(np.zeros(len(whole), dtype=np.int64), whole)]
        people = [(self.value(x), x) for x in start]
        while len(people) < POPULATION and not any(-v[0] <= bound for v, _ in people):  # else no grouping has fewer bins
            new = first.pop(0)() if first and not start else self.fresh(0.02)
            people.append((self.value(new), new))
        people.sort(key=lambda p: p[0], reverse=True)
        idle = 0
        for _ in range(GENERATIONS):
            if -people[0][0][0] <= bound or idle >= STAGNATION:
                break
            before = people[0][0]
            i, j = self.rng.choice(len(people), 2, replace=False)
            children = [self.cross(people[i][1], people[j][1]), self.cross(people[j][1], people[i][1]), self.mutate(people[0][1])]
            people = sorted([*people, *((self.value(c), c) for c in children)], key=lambda p: p[0], reverse=True)[:POPULATION]
            idle = 0 if people[0][0] > before else idle + 1
        return people[0][1]


def _epoch(capacity: int, seed: int, number: int) -> Callable:
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            elites = []
            for shard, island, lengths, *start in batch[["shard", "island", "lengths", "elite", "migrant"]].itertuples(index=False, name=None):
                own = Island(np.asarray(lengths, dtype=np.int64), capacity, np.random.default_rng([seed, number, shard, island]))
                elites.append(own.evolve([np.asarray(x, dtype=np.int64) for x in start if x is not None]).astype(np.int32))
            yield pd.DataFrame({"shard": batch["shard"], "island": batch["island"], "elite": elites})

    return run


def _best(capacity: int) -> Callable:
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, items, lengths, elites in batch[["shard", "items", "lengths", "elites"]].itertuples(index=False, name=None):
                own = Island(np.asarray(lengths, dtype=np.int64), capacity, np.random.default_rng(0))
                group = max((np.asarray(x, dtype=np.int64) for x in elites), key=own.value)
                fill = own.fills(group)[group]
                order = np.lexsort((np.arange(len(group)), group))
                ends = np.cumsum(own.lengths[order])
                first = np.concatenate([[True], np.diff(group[order]) > 0])
                offset = np.empty(len(group), dtype=np.int64)
                offset[order] = ends - own.lengths[order] - np.repeat((ends - own.lengths[order])[first], np.diff(np.append(np.flatnonzero(first), len(group))))
                yield pd.DataFrame({"row": np.asarray(items), "length": own.lengths, "shard": shard, "bin": group, "offset": offset, "fill": fill})

    return run


def _round(pieces: DataFrame, count: int, capacity: int, seed: int) -> DataFrame:
    """row, length, shard, bin, offset, fill for pieces (row, length), by one run of islands."""
    shards = max(1, -(-count // SHARD_PIECES))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(shards)).cast("int"))
    pairs = F.sort_array(F.collect_list(F.struct("row", "length")))  # of SHARD_PIECES rows on average, by hash
    problem = dealt.groupBy("shard").agg(pairs.alias("pairs")).select("shard", F.col("pairs.row").alias("items"), F.col("pairs.length").alias("lengths"))
    problem = kept(problem, "shards")
    islands = problem.select("shard", "lengths", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    state = None
    for number in range(EPOCHS):
        start = islands.withColumns({"elite": F.lit(None).cast("array<int>"), "migrant": F.lit(None).cast("array<int>")})
        if state is not None:
            sent = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("migrant"))
            start = islands.join(state, ["shard", "island"]).join(sent, ["shard", "island"])
        tasks = max(1, min(shards * ISLANDS, 20_000))
        state = kept(start.repartition(tasks, "shard", "island").mapInPandas(_epoch(capacity, seed, number), "shard int, island int, elite array<int>"), "islands")
    found = problem.join(state.groupBy("shard").agg(F.collect_list("elite").alias("elites")), "shard")
    return found.mapInPandas(_best(capacity), "row long, length long, shard int, bin long, offset long, fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, seed: int = SEED) -> DataFrame:
    """For pieces (row: a unique long, length): row, sequence_id, offset. Pieces of full length are sequences by themselves."""
    pieces = pieces.select("row", F.col("length").cast("long").alias("length"))
    if pieces.where(F.col("length") > capacity).limit(1).count():
        raise ValueError("a piece is longer than a sequence")
    number = lambda level: F.lit(level << 60) + F.shiftleft(F.col("shard").cast("long"), 24) + F.col("bin")
    parts = [pieces.where(F.col("length") == capacity).select("row", (F.lit(-1) - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, level, before = pieces.where(F.col("length") < capacity), 0, None
    while True:
        count = left.count()
        packed = kept(_round(left, count, capacity, seed + level), "packed")
        last = count <= SHARD_PIECES or level == MOST_LEVELS or (before is not None and count > before / 2)
        done = packed if last else packed.where(F.col("fill") >= WELL_FILLED * capacity)
        parts.append(done.select("row", number(level).alias("sequence_id"), "offset"))
        if last:
            break
        left, level, before = packed.where(F.col("fill") < WELL_FILLED * capacity).select("row", "length"), level + 1, count
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_PIECES = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}


def _pieces(tokenizer: str, end_id: int, capacity: int) -> Callable:
    import pyarrow as pa

    kinds = [{"int": pa.int32(), "long": pa.int64()}[k] for k in _PIECES.values()]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = table(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            texts = (t.as_py() for t in batch.column("text"))  # one after the other, not all at once
            for i, ids in zip(batch.column("doc_id"), words.encode_all(texts), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    cut = ids[a : a + capacity]
                    out.append((i.as_py(), k, a, len(cut), zlib.crc32(cut.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(list(zip(*out, strict=True)) or [()] * len(kinds), kinds, strict=True)], list(_PIECES))

    return run


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and row, a number of its own for each piece. Null text: only the end id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer, end_id, capacity), ", ".join(f"{c} {k}" for c, k in _PIECES.items()))
    return kept(rows.withColumn("row", F.monotonically_increasing_id()), "pieces")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer, end_id, capacity)
    return pieces.join(pack(pieces, capacity), "row").drop("row")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0)

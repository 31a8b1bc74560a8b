"""Runs of words: maximal periodic stretches of each document, found with suffix trees, and texts with their runs collapsed.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least
max(least, exponent * q) words, that no neighbouring word extends. All work is within a document, so documents are
dealt over tasks as they are read and nothing is shuffled.

1. Regions. A run of period q has (exponent - 1) * q places or more in a row at which a word recurs q words on; for q of 9 or
   more the same holds of eight words at once, all but the last seven. Places where no such stretch is possible, at any q, are
   cut away: the whole text is looked at, what remains covers every run with all of its words, and mere
   prose leaves nothing. The test is one of need: equal hashes of unlike words only leave more.
2. Trees. Of regions, put together with gaps that match nothing, and of their reversal a suffix tree is built by Ukkonen's algorithm. The smallest depth of parents
   between two leaves of the tour is the depth of their lowest common ancestor: a sparse table gives it in constant time,
   and so the longest common extension of any two places, forwards and backwards.
3. Roots. By the runs theorem each run has a root that is the longest Lyndon word at its place, in the order of words or in
   the opposite one. These are known from the next smaller suffix, in both orders of the tree's children: two candidates a
   place. Each is extended in both directions; what is long enough is a run, and equal ones are one.

Hashes of words serve to find regions; in a region words are compared by their bytes.

Cases: null and empty texts, and texts of separators alone, have no words and no runs; long texts are read whole (a document
is one task's, and the trees of a region take some hundred bytes a word); words are told apart by case; repeated rows and
null identifiers are rows of their own; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read_table

WORD = r"[^\x20\x09-\x0D]+"
LEAST, EXPONENT = 6, 4
#: Periods that are compared place by place; longer ones by stretches of so many words at once.
SHORT = 8
#: Bytes of documents that are looked at together; a longer document is looked at alone.
BYTES_AT_ONCE = 2_000_000
#: Regions are put together, with gaps between them, into trees of about so many words.
WORDS_IN_TREE = 50_000

_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class SuffixTree:
    """Ukkonen's tree of a list of whole numbers from 1 to many and an end mark, 0, with longest common extensions. Numbers up to
    gaps stand between stretches: each is there once, and first in either order."""

    def __init__(self, symbols: list[int], gaps: int, many: int) -> None:
        self.n = len(symbols)
        below, start, end = _ukkonen([*symbols, 0], many + 1)
        keys = np.fromiter(below.keys(), np.int64, len(below))
        child = np.fromiter(below.values(), np.int64, len(below))
        del below
        order = np.argsort(keys)
        parents, marks = np.divmod(keys[order], many + 1)
        child, nodes = child[order], len(start)
        first = np.searchsorted(parents, np.arange(nodes + 1))  # of a node's edges
        self.parent = np.zeros(nodes, dtype=np.int64)
        self.parent[child] = parents
        size = np.array(end, dtype=np.int64) - np.array(start, dtype=np.int64)
        self.depth = np.zeros(nodes, dtype=np.int64)
        levels = []  # edges from the root on, those of one node side by side
        front = np.zeros(1, dtype=np.int64)
        while True:
            count = first[front + 1] - first[front]
            upto = np.cumsum(count)
            if not upto[-1]:
                break
            edges = np.repeat(first[front] - (upto - count), count) + np.arange(upto[-1])
            self.depth[child[edges]] = self.depth[parents[edges]] + size[child[edges]]
            levels.append((edges, np.repeat(upto - count, count)))
            front = child[edges]
            front = front[first[front] != first[front + 1]]
            if not len(front):
                break
        under = np.ones(nodes, dtype=np.int64)  # nodes under each, itself included
        for edges, _ in reversed(levels):
            np.add.at(under, parents[edges], under[child[edges]])
        gap = marks <= gaps
        of_gaps = np.bincount(parents[gap], under[child[gap]], nodes).astype(np.int64)
        self.place, opposite = np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=np.int64)
        for edges, begun in levels:
            own, up = child[edges], parents[edges]
            upto = np.concatenate([[0], np.cumsum(under[own])])
            before = upto[:-1] - upto[begun]
            self.place[own] = self.place[up] + 1 + before
            opposite[own] = opposite[up] + 1 + np.where(gap[edges], before, under[up] - 1 - before - under[own] + of_gaps[up])
        leaves = np.flatnonzero(first[1:] == first[:-1])
        leaf_of = np.empty(self.n + 1, dtype=np.int64)  # of each suffix
        leaf_of[self.n + 1 - self.depth[leaves]] = leaves
        self.at, self.opposite = self.place[leaf_of], opposite[leaf_of]
        tour = np.empty(nodes, dtype=np.int64)
        tour[self.place] = np.arange(nodes)
        self.table = [self.depth[self.parent[tour]].astype(np.int32)]
        while len(self.table[-1]) > 1 << len(self.table) - 1:
            last, by = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-by], last[by:]))

    def ranks(self, opposite: bool) -> np.ndarray:
        """Numbers in the order of the suffixes; what a gap or the end cuts off comes first in either order."""
        return (self.opposite if opposite else self.at)[: self.n]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the suffixes at a and at b, another place each, agree."""
        low, high = np.minimum(self.at[a], self.at[b]) + 1, np.maximum(self.at[a], self.at[b]) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level):
            own = level == k
            found[own] = np.minimum(self.table[k][low[own]], self.table[k][high[own] - (1 << k)])
        return found


def _ukkonen(s: list[int], width: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Edges (node * width + first symbol -> node), and where each node's label starts and ends. The last symbol is nowhere else."""
    n = len(s)
    start, end, link, below = [0], [0], [0], {}
    node = edge = length = due = 0
    nodes = 1
    for i, c in enumerate(s):
        due += 1
        waits = 0  # an inner node whose link is not known yet
        while due:
            if not length:
                key = node * width + c
                if key in below:
                    edge, length = i, 1
                    if waits:
                        link[waits] = node
                    break
                below[key] = nodes
                nodes += 1
                start.append(i)
                end.append(n)
                link.append(0)
                if waits:
                    link[waits] = node
                    waits = 0
            else:
                key = node * width + s[edge]
                nxt = below[key]
                begun = start[nxt]
                size = end[nxt] - begun  # a leaf's label is never walked to its end
                if length >= size:
                    edge += size
                    length -= size
                    node = nxt
                    continue
                if s[begun + length] == c:
                    length += 1
                    if waits:
                        link[waits] = node
                    break
                split, nodes = nodes, nodes + 2
                middle = begun + length
                start += (begun, i)
                end += (middle, n)
                link += (0, 0)
                below[key] = split
                below[split * width + c] = split + 1
                start[nxt] = middle
                below[split * width + s[middle]] = nxt
                if waits:
                    link[waits] = split
                waits = split
            due -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - due + 1
    return below, start, end


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller rank; behind the last place if there is none."""
    ranks, n = [*rank.tolist(), -1], len(rank)
    found = [n] * n
    for i in range(n - 1, -1, -1):
        j, own = i + 1, ranks[i]
        while ranks[j] > own:
            j = found[j]
        found[i] = j
    return np.array(found, dtype=np.int64)


def runs_of(stretches: list[np.ndarray], least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """All runs (stretch, start, length, period) of sequences of whole numbers, by stretch, start, then period."""
    sizes = np.array([len(x) for x in stretches], dtype=np.int64)
    if not sizes.sum():
        return np.zeros((0, 4), dtype=np.int64)
    begun = np.cumsum(sizes + 1) - sizes - 1
    gap = begun[1:] - 1
    values, named = np.unique(np.concatenate(stretches), return_inverse=True)
    n, gaps, many = int(sizes.sum()) + len(gap), len(gap), len(gap) + len(values)
    symbols = np.empty(n, dtype=np.int64)
    word = np.ones(n, dtype=bool)
    word[gap] = False
    symbols[gap], symbols[word] = np.arange(1, gaps + 1), named + gaps + 1
    there, back = (SuffixTree(x.tolist(), gaps, many) for x in (symbols, symbols[::-1]))
    i = np.tile(np.flatnonzero(word), 2)
    j = np.concatenate([next_smaller(there.ranks(opposite))[word] for opposite in (False, True)])
    after, before = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)
    inner = j < n
    after[inner] = there.extension(i[inner], j[inner])
    inner = i > 0
    before[inner] = back.extension(n - i[inner], n - j[inner])
    found = np.stack([i - before, j + after - i + before, j - i], axis=1)
    found = found[(found[:, 1] >= exponent * found[:, 2]) & (found[:, 1] >= least)]
    found = np.unique(found, axis=0)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    of = np.searchsorted(begun, found[:, 0], side="right") - 1
    return np.concatenate([of[:, None], found - np.stack([begun[of], 0 * of, 0 * of], axis=1)], axis=1)


def _stretches(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    start, end = edges[::2], edges[1::2]
    long = end - start >= least
    return start[long], end[long]


def regions(symbols: np.ndarray, doc: np.ndarray, last: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """Stretches apart from each other that hold every run with all of its places. symbols: of documents one behind another, equal for
    equal words; doc: the document of each, from 0 on; last: where each document ends."""
    n = len(symbols)
    longest = int(np.diff(last, prepend=0).max()) if n else 0
    starts, ends = [], []

    def add(mask: np.ndarray, enough: int, period: int, at_once: int) -> None:
        if np.count_nonzero(mask) >= enough:
            a, b = _stretches(mask, enough)
            on = np.minimum(period, (b - a + at_once - 1) // (exponent - 1)) + at_once - 1
            starts.extend(a.tolist())
            ends.extend(np.minimum(b + on, last[doc[a]]).tolist())

    for q in range(1, min(SHORT, longest // exponent) + 1):
        add((symbols[:-q] == symbols[q:]) & (doc[:-q] == doc[q:]), max(max(least, exponent * q) - q, 1), q, 1)
    if longest >= exponent * (SHORT + 1):
        hashed = symbols
        for by in (1, 2, 4):  # of two, four, eight words
            hashed = (hashed[:-by] ^ hashed[:-by] >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) + hashed[by:]
        order = np.argsort(hashed, kind="stable")
        again = np.flatnonzero(hashed[order[1:]] == hashed[order[:-1]])
        if len(again):
            here, there = order[again], order[again + 1]
            own = doc[here] == doc[there + SHORT - 1]
            on = np.full(len(hashed), n, dtype=np.int64)
            on[here[own]] = there[own] - here[own]
            most = 2 * SHORT
            while (most // 2 + 1) * exponent <= longest:
                add(on <= most, max((exponent - 1) * (most // 2 + 1) - SHORT + 1, 1), most, SHORT)
                most *= 2
    found: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if found and a <= found[-1][1] and doc[a] == doc[found[-1][0]]:
            found[-1] = found[-1][0], max(b, found[-1][1])
        else:
            found.append((a, b))
    return found


_POWERS: dict[str, np.ndarray] = {}
_STEP = 0x9E3779B97F4A7C15


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word's bytes, equal for equal words."""
    if len(_POWERS.get("up", ())) < len(data) + 1:
        for name, step in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            steps = np.full(len(data) + 1, step, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS["up"][: len(data)])])
    found = (sums[ends] - sums[starts]) * _POWERS["down"][starts]
    return (found ^ found >> np.uint64(29)) * np.uint64(_STEP)


def document_runs(data: np.ndarray, edges: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """For documents in UTF-8 one behind another: how many words each has, the runs of all of them (document, start, length, period) and
    the words that stay, as text: where each document's starts, and bytes. edges: where documents start and end."""
    blank = (data == 32) | (data - np.uint8(9) < 5)
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[edges] = True
    starts = np.flatnonzero(~blank & (np.concatenate([[True], blank])[:-1] | cut[:-1]))
    ends = np.flatnonzero(~blank & (np.concatenate([blank, [True]])[1:] | cut[1:])) + 1
    of = np.searchsorted(starts, edges)  # a document's first word
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(of))
    found: list[np.ndarray] = []
    held: list[np.ndarray] = []
    names: dict[bytes, int] = {}
    areas = regions(_hashed(data, starts, ends), doc, of[1:], least, exponent)
    for k, (a, b) in enumerate(areas):
        held.append(np.array([names.setdefault(data[x:y].tobytes(), len(names)) for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)], dtype=np.int64))
        if k + 1 == len(areas) or sum(map(len, held)) > WORDS_IN_TREE:
            runs = runs_of(held, least, exponent)
            begun = np.array([x for x, _ in areas[k + 1 - len(held) : k + 1]])[runs[:, 0]]
            found.append(np.stack([doc[begun], begun + runs[:, 1], runs[:, 2], runs[:, 3]], axis=1))
            held, names = [], {}
    runs = np.concatenate(found) if found else np.zeros((0, 4), dtype=np.int64)
    gone = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(gone, runs[:, 1] + runs[:, 3], 1)
    np.add.at(gone, runs[:, 1] + runs[:, 2], -1)
    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    runs[:, 1] -= of[runs[:, 0]]
    # Of a word that stays, its bytes and, if another follows in its document, the byte behind it, as a space.
    follows = np.zeros(len(stay), dtype=bool)
    follows[:-1] = doc[stay[1:]] == doc[stay[:-1]]
    taken = np.zeros(len(data) + 2, dtype=np.int8)
    taken[starts[stay]] += 1
    taken[ends[stay] + follows] -= 1
    taken = np.cumsum(taken[: len(data)], dtype=np.int8).view(bool)
    spaced = data.copy()
    spaced[ends[stay[follows]]] = 32
    sizes = np.concatenate([[0], np.cumsum(taken, dtype=np.int64)])
    return np.diff(of), runs, (sizes[edges], spaced[taken])


def _collapsed(keep: list[str], least: int, exponent: int) -> Callable:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
            edges = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
            at = 0
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(edges, edges[at] + BYTES_AT_ONCE, side="right")) - 1)
                words, runs, (begun, left) = document_runs(data[edges[at] : edges[to]], edges[at : to + 1] - edges[at], least, exponent)
                flat = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(runs[:, 0], np.arange(to - at + 1)).astype(np.int32)), flat)
                texts = pa.Array.from_buffers(pa.large_string(), to - at, [None, pa.py_buffer(begun.tobytes()), pa.py_buffer(left.tobytes())]).cast(pa.string())
                own = batch.select(keep).slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(words.astype(np.int64)), lists, texts], names=[*own.schema.names, "n_words", "runs", "collapsed"])
                at = to

    return run


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """keep, n_words, runs (start, length, period; by start, then period) and collapsed: the words, one space between them, without
    those that a run holds after its first period. docs: keep, text."""
    if exponent < 2:
        raise ValueError("a run has its period twice at least")
    own = docs.select(*keep, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*keep).schema)
    return own.mapInArrow(_collapsed(list(keep), least, exponent), f"{kinds}, n_words long, runs {_RUNS}, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text; where the checksum of doc_id ends in 0, the words from some place on repeat, as the query's contract has it."""
    sum32 = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = docs.select("doc_id", "text", sum32.alias("h"), F.floor(sum32 / 10).cast("long").alias("g"))
    words: Column = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    own = own.withColumn("words", words).withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    own = own.withColumn("p", p).withColumn("body", F.when(F.col("n") > 0, F.slice("words", F.col("a") + 1, F.col("p"))))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat("body", times)), F.lit(1), F.col("n") - F.col("a"))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return own.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of whole texts; the longest of each document, and digests of all of them and of the collapsed text."""
    found = periodic_runs(with_repeats(read_table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

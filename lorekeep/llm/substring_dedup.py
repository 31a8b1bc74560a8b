"""Removal of repeated substrings: prefix doubling on sampled positions.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the same document or another.

Doubling over every position would sort each byte's rank pair in every round. Here Spark sorts ranks of sampled positions
only, and a position is dropped as soon as its rank is unique:

1. Each string of LENGTH bytes has an anchor, the place of its least SEED-byte piece by hash (leftmost, if several are
   equal). Equal strings have equal anchors at equal distances, and a hundred neighbouring strings share one. Anchors are
   ranked by their SEED bytes; those whose rank is unique are dropped, with all strings they stand for.
2. An anchor's strings are parted by distance into two blocks. A block is ranked by its core, the bytes that all its
   strings share (about half of LENGTH and more), and by its hull, the bytes of them all. Blocks whose core is unique are
   dropped; blocks whose hull is not unique are settled, all their strings are repeated.
3. What remains, the borders of repeats, is parted into PARTS smaller blocks, ranked by longer cores and shorter hulls, and
   dropped or settled in the same way. One block of each settled hull takes part, as evidence for the others.
4. What remains of these is ranked string by string at full LENGTH.

A rank is a 64-bit hash of the bytes at that length; strings are told apart by core and hull, or core and string, together.
Counting pre-aggregates before it shuffles, so a passage that a third of all documents share makes no large group, and
no pairs are formed. Texts are shuffled once to those documents that have a repeated anchor.

Null and short texts lose nothing. Texts are UTF-8 bytes; what remains may cut a character. Repeated and null doc_ids are
documents of their own. An empty table gives no rows. Very long texts are handled in stretches that overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, kept, numbered, read_table, shuffle_partitions
from .shingles import mixed

LENGTH = 200
SEED = 32
#: Blocks that a block is parted into, by round.
PARTS = (2, 8)
BYTES_AT_ONCE = 1 << 20
_POSITION_BITS = 24
_VALUE = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 2 * BYTES_AT_ONCE), base, np.uint64)]))
    return _POWERS[base]


_DISTANCE_BITS = 8
_DISTANCE = (1 << _DISTANCE_BITS) - 1


def packed(place: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """A place with the least and largest distance of its strings, as one number."""
    return (place << 2 * _DISTANCE_BITS) | (near << _DISTANCE_BITS) | far


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 2 * _DISTANCE_BITS, at >> _DISTANCE_BITS & _DISTANCE, at & _DISTANCE


class Hashes:
    """Hashes of any stretches of a byte array."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[raw] * _powers(_BASE, len(raw))[: len(raw)])])
        self.backs = _powers(_BACK, len(raw) + 1)

    def of(self, start, stop) -> np.ndarray:
        start, stop = np.asarray(start), np.asarray(stop)
        return mixed((self.sums[stop] - self.sums[start]) * self.backs[start] + (stop - start).astype(np.uint64))


def anchors(raw: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(place, least distance, largest distance, rank of the seed) of the anchors of all strings of an array."""
    n = len(raw) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    h = Hashes(raw)
    at = np.arange(len(raw) - seed + 1)
    rank = h.of(at, at + seed)
    least = (rank >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS)) | at.astype(np.uint64)
    width, span = 1, length - seed + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: n], least[span - width : span - width + n])
    place = (least[:n] & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], n) - 1
    place = place[first]
    return place, place - last, place - first, rank[place]


def _stretches(raw: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes): stretches that have each string of a text once."""
    step = 1 << (_POSITION_BITS - 2)
    for a in range(0, max(len(raw) - length + 1, 0), step):
        yield a, np.frombuffer(raw[a : a + step + length - 1], dtype=np.uint8)


def _find_anchors(length: int, seed: int) -> Callable:
    def flush(rows: list[int], texts: list[bytes]) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        begins = np.cumsum([0, *map(len, texts)])
        place, near, far, rank = anchors(raw, length, seed)
        # Anchors of strings that cross from one text into the next: cut to those that lie in one text.
        of = np.searchsorted(begins, place, side="right") - 1
        far = np.minimum(far, place - begins[of])
        near = np.maximum(near, place + length - begins[of + 1])
        good = near <= far
        return pd.DataFrame({"row": np.array(rows, dtype=np.int64)[of[good]], "at": packed((place - begins[of])[good], near[good], far[good]), "rank": rank[good].view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, texts, size = [], [], 0
            for row, text in zip(batch["row"].tolist(), batch["text"].tolist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) > BYTES_AT_ONCE:
                    for offset, part in _stretches(raw, length):
                        yield flush([row], [part.tobytes()]).assign(at=lambda x, o=offset: x["at"] + (o << 2 * _DISTANCE_BITS))
                    continue
                if size + len(raw) > BYTES_AT_ONCE:
                    yield flush(rows, texts)
                    rows, texts, size = [], [], 0
                rows.append(row)
                texts.append(raw)
                size += len(raw)
            if texts:
                yield flush(rows, texts)

    return run


#: Columns of blocks that go with the text of their document.
_NAMES = ["at", "low", "high", "core", "n"]
_BLOCK = "row long, at long, low smallint, high smallint, core long, n int"


def _texts_at_once(of_text: Callable, frame: Callable) -> Callable:
    """Applies of_text to the bytes and blocks of each document; frame makes bounded batches of what it found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, found, size = [], [], 0
            for row, text, *own in batch[["row", "text", *_NAMES]].itertuples(index=False, name=None):
                rows.append(row)
                found.append(of_text(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), *(np.asarray(x, dtype=np.int64) for x in own)))
                size += len(found[-1][0])
                if size > 50_000:
                    yield frame(rows, found)
                    rows, found, size = [], [], 0
            if found:
                yield frame(rows, found)

    return run


def _ranks(length: int, parts: int) -> Callable:
    """The smaller blocks of a document's blocks, with the ranks of core and hull (null where the hull leaves the text)."""

    def of_text(raw: np.ndarray, at, low, high, core, n) -> tuple[np.ndarray, ...]:
        h = Hashes(raw)
        place, near, far = unpacked(at)
        order = np.lexsort((low, place))
        place, near, far, low, high, core, n = (x[order] for x in (place, near, far, low, high, core, n))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(place) > 0) | (np.diff(low) > 0)]))
        near, far = np.minimum.reduceat(near, new), np.maximum.reduceat(far, new)  # an anchor that two stretches share
        place, low, high, core, n = (x[new] for x in (place, low, high, core, n))
        step = -(-(high - low + 1) // parts)
        part = np.tile(np.arange(parts), len(place))
        place, near, far, low, high, core, n, step = (np.repeat(x, parts) for x in (place, near, far, low, high, core, n, step))
        low, high = low + part * step, np.minimum(high, low + (part + 1) * step - 1)
        good = (low <= high) & (near <= high) & (far >= low)
        place, near, far, low, high, core, n, part = (x[good] for x in (place, near, far, low, high, core, n, part))
        near, far = np.maximum(near, low), np.minimum(far, high)
        own = mixed(core.view(np.uint64) + h.of(place - low, place - high + length) + part.astype(np.uint64)).view(np.int64)
        inside = (place - high >= 0) & (place - low + length <= len(raw))
        hull = h.of(np.where(inside, place - high, 0), np.where(inside, place - low + length, 0)).view(np.int64)
        return packed(place, near, far), low, high, own, n, hull, inside

    def frame(rows: list[int], found: list[tuple]) -> pd.DataFrame:
        at, low, high, core, n, hull, inside = (np.concatenate([f[k] for f in found]) for k in range(7))
        out = pd.DataFrame({"row": np.repeat(rows, [len(f[0]) for f in found]), "at": at, "low": low.astype(np.int16), "high": high.astype(np.int16), "core": core, "n": n.astype(np.int32)})
        out["hull"] = pd.arrays.IntegerArray(hull, ~inside)
        return out

    return _texts_at_once(of_text, frame)


def _strings(length: int) -> Callable:
    """Each string of a document's blocks, with its rank and the core of its block."""

    def of_text(raw: np.ndarray, at, low, high, core, n) -> tuple[np.ndarray, ...]:
        place, near, far = unpacked(at)
        many = far - near + 1
        start = np.repeat(place - far - np.cumsum(many) + many, many) + np.arange(many.sum())
        return start, np.repeat(core, many), Hashes(raw).of(start, start + length).view(np.int64), np.repeat(n, many)

    def frame(rows: list[int], found: list[tuple]) -> pd.DataFrame:
        start, core, rank, n = (np.concatenate([f[k] for f in found]) for k in range(4))
        return pd.DataFrame({"row": np.repeat(rows, [len(f[0]) for f in found]), "start": start, "core": core, "rank": rank, "n": n.astype(np.int32)})

    return _texts_at_once(of_text, frame)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row, text, spans in batch[["row", "text", "spans"]].itertuples(index=False, name=None):
            raw = text.encode("utf-8", "surrogatepass")
            at, removed, runs, rest = 0, 0, 0, hashlib.sha256()
            start = stop = -1
            for s in [*sorted((s["start"], s["stop"]) for s in spans), (len(raw) + 1, 0)]:
                if s[0] > stop:
                    if stop >= 0:
                        rest.update(raw[at:start])
                        at, removed, runs = stop, removed + stop - start, runs + 1
                    start = s[0]
                stop = max(stop, s[1])
            rest.update(raw[at:])
            out.append((row, removed, runs, rest.hexdigest()))
        yield pd.DataFrame(out, columns=["row", "n_removed", "n_spans", "kept_sha256"])


def _by_row(blocks: DataFrame) -> DataFrame:
    """A row for each document, with its blocks as arrays."""
    own = blocks.groupBy("row").agg(F.collect_list(F.struct(*_NAMES)).alias("own"))  # of one document
    return own.select("row", *(F.col(f"own.{c}").alias(c) for c in _NAMES))


def _round(joined: DataFrame, length: int, parts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans of settled blocks, what remains of the others, the table that is read for these) after the blocks of texts have been parted and ranked."""
    parted = joined.mapInPandas(_ranks(length, parts), f"{_BLOCK}, hull long")
    # A hull that leaves its text stands for itself.
    parted = kept(parted.withColumn("hull", F.coalesce("hull", F.xxhash64("row", "at", "low"))), "blocks")
    hulls = kept(parted.groupBy("core", "hull").agg(F.sum("n").alias("n"), F.min(F.struct("row", "at", "low", "high")).alias("one")), "hulls")
    settled = parted.join(hulls.where("n > 1").select("core", "hull"), ["core", "hull"], "left_semi")
    place = F.shiftright("at", 2 * _DISTANCE_BITS)
    spans = kept(settled.select("row", (place - F.col("high")).alias("start"), (place - F.col("low") + length).alias("stop")), "spans")
    dropped(parted)
    # Cores with one hull are unique, or settled wholly.
    open_cores = kept(hulls.groupBy("core").agg(F.count("*").alias("hulls")).where("hulls > 1").select("core"), "open-cores")
    rest = hulls.join(open_cores, "core", "left_semi").select("one.*", "core", F.least("n", F.lit(2)).cast("int").alias("n"))
    return spans, rest, hulls


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(spans: row, start, stop of repeated stretches, which may overlap; texts: row, text of the documents that may have some)."""
    if length - seed >= 1 << _DISTANCE_BITS:
        raise ValueError(f"length may exceed seed by less than {1 << _DISTANCE_BITS}")
    texts = docs.where(F.octet_length("text") >= length).select("row", "text")
    found = kept(texts.mapInPandas(_find_anchors(length, seed), "row long, at long, rank long"), "anchors")
    # Written first, so that the join shuffles both its sides and a rank with very many places is split among tasks.
    again = kept(found.groupBy("rank").count().where("count > 1").select("rank"), "again")
    alive = kept(found.join(again, "rank", "left_semi").groupBy("row").agg(F.collect_list("at").alias("at")), "alive")  # of one document
    dropped(found)
    dropped(again)
    affected = kept(texts.join(alive, "row").select("row", "text", "at"), "affected")
    dropped(alive)
    same = lambda value, kind: F.transform("at", lambda x: F.lit(value).cast(kind))
    first = affected.withColumns({"low": same(0, "smallint"), "high": same(length - seed, "smallint"), "core": same(0, "long"), "n": same(1, "int")})
    settled, rest, read = _round(first, length, PARTS[0])
    affected = affected.select("row", "text")
    smaller, rest, read_again = _round(affected.join(_by_row(rest), "row"), length, PARTS[1])
    dropped(read)
    strings = affected.join(_by_row(rest), "row").mapInPandas(_strings(length), "row long, start long, core long, rank long, n int")
    strings = kept(strings, "strings")
    dropped(read_again)
    twice = kept(strings.groupBy("core", "rank").agg(F.sum("n").alias("n")).where("n > 1").select("core", "rank"), "twice")
    single = strings.join(twice, ["core", "rank"], "left_semi").select("row", "start", (F.col("start") + length).alias("stop"))
    return settled.unionByName(smaller).unionByName(single), affected


# --- Doubling over every position ------------------------------------------------------------------------------------
# The plain method, for small corpora: each position's rank pair is sorted in every round. It moves a row a byte of text and
# round, which README compares with the budget; tests hold the other way's spans against it.

_PAIRS = "row long, at long, first long, second long"


def _every_position(length: int, seed: int) -> Callable:
    """Every start of a string of length, with the hash of its first seed bytes, and those of the seeds further on in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["row"].tolist(), batch["text"].tolist(), strict=True):
                for offset, raw in _stretches(text.encode("utf-8", "surrogatepass"), length):
                    at = np.arange(len(raw) - seed + 1)
                    rank = Hashes(raw).of(at, at + seed).view(np.int64)
                    for a in range(0, len(at), 100_000):
                        yield pd.DataFrame({"row": row, "at": at[a : a + 100_000] + offset, "first": rank[a : a + 100_000], "second": 0})

    return run


def _ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by pair: those whose pair another row has too, with the pair's place in the order as their rank."""
    from pyspark import TaskContext

    number, held = TaskContext.get().partitionId() << 40, None
    for batch in batches:
        rows = batch[["row", "at", "first", "second"]].to_numpy()
        if held is not None:
            rows = np.concatenate([held[:1], rows])
        same = (rows[1:, 2:] == rows[:-1, 2:]).all(axis=1)
        before = np.concatenate([[held is not None and held.shape[0] > 1], same])  # whether the row before has the same pair
        after = np.concatenate([same, [False]])
        rank = number + np.cumsum(np.concatenate([[0], ~same]))
        last, number = rows[-1:], int(rank[-1])
        told = (before | after) & ~np.concatenate([[held is not None and held.shape[0] > 1], np.zeros(len(rows) - 1, bool)])
        told[-1] = before[-1] and len(rows) > 1
        yield pd.DataFrame({"row": rows[told, 0], "at": rows[told, 1], "rank": rank[told]})
        held = np.repeat(last, 2, axis=0) if before[-1] else last  # two: it has been told


def _paired(offset: int) -> Callable:
    """Of a document's ranked positions in order: pairs of the ranks at a position and at an offset from it; a position without
    its partner is unique at the greater length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"row": [], "at": [], "rank": []}, dtype="int64")
        for batch in batches:
            rows = pd.concat([held, batch[["row", "at", "rank"]]], ignore_index=True)
            cut = (rows["row"] == rows["row"].iloc[-1]) & (rows["at"] > rows["at"].iloc[-1] - offset)
            yield _pairs(rows, ~cut.to_numpy(), offset)
            held = rows[cut]
        if len(held):
            yield _pairs(held.reset_index(drop=True), np.ones(len(held), dtype=bool), offset)

    return run


def _pairs(rows: pd.DataFrame, wanted: np.ndarray, offset: int) -> pd.DataFrame:
    _, number = np.unique(rows["row"].to_numpy(), return_inverse=True)  # of rows in order: any identifiers will do
    key = (number << 40) + rows["at"].to_numpy()
    at = np.minimum(np.searchsorted(key, key + offset), len(key) - 1)
    good = wanted & (key[at] == key + offset)
    rank = rows["rank"].to_numpy()
    return pd.DataFrame({"row": rows["row"].to_numpy()[good], "at": rows["at"].to_numpy()[good], "first": rank[good], "second": rank[at[good]]})


def spans_by_doubling(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """row, start, stop of repeated stretches, by prefix doubling over every position: the ranks of lengths seed, 2 seed, 4 seed ...
    and at last length follow from sorts of pairs of ranks; what is unique is dropped in each round. docs: row, text."""
    n = shuffle_partitions(docs.sparkSession)
    pairs = docs.where(F.octet_length("text") >= length).select("row", "text").mapInPandas(_every_position(length, seed), _PAIRS)
    reach = seed
    while True:
        ranked = kept(pairs.repartitionByRange(n, "first", "second").sortWithinPartitions("first", "second").mapInPandas(_ranked, "row long, at long, rank long"), "ranks")
        if reach == length:
            return ranked.select("row", F.col("at").alias("start"), (F.col("at") + length).alias("stop"))
        offset = min(reach, length - reach)  # at the end, the two parts overlap
        pairs = ranked.repartition(n, "row").sortWithinPartitions("row", "at").mapInPandas(_paired(offset), _PAIRS)
        reach += offset


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = numbered(docs.select("doc_id", "text"))
    spans, affected = repeated_spans(docs, length)
    cut = affected.join(spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "row").mapInPandas(_cut, "row long, n_removed long, n_spans long, kept_sha256 string")
    text = F.coalesce("text", F.lit(""))
    plain = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own_sha256"))
    nothing = F.lit(0).cast("long")
    return plain.join(cut, "row", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", nothing).alias("n_removed"), F.coalesce("n_spans", nothing).alias("n_spans"), F.coalesce("kept_sha256", "own_sha256").alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))

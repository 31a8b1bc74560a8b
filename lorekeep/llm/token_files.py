"""Token ids as Arrow IPC files: record batches of fixed-size lists, so that every sequence is found by arithmetic.

A file holds batches of ``rows`` sequences of ``length`` ids (unsigned 16 bits where the vocabulary allows, else 32) and
a mask of equal shape, false where the last sequence of a file is padded. Documents follow each other without gaps, in
ascending order of identifier; a file's sequences are one range of that order. An index table (Parquet) has each
document's file, place and length. Files are read by memory mapping where they are local and by range reads elsewhere:
sequence k of a file is row k % rows of batch k // rows, without a copy.

A task that is run again writes a file of another name; the index names only files of tasks that ended, so a lost
executor leaves at most files that nothing refers to.

Null and empty texts are documents with only the end id. Repeated identifiers keep a place each, ordered by text; null
identifiers come first. An empty table gives no files and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_system, kept, lean, new_path, read_table, shuffle_partitions
from .tokens import table

_INDEX = "doc_id long, part int, file string, place long, n_tokens long"
_READ = "doc_id long, part int, place long, n_tokens long, ids_crc32 long"


def _writer(folder: str, tokenizer: str, end_id: int, length: int, rows: int) -> Callable:
    @lean
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, words = TaskContext.get().partitionId(), table(tokenizer)
        dtype = np.dtype("<u2" if max(len(words.ends), end_id + 1) <= 1 << 16 else "<u4")
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], {"length": str(length), "rows": str(rows)})
        store, at = file_system(folder)
        name, sink, out, held, n_held, place = f"part-{part:06d}-{uuid.uuid4().hex}.arrow", None, None, [], 0, 0

        def flush(last: bool) -> None:
            nonlocal held, n_held
            ids = np.concatenate(held) if held else np.zeros(0, dtype)
            whole = len(ids) if last else len(ids) // (rows * length) * rows * length
            now, rest = ids[:whole], ids[whole:]
            mask = np.ones(len(now), dtype=bool)
            if pad := -len(now) % length:
                now, mask = np.concatenate([now, np.zeros(pad, dtype)]), np.concatenate([mask, np.zeros(pad, bool)])
            for a in range(0, len(now), rows * length):
                cut = [pa.FixedSizeListArray.from_arrays(pa.array(x[a : a + rows * length]), length) for x in (now, mask)]
                out.write_batch(pa.record_batch(cut, schema=schema))
            held, n_held = [rest], len(rest)

        for batch in batches:
            if out is None:
                store.create_dir(at, recursive=True)
                sink = store.open_output_stream(f"{at}/{name}")
                out = pa.ipc.new_file(sink, schema)
            sizes = []
            for ids in words.encode_all(batch["text"].tolist()):
                held.append(np.append(ids, end_id).astype(dtype))
                sizes.append(len(ids) + 1)
                n_held += len(ids) + 1
                if n_held >= 4 * rows * length:
                    flush(False)
            sizes = np.array(sizes, dtype=np.int64)
            places = place + np.cumsum(sizes) - sizes
            place += int(sizes.sum())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "part": part, "file": name, "place": places, "n_tokens": sizes})
        if out is not None:
            flush(True)
            out.close()
            sink.close()

    return write


class TokenFile:
    """Random access to a file's ids without copies of more than what is asked for."""

    def __init__(self, folder: str, name: str):
        store, at = file_system(folder)
        path = f"{at}/{name}"
        self.source = pa.memory_map(path) if store.type_name == "local" else store.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        meta = self.file.schema.metadata
        self.length, self.rows = int(meta[b"length"]), int(meta[b"rows"])
        self.last: tuple[int, np.ndarray, pa.Array] | None = None

    def batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        if self.last is None or self.last[0] != k:
            got = self.file.get_batch(k)
            self.last = (k, got.column(0).flatten().to_numpy(), got.column(1).flatten())
        return self.last[1:]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence k."""
        ids, mask = self.batch(k // self.rows)
        a = k % self.rows * self.length
        return ids[a : a + self.length], mask[a : a + self.length].to_numpy(zero_copy_only=False)

    def span(self, place: int, n: int) -> Iterator[np.ndarray]:
        """The n ids from a place on, in pieces."""
        size = self.rows * self.length
        while n > 0:
            ids, mask = self.batch(place // size)
            a = place % size
            got = ids[a : a + n]
            if not len(got) or mask[a : a + len(got)].true_count != len(got):
                raise ValueError(f"place {place} lies in padding or beyond the file")
            yield got
            place, n = place + len(got), n - len(got)

    def close(self) -> None:
        self.last = None
        self.source.close()


def _reader(folder: str) -> Callable:
    @lean
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, own in batch.groupby("file", sort=False):
                file, crcs, counts = TokenFile(folder, name), [], []
                for place, n in zip(own["place"].tolist(), own["n_tokens"].tolist(), strict=True):
                    crc = count = 0
                    for ids in file.span(place, n):
                        crc, count = zlib.crc32(ids.astype("<u4").tobytes(), crc), count + len(ids)
                    crcs.append(crc)
                    counts.append(count)
                file.close()
                yield pd.DataFrame({"doc_id": own["doc_id"].astype("Int64"), "part": own["part"], "place": own["place"], "n_tokens": counts, "ids_crc32": crcs})

    return read


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048, rows: int = 64) -> tuple[str, DataFrame]:
    """Writes the files; their folder, and the index: doc_id, part, file, place, n_tokens."""
    spark = docs.sparkSession
    folder = new_path(spark, "token-files")
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shuffle_partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return folder, kept(placed.mapInPandas(_writer(folder, tokenizer, end_id, length, rows), _INDEX), "token-index")


def read_token_files(folder: str, index: DataFrame) -> DataFrame:
    """From the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    # A row for each file: bounded by the number of partitions.
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))
    read = index.mapInPandas(_reader(folder), _READ)
    return read.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_token_files(*write_token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1))

"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, then one frame per record.

Writing: rows are spread over tasks without regard to their payload; each task writes archives of bounded size, with a
dictionary trained on the first records of the archive. Of records with equal payloads, the one with the largest
page_id is a response and the others are revisits that refer to it, so a payload that a third of all rows share is
stored once. Which payloads repeat is found from digests, pre-aggregated before they are shuffled.

Reading: the dictionary is taken from the skippable frame (magic 0x184D2A5D, its content raw or itself compressed), each
frame is decoded as one record, and version line, required headers, block length, payload length, payload digest and
the closing blank lines are checked. A record that fails raises WarcError, with its place.

Null html is an empty payload; null url leaves out WARC-Target-URI. Rows that repeat the page_id of a response and its
payload are responses too. Null page_ids are never referred to: among equal payloads without any other id, all are
responses. An empty table gives no archives and no rows. An archive that a lost executor left behind is in no manifest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, kept, lean, new_path, read_table

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An archive is closed at this size; its dictionary is trained on this many bytes of its first records.
ARCHIVE_BYTES = 64 << 20
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Tasks that read archives, at most.
MOST_READERS = 20_000


class WarcError(ValueError):
    pass


def record_id(page_id: int | None) -> str:
    return f"<urn:lorekeep:page:{'' if page_id is None else page_id}>"


def _page_id(urn: str) -> int | None:
    found = urn.strip("<>").rpartition(":")[2]
    return int(found) if found else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit that keeps the HTTP headers (with the payload's length) and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=-._~"),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Refers-To": None if refers_to is None else record_id(refers_to),
        "WARC-Profile": None if refers_to is None else IDENTICAL,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Writes records to archives in a folder; each archive is closed at ARCHIVE_BYTES."""

    def __init__(self, folder: str):
        self.folder = folder
        self.store, self.at = file_system(folder)
        self.held: list[bytes] = []
        self.n_held = 0
        self.sink, self.name, self.size, self.records = None, "", 0, 0

    def add(self, raw: bytes) -> Iterator[tuple[str, int, int]]:
        self.records += 1
        if self.sink is None:
            self.held.append(raw)
            self.n_held += len(raw)
            if self.n_held >= SAMPLE_BYTES:
                self.begin()
        else:
            self.write(self.packer.compress(raw))
        if self.size >= ARCHIVE_BYTES:
            yield self.end()

    def write(self, data: bytes) -> None:
        self.sink.write(data)
        self.size += len(data)

    def begin(self) -> None:
        self.store.create_dir(self.at, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.sink = self.store.open_output_stream(f"{self.at}/{self.name}")
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, [x[:16384] for x in self.held], level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too few or too small samples
            trained = b""
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True)
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(trained)
        self.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        for raw in self.held:
            self.write(self.packer.compress(raw))
        self.held, self.n_held = [], 0

    def end(self) -> tuple[str, int, int]:
        if self.sink is None:
            self.begin()
        self.sink.close()
        done = (f"{self.folder}/{self.name}", self.records, self.size)
        self.sink, self.size, self.records = None, 0, 0
        return done


def _parse(raw: bytes, where: str) -> dict:
    """A record's headers, payload and length, checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in (b"WARC/1.0", VERSION):
        raise WarcError(f"{where}: no WARC version line")
    fields = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name:
            raise WarcError(f"{where}: bad header {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"{where}: header {name} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"{where}: the block's length is not Content-Length")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not gap or len(sizes) != 1 or not sizes[0].isdigit():
        raise WarcError(f"{where}: bad HTTP headers")
    fields["payload-length"] = int(sizes[0])
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if len(payload) != fields["payload-length"] or digest(payload) != stated:
            raise WarcError(f"{where}: the payload is not of the stated length or digest")
    elif fields["warc-type"] != "revisit" or payload or "warc-refers-to" not in fields:
        raise WarcError(f"{where}: not a response or a revisit of one")
    return fields | {"payload": payload, "digest": stated}


def read_archive(source, name: str = "archive") -> Iterator[dict]:
    """Records of an open archive, in turn; only one frame is held in memory."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_FRAME:
        raise WarcError(f"{name}: no leading dictionary frame")
    raw = source.read(size := struct.unpack("<I", head[4:])[0])
    if len(raw) != size:
        raise WarcError(f"{name}: cut short in its dictionary")
    if raw[:4] == struct.pack("<I", FRAME):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    rest, at = b"", 8 + size
    while True:
        frame, out = opener.decompressobj(), []
        if not rest and not (rest := source.read(1 << 20)):
            return
        while not frame.eof:
            if not rest and not (rest := source.read(1 << 20)):
                raise WarcError(f"{name}: cut short in the record at byte {at}")
            try:
                out.append(frame.decompress(rest))
            except zstandard.ZstdError as e:
                raise WarcError(f"{name}: bad frame at byte {at}: {e}") from e
            used = len(rest) - len(frame.unused_data) if frame.eof else len(rest)
            at, rest = at + used, frame.unused_data if frame.eof else b""
        yield _parse(b"".join(out), f"{name}, record that ends at byte {at}")


def write_warc(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes all pages; the manifest: archive, n_records, n_bytes. Payloads under min_bytes are never revisits."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.unhex(F.sha1("html")), "n": F.octet_length("html")})
    groups = rows.where(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies"))
    # Written first: both sides of the join are then shuffled for it, and a payload that very many rows share is split among tasks.
    shared = kept(groups.where("copies > 1 AND first_id IS NOT NULL").select("sha", "n", "first_id"), "warc-shared")
    marked = rows.join(shared, ["sha", "n"], "left")
    refers = F.when(F.col("first_id") != F.coalesce("page_id", F.lit(-1) - F.col("first_id")), F.col("first_id"))

    @lean
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, done = ArchiveWriter(folder), []
        for batch in batches:
            for page_id, url, html, first in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                number = [None if pd.isna(x) else int(x) for x in (page_id, first)]
                done.extend(out.add(record(number[0], url, html.encode("utf-8", "surrogatepass"), number[1])))
        if out.records:
            done.append(out.end())
        yield pd.DataFrame(done, columns=["archive", "n_records", "n_bytes"])

    return kept(marked.select("page_id", "url", "html", refers.alias("refers_to")).mapInPandas(write, "archive string, n_records long, n_bytes long"), "warc-manifest")


def read_warc(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Each record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    @lean
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, stated in zip(batch["archive"], batch["n_records"], strict=True):
                store, at = file_system(name)
                rows, total, held = [], 0, 0
                with store.open_input_stream(at) as source:
                    for x in read_archive(source, name):
                        refers = _page_id(x["warc-refers-to"]) if x["warc-type"] == "revisit" else None
                        rows.append((_page_id(x["warc-record-id"]), x["payload-length"], x["digest"], x["warc-type"], refers, *[x["payload"]] * payloads))
                        total, held = total + 1, held + len(x["payload"]) * payloads
                        if len(rows) >= 10_000 or held > 16 << 20:
                            yield _frame(rows)
                            rows, held = [], 0
                if total != stated:
                    raise WarcError(f"{name}: {total} records, the manifest states {stated}")
                if rows:
                    yield _frame(rows)

    names = [x.split()[0] for x in schema.split(", ")]
    _frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
    readers = max(1, min(MOST_READERS, manifest.count()))  # an archive is the work of a task
    return manifest.repartition(readers, "archive").mapInPandas(read, schema)


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(read_table(spark, sf_dir, "pages")))


# Base 32 of a SHA-1: each 5 hex digits are 20 bits, 4 letters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, {5 * g + 1}, 5))::BIGINT >> {shift}) & 31) + 1)::BIGINT, 1)" for g in range(8) for shift in (15, 10, 5, 0)
)
OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM m
"""

"""Deterministic sharded WARC writer and its reader.

Records are dealt to shards by ranges of page id and sorted inside; a shard rolls to the next file by compressed size.
Every record is a gzip member of its own, with headers and digests made anew. A file is written under a temporary name and
renamed when it is complete; the manifest, a table written by Spark, names the files that count, so that files of lost or
repeated attempts are never read. Equal pages give equal files whatever the number of executors.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compressed size at which a file is closed, and payload of a shard: a 256th of all, between these bounds.
FILE_BYTES = 256 << 20
SHARD_BYTES = (1 << 20, 1 << 30)
SHARDS = 256
#: Page ids looked at to place the limits of shards: this many for each shard, 10,000 at least.
SAMPLE = 4
#: Bytes of payload in a batch that the reader returns.
BATCH_BYTES = 4_000_000
CHUNK = 1 << 20

# Fixed by the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

MANIFEST = "file string, shard int, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, for executors and driver alike."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def base32_sha1(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _record_id(page_id: int | None, digest: str, url: str | None, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}|{url}|{copy}')}>"


def _header(name: str, value: object) -> bytes:
    """A header line; line breaks in a url, which would end it, are written as %0D and %0A."""
    return f"{name}: {str(value).replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n".encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, copy: int, first: tuple | None, date: str) -> bytes:
    """One WARC record; ``first`` is (page_id, url) of the response that a revisit refers to, else None."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first else http + payload
    head = [
        VERSION + b"\r\n",
        _header("WARC-Type", "revisit" if first else "response"),
        _header("WARC-Record-ID", _record_id(page_id, digest, url, copy)),
        _header("WARC-Date", date),
    ]
    if url is not None:
        head.append(_header("WARC-Target-URI", url))
    head += [
        _header("WARC-Payload-Digest", "sha1:" + digest),
        _header("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        _header("Content-Type", "application/http; msgtype=response"),
        _header("X-Page-Id", "" if page_id is None else page_id),
    ]
    if first:
        head += [
            _header("WARC-Profile", REVISIT_PROFILE),
            _header("WARC-Refers-To", _record_id(first[0], digest, first[1], 0)),
            _header("X-Refers-To-Page-Id", "" if first[0] is None else first[0]),
        ]
    return b"".join([*head, _header("Content-Length", len(block)), b"\r\n", block, END])


@dataclass
class _File:
    """A file of a shard under its temporary name."""

    folder: str
    name: str
    shard: int
    records: int = 0
    size: int = 0
    digest: object = field(default_factory=hashlib.sha256)

    def __post_init__(self) -> None:
        self.store, path = open_fs(self.folder)
        self.path, self.temporary = f"{path}/{self.name}", f"{path}/.{self.name}.{uuid.uuid4().hex}"
        self.store.create_dir(path, recursive=True)
        self.out = self.store.open_output_stream(self.temporary, compression=None)

    def add(self, data: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.digest.update(member)
        self.records, self.size = self.records + 1, self.size + len(member)

    def commit(self) -> tuple:
        """Close and rename; an earlier attempt's file of that name has the same bytes and may be replaced."""
        self.out.close()
        try:
            self.store.move(self.temporary, self.path)
        except OSError:
            if self.store.get_file_info(self.path).type == fs.FileType.NotFound:
                raise
            self.store.delete_file(self.temporary)
        return self.name, self.shard, self.records, self.size, self.digest.hexdigest()


def _limits(narrow: DataFrame) -> list[int]:
    """First page id of each shard but the first, from the ids with the smallest hashes and their bytes."""
    total, ids = narrow.agg(F.sum("bytes"), F.count("page_id")).first()
    shard = min(SHARD_BYTES[1], max(SHARD_BYTES[0], (total or 0) // SHARDS))
    shards = -(-(total or 0) // shard)
    if shards < 2 or not ids:
        return []
    limit = -(2**63) + int(min(1.0, max(10_000, SAMPLE * shards) / ids) * (2**64 - 1))
    seen = narrow.where(F.xxhash64("page_id") <= min(limit, 2**63 - 1)).groupBy("page_id").agg(F.sum("bytes")).orderBy("page_id").collect()
    weight, limits, step = 0, [], max(1, sum(r[1] for r in seen)) / shards
    for page_id, size in seen:
        if weight >= step * (len(limits) + 1) and (not limits or page_id > limits[-1]):
            limits.append(page_id)
        weight += size
    return limits


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html; others are not read) and return the manifest.

    The payload is the html in UTF-8; null is empty. Of rows with equal payloads of at least ``min_bytes`` the one with
    the smallest page_id is a response, the others are revisits that refer to it. Rows that repeat the smallest page_id
    are taken in order of url (null first); of wholly equal rows one counts as the first. A row without page_id comes
    after all others. An empty table gives an empty manifest. Only ids, urls and digests are joined; the html is shuffled once.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    given = pages.select(
        F.col("page_id").cast("long"), "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha"),
        F.octet_length(payload).cast("long").alias("bytes"),
    )
    narrow = given.drop("html")
    order = F.struct(F.col("page_id").isNull(), "page_id", "url")
    firsts = (
        narrow.where(F.col("bytes") >= min_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.min(order).alias("first"))
        .where("n > 1").select("sha", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    limits = _limits(narrow)
    shards = pages.sparkSession.sparkContext.broadcast(limits)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(shards.value, np.int64), ids, side="right")).astype("int32")

    last = F.lit(2**63 - 1)
    none = F.lit(None).cast("string")
    # A page whose payload occurs again is announced by a row in front of it, in the same shard.
    announced = narrow.select("page_id", "sha").distinct().join(firsts, "sha").select(
        "page_id", "sha", F.lit(0).alias("kind"), F.col("first_url").alias("url"), none.alias("html"), "first_id"
    )
    rows = announced.union(given.select("page_id", "sha", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("first_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shard, number, notice, seen = None, None, 0, None, None
        copies = 0
        for batch in batches:
            done = []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6)]
            htmls = batch.column(5).cast(pa.binary())
            for k, (own, page_id, sha, kind, url, first_id) in enumerate(zip(*columns, strict=True)):
                if kind == 0:
                    notice, copies = (page_id, sha, first_id, url), 0
                    continue
                if own != shard or out.size >= file_bytes:
                    if out:
                        done.append(out.commit())
                    number = number + 1 if own == shard else 0
                    shard = own
                    out = _File(folder, f"shard-{own:06d}-{number:04d}.warc.gz", own)
                same = notice is not None and notice[:2] == (page_id, sha)
                copies = copies + 1 if seen == (page_id, sha, url) else 0
                seen = (page_id, sha, url)
                first = None
                if same:
                    if page_id != notice[2] or notice[3] is _TAKEN:
                        first = (notice[2], notice[4] if notice[3] is _TAKEN else notice[3])
                    else:
                        notice = (*notice[:3], _TAKEN, notice[3])
                out.add(record(page_id, url, htmls[k].as_py(), base32_sha1(sha), copies, first, date))
            if done:
                yield _manifest(done)
        if out:
            yield _manifest([out.commit()])

    tasks = max(len(limits) + 1, 1)
    written = (
        rows.select(shard_of(F.coalesce("page_id", last)).alias("shard"), "page_id", "sha", "kind", "url", "html", "first_id")
        .repartition(tasks, "shard")
        .sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "sha", "kind", "url")
        .mapInArrow(run, MANIFEST)
    )
    written.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


#: In place of a url: the response of this payload has been written.
_TAKEN = object()


def _manifest(files: list[tuple]) -> pa.RecordBatch:
    name, shard, records, size, digest = zip(*files, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(name), pa.array(shard, pa.int32()), pa.array(records, pa.int64()), pa.array(size, pa.int64()), pa.array(digest)],
        ["file", "shard", "records", "bytes", "sha256"],
    )


def members(stream: pa.NativeFile) -> Iterator[bytes]:
    """The records of a file, one gzip member after the other, held one at a time."""
    unpacker, parts = zlib.decompressobj(31), []
    data = stream.read(CHUNK)
    while data:
        parts.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []
        data = data or stream.read(CHUNK)
    if any(parts):
        raise ValueError("a WARC file ends within a record")


def parse(data: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of a record; checks its digests."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0].encode() != VERSION or rest[len(block) :] != END:
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    checks = [(block, fields["WARC-Block-Digest"].removeprefix("sha1:"))] + [(payload, digest)] * response
    if any(base64.b32encode(hashlib.sha1(x).digest()).decode() != d for x, d in checks) or response and len(payload) != length:
        raise ValueError(f"wrong digest in {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if fields.get(name) else None
    url = fields.get("WARC-Target-URI")
    return number("X-Page-Id"), url, fields["WARC-Type"], number("X-Refers-To-Page-Id"), length, digest, payload if response else None


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the files that the manifest of ``folder`` names, one row each; a revisit's payload is null."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [c.split(" ")[0] for c in RECORDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_fs(folder)
        for files in batches:
            for name, expected in zip(files.column(0).to_pylist(), files.column(1).to_pylist(), strict=True):
                rows, size, count = [], 0, 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for data in members(stream):
                        rows.append(parse(data))
                        size, count = size + len(data), count + 1
                        if size > BATCH_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
                if count != expected:
                    raise ValueError(f"{name} holds {count} records, the manifest says {expected}")
                if rows:
                    yield batch(rows)

    files = manifest.select("file", "records")
    tasks = max(1, min(manifest.count(), 8 * spark.sparkContext.defaultParallelism))
    return files.repartition(tasks, "file").mapInArrow(run, RECORDS)


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS sha FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first_id FROM h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
         ((CAST('0x' || substr(sha, CAST(i // 8 * 10 + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) AS INTEGER), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""

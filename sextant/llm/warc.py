"""Deterministic sharded WARC archives.

Records are range-sorted by page id into shards whose borders come from a hash sample of
the ids, so they depend on the rows alone and not on partitions or attempts. A task writes
its shards one record at a time, begins a new file when the compressed size is reached,
regenerates all headers and digests, and moves each finished file from a temporary to its
final name; writing a shard again gives the same bytes under the same name. The table of
manifest rows is written last, and readers open only files that it lists.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import Scratch, shared_dir

SHARD_BYTES = 512 << 20  # payload per shard, before compression
MIN_SHARDS = 48
ROLL_BYTES = 1 << 30  # compressed bytes after which the next record opens a new file
SAMPLE_PER_SHARD = 64
MIN_SHARED_BYTES = 100  # shorter payloads are never revisits
WARC_DATE = "2024-01-01T00:00:00Z"
READ_CHUNK = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = ("shard int, file string, n_records bigint, n_bytes bigint, first_page bigint, last_page bigint, "
            "sha256 string")
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"


def _uri(path: str) -> str:
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


def _urn(page_id: int | None, serial: int) -> str:
    name = "none" if page_id is None else str(page_id)
    return f"<urn:page:{name}>" if serial == 0 else f"<urn:page:{name}:{serial}>"


def _page_of(urn: str) -> int | None:
    name = urn.strip("<>").split(":")[2]
    return None if name == "none" else int(name)


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join((packer.compress(f"{head}Content-Length: {len(block)}\r\n\r\n".encode()), packer.compress(block),
                     packer.compress(b"\r\n\r\n"), packer.flush()))


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _page_record(page_id, serial: int, url, payload: bytes, digest: str, refers) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers is not None else http + payload
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", _urn(page_id, serial)),
              ("WARC-Date", WARC_DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="/:?#[]@!$&'()*+,;=%~")))
    fields += [("Content-Type", "application/http;msgtype=response"), ("WARC-Block-Digest", f"sha256:{_sha256(block)}"),
               ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Bytes", str(len(payload)))]
    if refers is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(refers, 0))]
    return _member(fields, block)


class _ShardWriter:
    """Files of one shard; each is visible under its final name only when it is whole."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.shard, self.roll_bytes, self.number, self.stream = shard, roll_bytes, 0, None

    def _open(self) -> None:
        self.name = f"part-{self.shard:06d}-{self.number:04d}.warc.gz"
        self.draft = f"{self.root}/_temporary/{uuid.uuid4().hex}-{self.name}"
        self.files.create_dir(f"{self.root}/_temporary", recursive=True)
        self.stream, self.size, self.records, self.sha = self.files.open_output_stream(self.draft), 0, 0, hashlib.sha256()
        self.first = self.last = None
        text = f"format: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
        self._put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{self.name}>"),
                           ("WARC-Date", WARC_DATE), ("WARC-Filename", self.name),
                           ("Content-Type", "application/warc-fields")], text))

    def _put(self, member: bytes) -> None:
        self.stream.write(member)
        self.sha.update(member)
        self.size += len(member)

    def add(self, page_id, member: bytes) -> Iterator[tuple]:
        """Write a record; yields the manifest row of a file that it completes."""
        if self.stream is None:
            self._open()
        self._put(member)
        self.records += 1
        if page_id is not None:
            self.first, self.last = page_id if self.first is None else self.first, page_id
        if self.size >= self.roll_bytes:
            yield self.close()

    def close(self) -> tuple | None:
        if self.stream is None:
            return None
        self.stream.close()
        self.stream = None
        self.files.move(self.draft, f"{self.root}/{self.name}")
        self.number += 1
        return self.shard, self.name, self.records, self.size, self.first, self.last, self.sha.hexdigest()


def _manifest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = ("shard", "file", "n_records", "n_bytes", "first_page", "last_page", "sha256")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))


def _write_shards(folder: str, roll_bytes: int):
    """Batch function over rows sorted by (shard, page_id, is_page, url, digest)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: _ShardWriter | None = None
        page, serial, first_of, seen = object(), 0, {}, set()
        done: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "page_id", "is_page", "url", "digest", "refers_to")]
            payloads = batch.column("payload")
            for i, (shard, page_id, is_page, url, digest, refers) in enumerate(zip(*columns, strict=True)):
                if out is None or out.shard != shard:
                    if out is not None and (row := out.close()):
                        done.append(row)
                    out, page = _ShardWriter(folder, shard, roll_bytes), object()
                if page_id != page:
                    page, serial, first_of, seen = page_id, 0, {}, set()
                if not is_page:
                    first_of[digest] = refers
                    continue
                payload = payloads[i].as_py()
                target = first_of.get(digest)
                if target is None and page_id is not None and digest in seen and len(payload) >= MIN_SHARED_BYTES:
                    target = page_id  # a repeated row
                seen.add(digest)
                done += out.add(page_id, _page_record(page_id, serial, url, payload, digest, target))
                serial += 1
        if out is not None and (row := out.close()):
            done.append(row)
        if done:
            yield _manifest_batch(done)

    return write


def _borders(narrow: DataFrame, shard_bytes: int, min_shards: int) -> tuple[np.ndarray, int]:
    """Ids at which shards begin, from a sample by hash; its size is bounded by the shards."""
    total = narrow.agg(F.count("page_id").alias("n"), F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("b")).first()
    shards = max(min_shards, -(-total["b"] // shard_bytes))
    step = max(1, total["n"] // (shards * SAMPLE_PER_SHARD))
    sample = narrow.filter(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(step)) == 0))
    ids = np.sort(sample.select("page_id").toPandas()["page_id"].to_numpy(dtype=np.int64))
    picks = [ids[len(ids) * k // shards] for k in range(1, shards)] if len(ids) else []
    return np.unique(np.array(picks, dtype=np.int64)), shards


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, shard_bytes: int = SHARD_BYTES,
                   roll_bytes: int = ROLL_BYTES, min_shards: int = MIN_SHARDS) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html); returns the manifest table.

    The payload is the html in UTF-8, empty where null. Of equal payloads of at least 100
    bytes the smallest page_id becomes a response and the others revisit it; of rows that
    repeat one page_id and payload the first is the response. Rows without a page_id revisit
    an equal payload that has one and are responses otherwise. An empty table gives an empty
    manifest. Columns besides the three are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = scratch.keep(rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("payload_bytes")),
                          "digests")
    firsts = narrow.filter(F.col("payload_bytes") >= MIN_SHARED_BYTES).groupBy("digest").agg(
        F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).drop("n")
    lookups = narrow.select("page_id", "digest").distinct().join(firsts, "digest").filter(
        F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    borders, shards = _borders(narrow, shard_bytes, min_shards)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        place = np.zeros(len(ids), dtype=np.int32)
        place[known] = np.searchsorted(borders, ids[known].to_numpy(dtype=np.int64), side="right")
        return pd.Series(place)

    # the short lookup rows travel with the pages, so payloads are shuffled once
    both = rows.select("page_id", F.lit(True).alias("is_page"), "url", "digest", F.lit(None).cast("long").alias("refers_to"),
                       "payload").unionByName(
        lookups.select("page_id", F.lit(False).alias("is_page"), F.lit(None).cast("string").alias("url"), "digest",
                       "refers_to", F.lit(None).cast("binary").alias("payload")))
    placed = both.withColumn("shard", shard_of("page_id")).repartitionById(shards, F.col("shard"))
    placed = placed.sortWithinPartitions("shard", "page_id", "is_page", "url", "digest")
    return scratch.keep(placed.mapInArrow(_write_shards(_uri(folder), roll_bytes), MANIFEST), "manifest")


def _members(stream) -> Iterator[bytes]:
    """Unpacked gzip members of a stream, one at a time."""
    unpacker, parts = zlib.decompressobj(31), []
    chunk = stream.read(READ_CHUNK)
    while chunk:
        parts.append(unpacker.decompress(chunk))
        if unpacker.eof:
            yield b"".join(parts)
            chunk = unpacker.unused_data or stream.read(READ_CHUNK)
            unpacker, parts = zlib.decompressobj(31), []
        else:
            chunk = stream.read(READ_CHUNK)
    if parts and b"".join(parts):
        raise ValueError("archive ends inside a record")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record; checks length and block digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("malformed record")
    if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != f"sha256:{_sha256(block)}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} differs")
    return fields, block


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Records of the files that ``manifest`` lists; payloads are checked against their digests."""
    root = _uri(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with files.open_input_stream(f"{base}/{name}") as stream:
                    rows = []
                    for fields, block in map(parse_record, _members(stream)):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Bytes"])
                        refers = fields.get("WARC-Refers-To")
                        payload = block.partition(b"\r\n\r\n")[2]
                        if refers is None and (len(payload) != size or _sha256(payload) != digest):
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} differs")
                        rows.append((_page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"],
                                     None if refers is None else _page_of(refers), size, digest))
                        if len(rows) == 10_000:
                            yield _record_batch(rows)
                            rows = []
                    yield _record_batch(rows)

    return manifest.select("file").repartition(MIN_SHARDS).mapInArrow(read, RECORD)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    return read_archives(spark, folder, write_archives(pages, folder, scratch)).drop("url")

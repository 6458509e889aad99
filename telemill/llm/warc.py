"""Deterministic sharded WARC archives: writer, manifest and reader."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemill.llm.common import saved, steps

#: Payload bytes that make up a shard, and compressed bytes after which a shard's file is rolled.
SHARD_BYTES = 64 << 20
FILE_BYTES = 32 << 20
#: Id ranges whose sizes are counted to cut shards; so many rows the shard map has at most.
RANGES = 65_536
#: Equal payloads of fewer bytes are written again.
REVISIT_BYTES = 100
#: The capture date of all records, so that the same input gives the same bytes.
DATE = "2024-01-01T00:00:00Z"

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "file string, shard long, number int, records long, bytes long, sha256 string"
_RECORD = (
    "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def _slim(df: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary"))
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))


def shard_map(slim: DataFrame, shard_bytes: int) -> tuple[DataFrame, int, int]:
    """Id range to shard, the smallest id and the width of a range.

    The id span is cut into at most ``RANGES`` equal ranges; shards are cut where the running size of the
    ranges passes a multiple of ``shard_bytes``. This depends on the rows alone, not on their partitions or
    on sampling, and the running sum is over at most ``RANGES`` rows.
    """
    ends = slim.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    lo, hi = ends.lo or 0, ends.hi or 0
    width = (hi - lo) // RANGES + 1
    sizes = slim.where("id IS NOT NULL").groupBy(F.floor((F.col("id") - lo) / width).cast("long").alias("range"))
    running = F.sum("size").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    cut = sizes.agg(F.sum("n").alias("size")).select("range", F.floor(F.coalesce(running, F.lit(0)) / shard_bytes).alias("shard"))
    return cut, lo, width


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record_id(page: int | None, digest: str) -> str:
    """The record's name, the same in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One response or revisit record with regenerated headers and digests."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page, digest)),
        ("WARC-Date", DATE),
        # Control characters and blanks cannot stand in a header line.
        ("WARC-Target-URI", None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]|^`{}<>\"\\-._")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Page-ID", page),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [
            ("WARC-Profile", _PROFILE),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("WARC-Refers-To-Page-ID", refers_to),
        ]
    fields.append(("Content-Length", len(block)))
    return _header(fields) + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


class _Files:
    """The open file of one task: written under a temporary name, moved to its own when it is full."""

    def __init__(self, out_dir: str, file_bytes: int):
        self.store, self.root = fs.FileSystem.from_uri(out_dir)
        self.file_bytes, self.shard, self.number, self.stream = file_bytes, None, 0, None
        self.store.create_dir(f"{self.root}/_temporary", recursive=True)

    def write(self, shard: int, data: bytes) -> Iterator[tuple]:
        if self.stream and (shard != self.shard or self.size >= self.file_bytes):
            yield self.close()
        if shard != self.shard:
            self.shard, self.number = shard, 0
        if not self.stream:
            self.name = f"part-{shard + 1:07d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.stream = self.store.open_output_stream(self.temporary, compression=None)
            self.size, self.records, self.hash = 0, 0, hashlib.sha256()
            info = b"software: telemill\r\nformat: WARC File Format 1.1\r\n"
            head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", DATE)]
            head += [("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]
            self._put(_header(head) + info + b"\r\n\r\n")
        self._put(data)
        self.records += 1

    def _put(self, data: bytes) -> None:
        packed = member(data)
        self.stream.write(packed)
        self.hash.update(packed)
        self.size += len(packed)

    def close(self) -> tuple:
        self.stream.close()
        self.store.move(self.temporary, f"{self.root}/{self.name}")
        self.stream = None
        row = (self.name, self.shard, self.number, self.records, self.size, self.hash.hexdigest())
        self.number += 1
        return row


def write(
    df: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, revisit_bytes: int = REVISIT_BYTES,
) -> DataFrame:
    """Writes a record per row below ``out_dir`` and gives the manifest, one row per file.

    Rows are dealt to shards by ranges of their id and sorted by id, payload digest and URL; a shard's file
    is rolled when its compressed size passes ``file_bytes``. Of equal payloads of ``revisit_bytes`` or more
    the rows with the smallest id are responses, the others revisits that refer to it. A null payload is
    empty; rows with a null id come first, in a shard of their own, and are responses; a null URL has no
    header. File names and bytes depend on the rows only. Files appear under their names when complete, so
    a task that runs again replaces its files by equal ones; the manifest, written last, names the files
    that count. ``out_dir`` has to be a folder that all executors share.

    Payloads are shuffled once. Revisits are found on ids and digests, and travel as small notes which sort
    right before their record; a note is one row per id, so a payload with very many copies is no hot group.
    """
    rows = _slim(df, id_col, url_col, payload_col)
    slim = saved(rows.select("id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n")))
    cut, lo, width = shard_map(slim, shard_bytes)
    counted = slim.where(f"n >= {int(revisit_bytes)} AND id IS NOT NULL")
    first = counted.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    notes = counted.join(first, "digest").where("id > first").select("id", "digest", "first").distinct()

    columns = ["id", "digest", "first", "url", "payload"]
    everything = notes.withColumn("url", F.lit(None).cast("string")).withColumn("payload", F.lit(None).cast("binary")).select(columns)
    everything = everything.unionByName(
        rows.select("id", F.sha2("payload", 256).alias("digest"), F.lit(None).cast("long").alias("first"), "url", "payload")
    )
    numbered = everything.withColumn("range", F.floor((F.col("id") - lo) / width).cast("long"))
    # The map has RANGES rows at most.
    dealt = numbered.join(F.broadcast(cut), "range", "left").withColumn("shard", F.coalesce("shard", F.lit(-1).cast("long")))
    ordered = (
        dealt.repartition("shard")
        .sortWithinPartitions("shard", "id", "digest", F.col("payload").isNotNull(), "url")
        .select("shard", *columns)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, note, done = _Files(out_dir, file_bytes), None, []
        for batch in steps(batches, 5):
            for shard, page, digest, first_id, url, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if payload is None:
                    note = (page, digest, first_id)
                    continue
                refers = note[2] if note and note[:2] == (page, digest) else None
                done += files.write(shard, record(page, url, payload, digest, refers))
        if files.stream:
            done.append(files.close())
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("file", "shard", "number", "records", "bytes", "sha256"), x)) for x in done],
            pa.schema([("file", pa.string()), ("shard", pa.int64()), ("number", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]),
        )

    manifest = ordered.mapInArrow(run, _MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{out_dir}/_manifest")
    return df.sparkSession.read.parquet(f"{out_dir}/_manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            parts.append(unpack.decompress(data))
            data = b""
            if unpack.eof:
                yield b"".join(parts)
                data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> dict | None:
    """A response or revisit record's fields, digests checked; None for other kinds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    if not lines[0].startswith("WARC/1.") or fields["WARC-Type"] not in ("response", "revisit"):
        return None
    block = rest[: int(fields["Content-Length"])]
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest differs: {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload digest differs: {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "id": number("WARC-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "payload_bytes": size, "payload_digest": digest, "refers_to": number("WARC-Refers-To-Page-ID"),
        "payload": payload if response else None,
    }


def read(spark: SparkSession, out_dir: str, payloads: bool = True) -> DataFrame:
    """The records of the files in the manifest, a file per task step; payloads only where asked for.

    Block and payload digests are checked, a file that is cut short is an error. A revisit has no payload.
    """
    manifest = spark.read.parquet(f"{out_dir}/_manifest").select("file")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, types[t]) for n, t in (x.split(" ") for x in _RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out_dir)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows, size = [], 0
                    for data in members(stream):
                        if found := parse(data):
                            rows.append(found if payloads else found | {"payload": None})
                            size += len(data) if payloads else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.repartition(int(parts), "file").mapInArrow(run, _RECORD)

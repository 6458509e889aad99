"""JSONL spool files of bounded size."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from telemill.functions.text import safe_stem
from telemill.operators.ordinals import ordered_blocks

DEFAULT_FILE_BYTES = 10 * 1024 * 1024
DEFAULT_BATCH = 500
OVERSIZE_CODE = "record-exceeds-ama-file-limit"
FORMAT = "telemill_spool"
#: Files that one task reads, and bytes of lines it hands over at a time.
FILES_A_TASK = 2048
READ_BYTES = 1 << 20


def split_oversize(df: DataFrame, max_bytes: int = DEFAULT_FILE_BYTES, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Rows that fit a file, and non-retryable failures for those that do not (a newline counts)."""
    size = F.octet_length(payload) + 1
    failures = df.filter(size > max_bytes).select(
        "event_id", F.lit(OVERSIZE_CODE).alias("code"), F.lit(False).alias("retryable")
    )
    return df.filter(size <= max_bytes), failures


def _filled(sizes: Sequence[int], first: int, used: int, number: int, batch: int, most: int) -> tuple[list[int], int, int]:
    """File numbers of rows from position ``first`` on, and the bytes and number of the last file."""
    numbers = []
    for place, size in enumerate(sizes, first):
        if place % batch == 0:
            used = number = 0
        if used > 0 and used + size > most:
            used, number = 0, number + 1
        used += size
        numbers.append(number)
    return numbers, used, number


class _Packer:
    """Walks the rows of a sort block; the first group may go on from another block."""

    def __init__(self, keys: Sequence[str], batch: int, most: int):
        self.keys, self.batch, self.most = keys, batch, most

    def _segments(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[tuple, int, int]], list[int]]]:
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in self.keys)))
            borders = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            yield batch, [(keys[a], a, z) for a, z in zip(borders, [*borders[1:], len(keys)])], batch.column("_bytes").to_pylist()

    def borders(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of the first and the last group of a block, with the last sizes of each, a batch of them at most."""
        rows: list[list] = []
        for batch, groups, sizes in self._segments(batches):
            block = batch.column("_block")[0].as_py()
            for key, a, z in groups:
                if not rows or rows[-1][2] != key:
                    rows = [*rows[:1], [block, len(rows[:1]), key, 0, []]]
                rows[-1][3] += z - a
                rows[-1][4] = (rows[-1][4] + sizes[a:z])[-self.batch :]
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([repr(r[2]) for r in rows], pa.string())]
        columns += [pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "place", "key", "n", "tail"])

    def walk(self, batches: Iterator[pa.RecordBatch], before: dict[int, tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        """The rows with their batch, position and file."""
        current, started = None, False
        place = used = number = 0
        for batch, groups, sizes in self._segments(batches):
            places, files = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
            for key, a, z in groups:
                if not started or key != current:
                    place, used, number = (0, 0, 0) if started else before.get(batch.column("_block")[0].as_py(), (0, 0, 0))
                    current, started = key, True
                files[a:z], used, number = _filled(sizes[a:z], place, used, number, self.batch, self.most)
                places[a:z] = np.arange(place, place + z - a)
                place += z - a
            more = [pa.array(places // self.batch), pa.array(places + 1), pa.array(files)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "batch_no", "_pos", "file_no"])


def pack_files(
    df: DataFrame,
    max_bytes: int = DEFAULT_FILE_BYTES,
    keys: Sequence[str] = ("collector_id", "stream"),
    order: Sequence[str] = ("received_at", "event_id"),
    batch: int = DEFAULT_BATCH,
    payload: str = "payload",
) -> DataFrame:
    """Adds ``batch_no``, ``_pos`` (from 1) and ``file_no``: rows in order, a new file when the next row would not fit.

    Packing runs per delivery batch (a fixed number of rows of one collector and stream), as a delivery does. Rows
    are sorted once and cut into blocks, so a collector of any number of rows is spread over many; of each block
    only the sizes of one batch are needed to go on in the next. Rows with null keys form groups of their own, a
    null payload is an empty line.
    """
    sized = df.withColumn("_bytes", F.coalesce(F.octet_length(payload), F.lit(0)).cast("bigint") + 1)
    blocks = ordered_blocks(sized, keys, order)
    packer = _Packer(list(keys), batch, max_bytes)
    rows = blocks.mapInArrow(packer.borders, "block int, place int, key string, n bigint, tail array<bigint>").collect()
    before: dict[int, tuple[int, int, int]] = {}
    key, place, tail = None, 0, []
    for row in sorted(rows, key=lambda r: (r.block, r.place)):
        if row.place or row.key != key:
            key, place, tail = row.key, 0, []
        elif place:
            start = place - place % batch
            _, used, number = _filled(tail[len(tail) - (place - start) :], start, 0, 0, batch, max_bytes)
            before[row.block] = (place, used, number)
        place += row.n
        tail = (tail + list(row.tail))[-batch:]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema) + ", batch_no bigint, _pos bigint, file_no int"
    return blocks.mapInArrow(lambda b: packer.walk(b, before), schema).drop("_block", "_bytes")


def write_spool(packed: DataFrame, path: str, keys: Sequence[str] = ("collector_id", "stream"), payload: str = "payload") -> None:
    """Appends packed rows as JSON lines, one folder per file; Spark's commit makes them visible at once.

    Written again they stand twice; :func:`write_delivery` replaces its files.
    """
    stems = {k: F.expr(safe_stem(k)) for k in keys}
    parts = [*keys, "batch_no", "file_no"]
    (
        packed.withColumns(stems)
        .repartition(*parts)
        .sortWithinPartitions(*parts, "_pos")
        .select(*parts, F.col(payload).alias("value"))
        .write.mode("append")
        .partitionBy(*parts)
        .text(path)
    )


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _names(system: fs.FileSystem, folder: str) -> Iterator[str]:
    """The names in a folder, one after the other where the file system can tell them so."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as entries:
            yield from (e.name for e in entries)
    else:
        yield from (f.base_name for f in system.get_file_info(fs.FileSelector(folder)))


@dataclass
class SpoolFiles(WriterCommitMessage):
    """The folder that holds the files of a task, under their names, or none if it had no rows.

    The driver holds the messages of all tasks at a time, so they do not name the files.
    """

    folder: str | None


class SpoolWriter(DataSourceWriter):
    """Writes the files of each task into a temporary folder of its own, and moves those of all tasks at the commit.

    Names follow from the delivery, the batch and the file, so a delivery that is run again replaces its files and
    adds none. What a lost task has written is never moved, and goes with the delivery's temporary folder. The commit
    holds the names of one task's files at a time.
    """

    def __init__(self, path: str, delivery: str):
        self.path, self.delivery = path, delivery

    def write(self, iterator: Iterator[Row]) -> SpoolFiles:
        system, root = _place(self.path)
        folder, current, out = None, None, None
        try:
            for row in iterator:
                name = f"{row.stem}-{self.delivery}-{row.batch_no:010d}-{row.file_no:06d}"
                if folder is None:
                    folder = uuid4().hex
                    system.create_dir(f"{root}/active/{self.delivery}/{folder}", recursive=True)
                if name != current:
                    if out is not None:
                        out.close()
                    current = name
                    out = system.open_output_stream(f"{root}/active/{self.delivery}/{folder}/{name}.jsonl")
                out.write((row.value or "").encode() + b"\n")
        finally:
            if out is not None:
                out.close()
        return SpoolFiles(folder)

    def commit(self, messages: list[SpoolFiles | None]) -> None:
        system, root = _place(self.path)
        system.create_dir(f"{root}/ready", recursive=True)
        for message in messages:
            if message is None or message.folder is None:
                continue
            folder = f"{root}/active/{self.delivery}/{message.folder}"
            for name in sorted(_names(system, folder)):
                temporary, ready = f"{folder}/{name}", f"{root}/ready/{name}"
                try:
                    system.move(temporary, ready)
                except OSError:
                    # Not every file system's move replaces a file.
                    system.delete_file(ready)
                    system.move(temporary, ready)
        self._clear(system, root)

    def abort(self, messages: list[SpoolFiles | None]) -> None:
        self._clear(*_place(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        active = f"{root}/active/{self.delivery}"
        if system.get_file_info(active).type == fs.FileType.Directory:
            system.delete_dir(active)


@dataclass
class SpoolNames(InputPartition):
    """The names of the files that one task reads, compressed: they share most of their letters."""

    packed: bytes

    @classmethod
    def of(cls, names: list[str]) -> SpoolNames:
        return cls(zlib.compress("\n".join(names).encode()))

    @property
    def names(self) -> list[str]:
        return zlib.decompress(self.packed).decode().split("\n") if self.packed else []


class SpoolReader(DataSourceReader):
    """Reads the lines of delivered files, many files a task, however small they are."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[SpoolNames]:
        system, root = _place(self.path)
        there = system.get_file_info(f"{root}/ready").type == fs.FileType.Directory
        found = (n for n in (_names(system, f"{root}/ready") if there else ()) if n.endswith(".jsonl"))
        return [SpoolNames.of(sorted(names)) for names in iter(lambda: list(islice(found, FILES_A_TASK)), [])] or [SpoolNames(b"")]

    def read(self, partition: SpoolNames) -> Iterator[pa.RecordBatch]:
        system, root = _place(self.path)
        files, lines, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(lines, pa.string())], ["file", "value"])

        for name in partition.names:
            with system.open_input_stream(f"{root}/ready/{name}") as stream:
                data = stream.read()
            found = data.split(b"\n")
            if not found[-1]:
                found.pop()
            files += [name.removesuffix(".jsonl")] * len(found)
            lines += found
            held += len(data)
            if held >= READ_BYTES:
                yield batch()
                files, lines, held = [], [], 0
        if lines:
            yield batch()


class SpoolSink(DataSource):
    """Options ``path`` and ``delivery``; rows ``stem, batch_no, file_no, value``, those of a file together.

    Reading gives ``file, value``: each line of the delivered files with its file's name without the ending.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, value string"

    def reader(self, schema) -> SpoolReader:
        return SpoolReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> SpoolWriter:
        return SpoolWriter(self.options["path"], self.options["delivery"])


def write_delivery(
    packed: DataFrame, path: str, delivery: str, keys: Sequence[str] = ("collector_id", "stream"), payload: str = "payload"
) -> None:
    """Writes packed rows as JSON lines to ``path/ready``, a file ``<keys>-<delivery>-<batch>-<file>.jsonl`` each.

    ``path`` is a folder that all executors reach. All files of a delivery appear at its commit, or none; the
    same delivery again replaces them.
    """
    spark = packed.sparkSession
    spark.dataSource.register(SpoolSink)
    parts = [*keys, "batch_no", "file_no"]
    stem = F.concat_ws("-", *(F.coalesce(F.expr(safe_stem(k)), F.lit("null")) for k in keys))
    rows = packed.repartition(*parts).sortWithinPartitions(*parts, "_pos").select(
        stem.alias("stem"), "batch_no", "file_no", F.col(payload).alias("value")
    )
    rows.write.format(FORMAT).mode("append").option("path", path).option("delivery", delivery).save()


def read_delivered(spark: SparkSession, path: str) -> DataFrame:
    """``file, value``: the lines of all delivered files under ``path``."""
    spark.dataSource.register(SpoolSink)
    return spark.read.format(FORMAT).option("path", path).load()


def acknowledgements(packed: DataFrame, delivery: str, keys: Sequence[str] = ("collector_id", "stream")) -> DataFrame:
    """``event_id, acknowledgement`` of the rows of a committed delivery: the file that holds each."""
    stem = F.concat_ws("-", *(F.coalesce(F.expr(safe_stem(k)), F.lit("null")) for k in keys))
    name = F.format_string(f"%s-{delivery}-%010d-%06d", stem, "batch_no", "file_no")
    return packed.select("event_id", F.concat(F.lit("spool:"), name).alias("acknowledgement"))

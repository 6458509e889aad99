"""A polled table as a stream: rows after a (time, sequence) cursor, with the overlap read again.

A source table gains rows late: a transaction that began earlier commits after others. A poll therefore starts some
time before its cursor. What it reads twice has the same fingerprint and is dropped by an exact sink, such as
:func:`telemill.streaming.ingest.start_exact`. The cursor is the stream's offset, so it is kept in the checkpoint and
moves only when a batch has been written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "telemill_poll"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: Time ranges that a batch is read in, each by a task.
SLICES = 8


def _micros(value: datetime) -> int:
    return round((value - _EPOCH) / timedelta(microseconds=1))


@dataclass
class ParquetTable:
    """A folder of Parquet files as the polled table. Another source has the same two methods."""

    path: str
    event_time: str
    sequence: str

    def _data(self) -> ds.Dataset:
        # Opened at every poll: the table grows.
        return ds.dataset(self.path, format="parquet")

    def _time(self) -> pc.Expression:
        return ds.field(self.event_time).cast(pa.timestamp("us"))

    def newest(self) -> tuple[int, int] | None:
        """Time (in microseconds) and sequence of the last row in cursor order."""
        best = None
        for batch in self._data().to_batches(columns={"t": self._time(), "s": ds.field(self.sequence).cast(pa.int64())}):
            if not batch.num_rows:
                continue
            top = pc.max(batch.column("t"))
            if top.as_py() is None:
                continue
            at = batch.filter(pc.equal(batch.column("t"), top))
            found = (top.cast(pa.int64()).as_py(), pc.max(at.column("s")).as_py())
            best = found if best is None else max(best, found)
        return best

    def rows(self, columns: Sequence[str], low: int, high: int) -> Iterator[pa.RecordBatch]:
        """The rows from time ``low`` up to, but not with, time ``high``."""
        at = lambda t: pa.scalar(t, pa.timestamp("us"))
        found = self._data().to_batches(columns=list(columns), filter=(self._time() >= at(low)) & (self._time() < at(high)))
        yield from (b for b in found if b.num_rows)


@dataclass
class _Slice(InputPartition):
    low: int
    high: int

    def __post_init__(self):
        super().__init__((self.low, self.high))


class PollReader(DataSourceStreamReader):
    """Offsets are cursors; a batch is all rows from some time before the last cursor up to the newest row."""

    def __init__(self, table: ParquetTable, schema: StructType, overlap_us: int, slices: int):
        self.table, self.schema, self.overlap_us, self.slices = table, to_arrow_schema(schema), overlap_us, slices

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": None, "sequence": None}

    def latestOffset(self) -> dict:  # noqa: N802
        newest = self.table.newest()
        return self.initialOffset() if newest is None else {"time": newest[0], "sequence": newest[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if end["time"] is None:
            return []
        low = 0 if start["time"] is None else start["time"] - self.overlap_us
        high = end["time"] + 1
        step = max(1, -(-(high - low) // self.slices))
        # The first poll has no lower bound.
        borders = [-(1 << 62) if start["time"] is None else low, *range(low + step, high, step), high]
        return [_Slice(a, z) for a, z in zip(borders, borders[1:])]

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        # Microseconds that a timestamp can hold.
        for batch in self.table.rows(self.schema.names, max(partition.low, -(1 << 55)), partition.high):
            columns = [self._typed(batch.column(f.name), f.type) for f in self.schema]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)

    @staticmethod
    def _typed(column: pa.Array, kind: pa.DataType) -> pa.Array:
        # Files keep instants without a zone, which is UTC.
        return column.cast(pa.timestamp("us")).cast(kind) if pa.types.is_timestamp(kind) else column.cast(kind)


class PollSource(DataSource):
    """Options ``path``, ``event_time``, ``sequence``, ``overlap_seconds`` and ``slices``; the schema has to be given."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema: StructType) -> PollReader:  # noqa: N802
        given = self.options
        table = ParquetTable(given["path"], given.get("event_time", "event_time"), given.get("sequence", "sequence"))
        overlap = round(float(given.get("overlap_seconds", "0")) * 1_000_000)
        return PollReader(table, schema, overlap, int(given.get("slices", str(SLICES))))


def poll_table(
    spark: SparkSession, path: str, schema: StructType, event_time: str, sequence: str, overlap: timedelta = timedelta(0), slices: int = SLICES
) -> DataFrame:
    """The rows of a growing table as a stream, with those of the last ``overlap`` before the cursor in every batch."""
    spark.dataSource.register(PollSource)
    reader = spark.readStream.format(FORMAT).schema(schema).option("path", path.removeprefix("file://"))
    reader = reader.option("event_time", event_time).option("sequence", sequence).option("slices", str(slices))
    return reader.option("overlap_seconds", str(overlap.total_seconds())).load()

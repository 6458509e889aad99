"""Helpers the operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.session import configure, shared_dir, stable

#: Bytes of text that one Python step holds at a time; a longer single text is a step of its own.
STEP_BYTES = 8 << 20
#: Rows that Spark hands to Python at a time. Rows are whole texts, so Spark's 10,000 would fill its buffers.
BATCH_ROWS = 1000

#: Bits of the filter of :func:`divided`: it is broadcast as 65,536 words at most.
FILTER_BITS = 1 << 22

T = TypeVar("T")
#: What this Python worker keeps between the tasks of one kind of work, by a name for that work.
_KEPT: dict[object, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """The rows as kept in the cluster's shared checkpoint folder: lineage is cut, executors may be lost."""
    return stable(df)


def kept(work: object, make: Callable[[], T]) -> T:
    """What a Python worker keeps for ``work``: made when first asked for, held while its tasks are of that work.

    A worker serves the tasks of all stages, so what one operator remembers would stand beside the memory of all later
    ones. It is let go by the first of :func:`steps` that is not of that work.
    """
    _let_go(work)
    if work not in _KEPT:
        _KEPT[work] = make()
    return _KEPT[work]


def _let_go(work: object) -> None:
    """Frees what is kept for other work than ``work``."""
    if _KEPT and work not in _KEPT:
        _KEPT.clear()
        # Kept things may hold each other.
        gc.collect()


def steps(batches: Iterable[pa.RecordBatch], column: int, limit: int = STEP_BYTES, work: object = None) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices whose text column holds about ``limit`` bytes at most.

    What the worker has :func:`kept` for other work than ``work`` is let go.
    """
    _let_go(work)
    for batch in batches:
        start, size = 0, 0
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for row, length in enumerate(lengths):
            if row > start and size + length > limit:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += length
        if start < batch.num_rows:
            yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text``: the two columns an operator reads, under its own names."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: like :func:`saved`, and Spark knows its size for joins."""
    path = f"{shared_dir(df.sparkSession)}/telemill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """A column name that the table does not have: ``name``, with underscores where it has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def divided(df: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose id may be in the one column of ``ids``, rows whose id is not), by a Bloom filter of one hash.

    A join with the ids would shuffle all of ``df`` as soon as they are too many to be broadcast; the filter has a size
    that no input exceeds. All rows with an id in ``ids`` are in the first part, with few others; null ids are not.
    """

    def place(key: Column) -> Column:
        return F.xxhash64(key.cast("long")).bitwiseAND(F.lit(FILTER_BITS - 1))

    word, bits = free(df, "word"), free(df, "bits")
    named = F.col(f"`{ids.columns[0]}`")
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    marks = ids.where(named.isNotNull()).select(F.shiftright(place(named), 6).alias(word), bit(place(named)).alias(bits))
    marks = F.broadcast(written(marks.groupBy(word).agg(F.bit_or(bits).alias(bits))))
    own = F.col(f"`{id_col}`")
    columns = [F.col(f"`{c}`") for c in df.columns]
    at = df.withColumn(word, F.when(own.isNotNull(), F.shiftright(place(own), 6)))
    hit = F.col(bits).bitwiseAND(bit(place(own))) != 0
    some = at.join(marks, word).where(hit).select(*columns)
    return some, at.join(marks, word, "left").where(~F.coalesce(hit, F.lit(False))).select(*columns)

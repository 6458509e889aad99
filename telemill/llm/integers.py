"""Vectors as packed whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components are packed in this form; larger ones than LARGEST are not.
PACKED = "<i4"
LARGEST = 1 << 25


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``id, label, size, vec`` with each component x as floor(scale * x), packed.

    Rows whose vector is null or holds a null or non-finite component are dropped. ``vec`` is null where a
    number exceeds :data:`LARGEST`, as products of such vectors might exceed a long.
    """
    slim = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    ).where("vector IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            ends = column.offsets.to_numpy().astype(np.int64)
            # Nulls come as NaN.
            values = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
            ends = ends - ends[0]
            within = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[ends]) > 0
            kept = ~within(~np.isfinite(values))
            with np.errstate(over="ignore", invalid="ignore"):
                numbers = np.floor(values * scale)
                large = within(~(np.abs(numbers) <= LARGEST))
            sizes = np.diff(ends)
            data = numbers[np.repeat(kept & ~large, sizes)].astype(PACKED)
            places = np.concatenate([[0], np.cumsum(np.where(large, 0, sizes)[kept])]) * data.itemsize
            packed = pa.Array.from_buffers(
                pa.binary(), int(kept.sum()), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data.tobytes())]
            )
            if large.any():
                packed = pc.if_else(pa.array(large[kept]), pa.scalar(None, pa.binary()), packed)
            rows = batch.filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(sizes[kept], pa.int32()), packed], ["id", "label", "size", "vec"]
            )

    return slim.mapInArrow(run, "id long, label string, size int, vec binary")


def unpacked(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Packed vectors of one size as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), PACKED).reshape(len(column), size)


def exact(rows: np.ndarray, largest: int) -> np.ndarray:
    """The rows in the fastest form in which sums of products with numbers up to ``largest`` stay exact."""
    most = 4 * rows.shape[1] * max(1, largest, int(np.abs(rows).max(initial=0))) ** 2
    return rows.astype(np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64)

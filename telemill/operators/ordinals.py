"""Positions and running sums within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemill.session import stable


def _with_offsets(df: DataFrame, keys: Sequence[str], part: str, amount: Column, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over the earlier parts of the group."""
    totals = df.groupBy(*keys, part).agg(F.sum(amount).alias("_total"))
    window = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(
        *(F.col(k).alias(f"_key_{i}") for i, k in enumerate((*keys, part))),
        F.coalesce(F.sum("_total").over(window), F.lit(0)).alias(name),
    )
    # Null keys are a group like any other.
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate((*keys, part))]
    return df.join(before, reduce(lambda a, b: a & b, same)).drop(*(f"_key_{i}" for i in range(len(keys) + 1)))


def index_within(df: DataFrame, keys: Sequence[str], order: str, output: str = "index", width: int = 100_000) -> DataFrame:
    """Adds the 0-based position of a row among the rows of its group, by a distinct whole number.

    One group may hold a third of all rows, so it is cut into ranges of ``width`` numbers: rows are
    ranked inside a range, and the range's offset comes from the (few) range counts.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / F.lit(width)))
    rank = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(order))
    return (
        _with_offsets(ranged, list(keys), "_range", F.lit(1), "_offset")
        .withColumn(output, F.col("_offset") + rank - 1)
        .drop("_range", "_offset")
    )


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows globally sorted by keys and order with the number of their sort partition in ``_block``.

    Range partitioning splits a hot group over many blocks, even among equal leading order values. The
    result is kept in the shared folder, because block borders come from sampling and have to be the
    same in every later use.
    """
    return stable(df.orderBy(*keys, *order).withColumn("_block", F.spark_partition_id()))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, output: str) -> DataFrame:
    """Adds the running sum of a column per group in the given (total) order."""
    blocks = ordered_blocks(df, keys, order)
    window = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        _with_offsets(blocks, list(keys), "_block", F.col(amount), "_offset")
        .withColumn(output, F.col("_offset") + F.sum(amount).over(window))
        .drop("_block", "_offset")
    )

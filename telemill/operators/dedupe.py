"""Duplicate suppression and admission by capacity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.operators.ordinals import ordered_blocks, running_sum


def keep_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row of every key; aggregated with map-side combine, so a hot key never sits in one task.

    A null key is no key: its rows all stay.
    """
    columns = df.columns
    row = F.struct(*columns)
    rank = F.struct(*order)
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row, rank).alias("_row"))
    return first.select("_row.*").select(*columns).unionByName(df.where(F.col(key).isNull()))


def dedupe_first(
    df: DataFrame, fingerprint: str = "fingerprint", event_id: str = "event_id", order: Sequence[str] = ("received_at", "event_id")
) -> DataFrame:
    """Keeps the first row per event id, then the first per fingerprint.

    Insert-or-ignore in arrival order differs only where a row lost by its id was itself the first
    holder of its fingerprint.
    """
    by_id = keep_first(df, event_id, order)
    return keep_first(by_id, fingerprint, order)


def mark_duplicates(new: DataFrame, existing: DataFrame, fingerprint: str = "fingerprint", event_id: str = "event_id") -> DataFrame:
    """Rows of ``new`` whose fingerprint or id is not in ``existing`` yet (exact, against a table)."""
    return new.join(existing.select(fingerprint).distinct(), fingerprint, "left_anti").join(
        existing.select(event_id).distinct(), event_id, "left_anti"
    )


def admit_by_capacity(
    df: DataFrame,
    max_bytes: int,
    partition: Sequence[str],
    order: Sequence[str] = ("received_at", "event_id"),
    size: str = "payload_bytes",
) -> DataFrame:
    """Adds ``running_bytes`` and ``admitted``: rows in order while the running size fits.

    Capacity is cut as a prefix: nothing after the first row that does not fit is admitted. This needs no
    state; :func:`admit_skipping` refuses single rows and goes on.
    """
    summed = running_sum(df, partition, order, size, "running_bytes")
    return summed.withColumn("admitted", F.col("running_bytes") <= F.lit(max_bytes))


def _admitted(sizes: np.ndarray, used: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows fit, in order, and what is used after each.

    Runs of rows that fit are taken at once, and rows larger than what is left are passed over at once.
    """
    fits = np.zeros(len(sizes), bool)
    at = 0
    while at < len(sizes):
        ends = used + np.cumsum(sizes[at:])
        run = int(np.searchsorted(ends > most, True)) if ends[-1] > most else len(ends)
        fits[at : at + run] = True
        used = int(ends[run - 1]) if run else used
        at += run
        small = np.flatnonzero(sizes[at:] <= most - used)
        at = at + int(small[0]) if len(small) else len(sizes)
    return fits, np.cumsum(np.where(fits, sizes, 0))


class _Ledgers:
    """Walks the rows of a sort block, group by group; the first group may go on from another block."""

    def __init__(self, keys: Sequence[str], size: str, most: int):
        self.keys, self.size, self.most = keys, size, most

    def segments(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[tuple, int, int]], np.ndarray]]:
        """Each batch with its groups as (key, start, stop), and the sizes of its rows."""
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in self.keys)))
            borders = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            sizes = batch.column(self.size).cast(pa.int64()).fill_null(0).to_numpy()
            yield batch, [(keys[a], a, z) for a, z in zip(borders, [*borders[1:], len(keys)])], sizes

    def borders(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for the first and the last group of a block: its size, its smallest row of a size, what it uses alone."""
        rows: list[list] = []
        for batch, groups, sizes in self.segments(batches):
            block = batch.column("_block")[0].as_py() if batch.num_rows else None
            for key, a, z in groups:
                if not rows or rows[-1][2] != key:
                    rows = [*rows[:1], [block, len(rows[:1]), key, 0, None, 0]]
                own = sizes[a:z]
                last = rows[-1]
                last[3] += int(own.sum())
                some = own[own > 0]
                if len(some):
                    last[4] = min(int(some.min()), last[4] if last[4] is not None else int(some.min()))
                last[5] += int(_admitted(own, last[5], self.most)[1][-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int32()), (1, pa.int32()))]
            + [pa.array([repr(r[2]) for r in rows], pa.string())]
            + [pa.array([r[i] for r in rows], pa.int64()) for i in (3, 4, 5)],
            names=["block", "place", "key", "total", "least", "alone"],
        )

    def replay(self, batches: Iterator[pa.RecordBatch], before: dict[int, int]) -> Iterator[pa.RecordBatch]:
        """What the first group of a block has used after it."""
        first, block, used = None, None, 0
        for batch, groups, sizes in self.segments(batches):
            for key, a, z in groups:
                if first is None:
                    first, block = key, batch.column("_block")[0].as_py()
                    used = before[block]
                if key == first:
                    used += int(_admitted(sizes[a:z], used, self.most)[1][-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([] if block is None else [block], pa.int32()), pa.array([] if block is None else [used], pa.int64())], names=["block", "used"]
        )

    def walk(self, batches: Iterator[pa.RecordBatch], before: dict[int, int]) -> Iterator[pa.RecordBatch]:
        """The rows with what is used after each, and whether it was admitted."""
        current, used, started = None, 0, False
        for batch, groups, sizes in self.segments(batches):
            sums, fits = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for key, a, z in groups:
                if not started or key != current:
                    used = 0 if started else before.get(batch.column("_block")[0].as_py(), 0)
                    current, started = key, True
                fits[a:z], added = _admitted(sizes[a:z], used, self.most)
                sums[a:z] = used + added
                used = int(sums[z - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums), pa.array(fits)], [*batch.schema.names, "admitted_bytes", "admitted"])


def _used_before(blocks: DataFrame, ledgers: _Ledgers) -> dict[int, int]:
    """What the first group of each block has used in the blocks before it.

    Each block tells two rows. A block is admitted whole if its size fits, and passed over if not even its smallest
    row does; only the others, at the border of the capacity, are read again, those of all groups together.
    """
    rows = blocks.mapInArrow(ledgers.borders, "block int, place int, key string, total bigint, least bigint, alone bigint").collect()
    chains: list[list] = []
    for row in sorted(rows, key=lambda r: (r.block, r.place)):
        if chains and row.place == 0 and chains[-1][-1].key == row.key and chains[-1][-1] is previous:
            chains[-1].append(row)
        else:
            chains.append([row])
        previous = row
    before: dict[int, int] = {}
    open_chains = [(chain, 1, chain[0].alone) for chain in chains if len(chain) > 1]
    while open_chains:
        asked = []
        for chain, at, used in open_chains:
            while at < len(chain):
                row = chain[at]
                before[row.block] = used
                if used + row.total <= ledgers.most:
                    used += row.total
                elif row.least is not None and used + row.least <= ledgers.most:
                    asked.append((chain, at, row.block))
                    break
                at += 1
        if not asked:
            break
        some = blocks.where(F.col("_block").isin([block for *_, block in asked]))
        known = {block: before[block] for *_, block in asked}
        done = {r.block: r.used for r in some.mapInArrow(lambda b: ledgers.replay(b, known), "block int, used bigint").collect()}
        open_chains = [(chain, at + 1, done[block]) for chain, at, block in asked]
    return before


def admit_skipping(
    df: DataFrame,
    max_bytes: int,
    partition: Sequence[str],
    order: Sequence[str] = ("received_at", "event_id"),
    size: str = "payload_bytes",
) -> DataFrame:
    """Adds ``admitted_bytes`` and ``admitted``: each row in order that still fits what was admitted before.

    A row that does not fit is refused and later, smaller ones may fit, so a decision needs all earlier ones. Rows
    are sorted once and cut into blocks; a ledger of any number of rows is spread over many. What is used before a
    block follows from the sizes of the blocks before it, and every block is then walked by itself. A null size is
    none, a null key is a group like any other.
    """
    blocks = ordered_blocks(df, partition, order)
    ledgers = _Ledgers(list(partition), size, max_bytes)
    before = _used_before(blocks, ledgers)
    schema = f"{_ddl(blocks)}, admitted_bytes long, admitted boolean"
    return blocks.mapInArrow(lambda b: ledgers.walk(b, before), schema).drop("_block")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

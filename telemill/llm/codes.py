"""Compression of vectors to codes of four bytes: a codebook per part by Ball k-means.

An entry of a codebook with the parts assigned to it is a ball. Only entries whose half distance is within the
ball's radius are its neighbours; a part nearer to its entry than to half the way to the nearest neighbour lies
in the stable core and keeps its entry; the others lie in rings between half distances and are compared with the
neighbours of their ring only. All of it is in whole numbers, so pruning never changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import written
from telemill.llm.integers import LARGEST, exact, integer_vectors, unpacked

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors and bytes of them that a task holds at a time, and neighbours that one product compares.
BLOCK_ROWS, BLOCK_BYTES, RING = 32_768, 16 << 20, 32

_STATE = "id long, label string, size int, vec binary, code binary, error long, part int, entry int, n long, far long, sums array<long>"


@dataclass
class Balls:
    """The entries of a part and how their balls lie.

    ``order`` names the other entries by distance and ``gaps`` holds these squared distances; the first
    ``reach`` are neighbours. A ``quiet`` entry has not moved and no neighbour has.
    """

    entries: np.ndarray
    order: np.ndarray | None = None
    gaps: np.ndarray | None = None
    reach: np.ndarray | None = None
    quiet: np.ndarray | None = None


def _up(square: int) -> int:
    """The square root, rounded up."""
    return isqrt(square) + (isqrt(square) ** 2 < square)


def balls(entries: np.ndarray, before: np.ndarray, far: np.ndarray) -> Balls:
    """The balls of moved entries.

    ``far`` holds the largest squared distance of a part to the entry it was assigned to, ``before`` those
    entries: the moved entry's ball reaches no farther than that distance and the move together.
    """
    moves = ((entries - before) ** 2).sum(axis=1)
    radius = np.array([_up(int(f)) + _up(int(m)) for f, m in zip(far, moves)], np.int64)
    squares = (entries**2).sum(axis=1)
    between = squares[:, None] + squares[None, :] - 2 * entries @ entries.T
    np.fill_diagonal(between, -1)
    order = np.argsort(between, axis=1, kind="stable")[:, 1:]
    gaps = np.take_along_axis(between, order, axis=1)
    reach = (gaps <= 4 * radius[:, None] ** 2).sum(axis=1)
    moved = moves > 0
    near = np.arange(order.shape[1])[None, :] < reach[:, None]
    return Balls(entries, order.astype(np.int32), gaps, reach, ~(moved | (moved[order] & near).any(axis=1)))


def nearest(rows: np.ndarray, entries: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row among some entries, ties to the first of them."""
    some = entries[among]
    gaps = (rows * rows).sum(axis=1)[:, None] - 2 * (rows @ some.T) + (some * some).sum(axis=1)[None, :]
    best = np.argmin(gaps, axis=1)
    return among[best], gaps[np.arange(len(rows)), best]


def assign(rows: np.ndarray, book: Balls, codes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row, as whole numbers; ``codes`` are those under the entries before."""
    rows = exact(rows, int(np.abs(book.entries).max(initial=0)))
    entries = book.entries.astype(rows.dtype)
    if codes is None or book.order is None:
        every = np.arange(len(entries))
        found = [nearest(rows[i : i + 8192], entries, every) for i in range(0, len(rows), 8192)]
        codes, gaps = (np.concatenate(x) for x in zip(*found))
        return codes.astype(np.int64), gaps.astype(np.int64)
    codes = codes.astype(np.int64)
    gaps = ((rows - entries[codes]) ** 2).sum(axis=1).astype(np.int64)
    best, least = codes.copy(), gaps.copy()
    awake = np.flatnonzero(~book.quiet[codes])
    awake = awake[np.argsort(codes[awake], kind="stable")]
    owners, starts = np.unique(codes[awake], return_index=True)
    for owner, members in zip(owners, np.split(awake, starts[1:])):
        reach = book.reach[owner]
        # A neighbour at more than twice a row's distance is farther than the row's own entry.
        ring = np.searchsorted(book.gaps[owner, :reach], 4 * gaps[members], side="right")
        out = np.argsort(-ring, kind="stable")
        members, ring = members[out], ring[out]
        for first in range(0, int(ring[0]), RING):
            some = members[: int((ring > first).sum())]
            found, gap = nearest(rows[some], entries, np.sort(book.order[owner, first : min(first + RING, reach)]))
            gap = gap.astype(np.int64)
            better = (gap < least[some]) | ((gap == least[some]) & (found < best[some]))
            best[some[better]], least[some[better]] = found[better], gap[better]
    return best, least


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The batches gathered into tables of a bounded size."""
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, 4 * size)))
    held, count = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            held.append(batch.slice(start, rows))
            count += held[-1].num_rows
            if count >= rows:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


def turn(state: DataFrame, books: list[Balls], size: int, first: bool) -> DataFrame:
    """The vectors with their codes under the given books, and what each task adds to the next ones.

    Rows of a task's sums have a ``part``: for each entry the number of its parts, their componentwise sum
    and the largest squared distance. They are as many as there are entries, however many vectors a task has.
    """
    shared = state.sparkSession.sparkContext.broadcast(books)
    parts, width, entries = len(books), size // len(books), len(books[0].entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((parts, entries), np.int64)
        far = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), np.int64)
        for table in _blocks(batches, size):
            fits = np.array(table["vec"].is_valid()) & (table["size"].to_numpy() == size)
            some = table.filter(pa.array(fits))
            rows = unpacked(some["vec"], size).astype(np.int64)
            before = None if first else np.frombuffer(b"".join(some["code"].to_pylist()), np.uint8).reshape(-1, parts)
            codes, error = np.zeros((len(rows), parts), np.int64), np.zeros(len(rows), np.int64)
            for p, book in enumerate(shared.value) if len(rows) else ():
                own = rows[:, p * width : (p + 1) * width]
                codes[:, p], gaps = assign(own, book, None if first else before[:, p])
                error += gaps
                n[p] += np.bincount(codes[:, p], minlength=entries)
                np.maximum.at(far[p], codes[:, p], gaps)
                order = np.argsort(codes[:, p], kind="stable")
                met, starts = np.unique(codes[order, p], return_index=True)
                if width:
                    sums[p, met] += np.add.reduceat(own[order], starts, axis=0)
            packed = np.full(len(fits), None, object)
            packed[fits] = [c.tobytes() for c in codes.astype(np.uint8)]
            errors = np.zeros(len(fits), np.int64)
            errors[fits] = error
            columns = [table[c].combine_chunks() for c in ("id", "label", "size", "vec")]
            columns += [pa.array(packed, pa.binary()), pa.array(errors, mask=~fits)]
            columns += [pa.nulls(len(fits), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
            for batch in pa.table(columns, names=names).to_batches(max_chunksize=4096):
                yield batch
        part, entry = np.nonzero(n)
        none = [pa.nulls(len(part), t) for t in (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64())]
        added = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(far[part, entry])]
        yield pa.RecordBatch.from_arrays(
            [*none, *added, pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=names
        )

    names = [c.split()[0] for c in _STATE.split(", ")]
    done = written(state.select("id", "label", "size", "vec", "code").mapInArrow(run, _STATE))
    shared.unpersist()
    return done


def moved(done: DataFrame, books: list[Balls]) -> list[Balls]:
    """The books after a turn: each entry is its parts' mean, rounded down; unused entries stay."""
    width = books[0].entries.shape[1]
    total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    added = done.where("part IS NOT NULL").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *total)
    entries = [b.entries.copy() for b in books]
    far = [np.zeros(len(b.entries), np.int64) for b in books]
    # A row for each used entry.
    for row in added.collect():
        entries[row.part][row.entry] = [row[f"s{i}"] // row.n for i in range(width)]
        far[row.part][row.entry] = row.far
    return [balls(e, b.entries, f) for e, b, f in zip(entries, books, far)]


def compress(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """``id, label, code, error`` for each vector, and the codebooks: entries by components for each part.

    Components are floor(``scale`` * x), cut into ``parts`` equal parts; ``code`` has a byte for each. Books
    start as the parts of the ``entries`` (256 at most) smallest ids, ties by the vector; each round assigns
    every part to the nearest entry (squared distance, ties to the lower one) and moves entries to the floor of
    their parts' mean. Between rounds the vectors and codes are a table in the shared folder; the driver holds
    only the books. Vectors that are null or hold null or non-finite components give no row. Null labels are
    kept. Null ids get codes but start no entry. Vectors have the size of the smallest id's; other
    sizes, sizes that ``parts`` doesn't divide, and numbers above :data:`LARGEST` get a null code and error.
    Repeated rows are coded alike. An empty table gives no row and no book.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    state = written(integer_vectors(df, id_col, vector_col, label_col, scale))
    able = state.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.col("size") % parts == 0))
    least = able.orderBy("id", "vec").select("size").first()
    if least is None:
        none = F.lit(None)
        return state.select("id", "label", none.cast("binary").alias("code"), none.cast("long").alias("error")), []
    size = least["size"]
    seeds = able.where(F.col("size") == size).orderBy("id", "vec").limit(entries).select("vec").collect()
    rows = unpacked(pa.array([bytes(r.vec) for r in seeds], pa.binary()), size).astype(np.int64)
    books = [Balls(np.ascontiguousarray(rows[:, p * size // parts : (p + 1) * size // parts])) for p in range(parts)]
    state = state.withColumn("code", F.lit(None).cast("binary"))
    for number in range(rounds):
        done = turn(state, books, size, first=number == 0)
        books = moved(done, books)
        state = done.where("part IS NULL")
    done = turn(state, books, size, first=rounds == 0)
    return done.where("part IS NULL").select("id", "label", "code", "error"), [b.entries for b in books]


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, in order, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """``id, vector``: the vectors that the codes stand for, each component in the middle of its step."""
    shared = [((b + 0.5) / scale).tolist() for b in books]
    tables = [F.array(*(F.array(*(F.lit(x) for x in e)) for e in b)) for b in shared]
    at = lambda p: F.conv(F.hex(F.substring("code", p + 1, 1)), 16, 10).cast("int")
    return codes.select("id", F.concat(*(F.get(t, at(p)) for p, t in enumerate(tables))).alias("vector"))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds ``label_error``, the errors of all rows of the label; null labels are one label."""
    total = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(total, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def _codes_sql() -> str:
    """The rounds written out: every part against every entry."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT p.vec_id, p.part, min((p.sq - 2 * list_dot_product(p.v, b.v) + b.sq) * 256 + b.entry) AS best
  FROM p JOIN b{i} b ON p.part = b.part GROUP BY p.vec_id, p.part
)""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (
  SELECT part, entry, list(mean ORDER BY pos) AS v FROM (
    SELECT part, entry, pos, floor(sum(x) / count(*)) AS mean FROM (
      SELECT a.part, CAST(a.best AS BIGINT) % 256 AS entry, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS pos
      FROM a{i} a JOIN p ON a.vec_id = p.vec_id AND a.part = p.part
    ) GROUP BY part, entry, pos
  ) GROUP BY part, entry
),
b{i + 1} AS MATERIALIZED (
  SELECT part, entry, v, list_dot_product(v, v) AS sq
  FROM (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m ON b.part = m.part AND b.entry = m.entry)
)""")
    return f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS MATERIALIZED (
  SELECT vec_id, part, v, list_dot_product(v, v) AS sq
  FROM (SELECT vec_id, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS v FROM k, range(4) r(part))
),
b0 AS (
  SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, v, sq
  FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256)
),
{", ".join(steps)},
c AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(best AS BIGINT) % 256), '' ORDER BY part) AS code,
    CAST(sum(floor(best / 256)) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY vec_id
),
h AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM b{ROUNDS})
)
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM c JOIN k ON c.vec_id = k.vec_id, h
"""


CODES_SQL = _codes_sql()

"""Near-duplicate vectors: spherical k-means cells and blocked cosine products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import saved
from telemill.llm.components import components, forest

#: Vectors the cells are fitted on, at most (chosen by a hash of the vector).
SAMPLE_ROWS = 20_000
#: Vectors a cell should have, and cells there are at most: what is broadcast is that many centroids.
CELL_ROWS, MOST_CELLS = 4096, 1024
#: Rows of each side of one product.
BLOCK_ROWS = 2048
#: A vector also visits the cells whose border is this near.
MARGIN = 0.2

_UNIT = "<f8"


def unit_rows(data: list[bytes]) -> np.ndarray:
    """Packed vectors as rows of length one, in double precision."""
    rows = np.frombuffer(b"".join(data), _UNIT).reshape(len(data), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, size, h1, h2, vec``; rows that can link with nothing have a null ``vec``.

    These are vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    label or id. ``vec`` is the packed double precision vector, ``h1, h2`` its 128-bit digest.
    """
    slim = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, halves = [], []
            for row, label, vector in zip(*(c.to_pylist() for c in batch.columns)):
                data = None
                if row is not None and label is not None and vector and None not in vector:
                    # Negative zero is zero.
                    values = np.array(vector, _UNIT) + 0.0
                    with np.errstate(over="ignore"):
                        norm = np.linalg.norm(values)
                    if norm > 0 and not np.isfinite(norm) and np.isfinite(values).all():
                        values = values / np.abs(values).max()
                    elif norm == 0 and values.any():
                        values = values / np.abs(values).max()
                    if values.any() and np.isfinite(values).all():
                        data = values.tobytes()
                packed.append(data)
                halves.append(np.frombuffer(xxhash.xxh3_128_digest(data or b""), "<i8"))
            digests = np.array(halves).reshape(-1, 2)
            sizes = [0 if x is None else len(x) // 8 for x in packed]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(packed, pa.binary())],
                ["id", "label", "size", "h1", "h2", "vec"],
            )

    return slim.mapInArrow(run, "id long, label string, size int, h1 long, h2 long, vec binary")


def k_means(rows: np.ndarray, cells: int, turns: int = 12) -> np.ndarray:
    """Centroids of length one; deterministic for the same rows in the same order."""
    rng = np.random.default_rng(7)
    centroids = rows[rng.choice(len(rows), min(cells, len(rows)), replace=False)].copy()
    for _ in range(turns):
        nearest = np.argmax(rows @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, rows)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def fit_cells(nodes: DataFrame, sample_rows: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS) -> np.ndarray:
    """Spherical k-means over a bounded sample of the most frequent vector size; one task."""
    sizes = nodes.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return np.zeros((0, 1))
    cells = min(MOST_CELLS, max(1, math.ceil(nodes.count() / cell_rows)))
    sample = nodes.where(F.col("size") == sizes["size"]).orderBy("h1", "h2", "label").limit(sample_rows).select("h1", "h2", "vec")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        rows = unit_rows([bytes(x) for x in frame.sort_values(["h1", "h2"]).vec])
        return pd.DataFrame({"centroids": [k_means(rows, cells).astype(_UNIT).tobytes()]})

    found = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, "centroids binary").first()
    return np.frombuffer(bytes(found.centroids), _UNIT).reshape(-1, sizes["size"])


def assign(nodes: DataFrame, centroids: np.ndarray, margin: float) -> DataFrame:
    """``label, size, cell, home, rep, w, vec``: a row for a vector's own cell and each that it visits.

    A vector y of another cell that is within distance ``margin`` of x lies on the other side of the plane
    halfway between both centroids, so x is no farther than ``margin`` from that plane. Of two cells the
    vectors of the lower one visit the higher one, so that each pair meets once.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(centroids)
    columns = ["label", "size", "rep", "w", "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        gaps = np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2) if len(c) else np.zeros((0, 0))
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                fits = np.array(batch.column(1).to_pylist()) == c.shape[1] if len(c) else np.zeros(batch.num_rows, bool)
                at, cell, home = [np.arange(batch.num_rows)], [np.zeros(batch.num_rows, np.int64)], [np.ones(batch.num_rows, bool)]
                if fits.any():
                    packed = batch.column(4).to_pylist()
                    place = np.flatnonzero(fits)
                    scores = unit_rows([packed[i] for i in place]) @ c.T
                    own = np.argmax(scores, axis=1)
                    cell[0][place] = own
                    best = scores[np.arange(len(place)), own]
                    near = best[:, None] - scores <= margin * gaps[own] + 1e-9
                    near &= np.arange(len(c))[None, :] > own[:, None]
                    r, other = np.nonzero(near)
                    at.append(place[r])
                    cell.append(other)
                    home.append(np.zeros(len(r), bool))
                rows = batch.take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(np.concatenate(cell)), pa.array(np.concatenate(home))], [*columns, "cell", "home"]
                )

    schema = "label string, size int, rep long, w long, vec binary, cell long, home boolean"
    return nodes.select(columns).mapInArrow(run, schema)


def blocks(placed: DataFrame, block_rows: int) -> DataFrame:
    """The rows dealt to the products of a cell: own blocks with each other, visiting blocks with own ones.

    A cell of any size becomes many products of about ``block_rows`` rows a side; ``side`` says on which
    side of a product a row stands (0 and 1; both for a block with itself).
    """
    key = ["label", "size", "cell"]
    counts = placed.groupBy(key).agg(
        F.ceil(F.count_if(F.col("home")) / block_rows).cast("int").alias("own"),
        F.ceil(F.count_if(~F.col("home")) / block_rows).cast("int").alias("guests"),
    )
    sized = placed.join(counts, key).where("own > 0")
    block = F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("own")).otherwise(F.col("guests"))).cast("int")
    b = F.col("block")
    own = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda j: F.struct(
        F.lit(False).alias("guest"), F.least(b, j).alias("a"), F.greatest(b, j).alias("b"),
        F.when(j == b, 2).when(b < j, 0).otherwise(1).alias("side"),
    ))
    guest = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda j: F.struct(
        F.lit(True).alias("guest"), b.alias("a"), j.alias("b"), F.lit(0).alias("side"),
    ))
    # Own blocks are also the other side of each visiting block.
    host = F.when(F.col("guests") > 0, F.transform(F.sequence(F.lit(0), F.col("guests") - 1), lambda j: F.struct(
        F.lit(True).alias("guest"), j.alias("a"), b.alias("b"), F.lit(1).alias("side"),
    ))).otherwise(F.array().cast("array<struct<guest:boolean,a:int,b:int,side:int>>"))
    dealt = F.when(F.col("home"), F.concat(own, host)).otherwise(guest)
    return sized.withColumn("block", block).select(*key, "rep", "w", "vec", F.inline(dealt))


def products(dealt: DataFrame, least: float) -> DataFrame:
    """``rep, n, root`` for each vector with links in a product: their number and a neighbour to reach.

    Links are counted from the product, not listed; of the links of a product only a spanning forest leaves
    the task, so a block of copies that are all near each other gives a row per vector.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"rep": [], "n": [], "root": []}).astype("int64")
        left, right = frame[frame.side != 1], frame[frame.side != 0]
        if not len(left) or not len(right):
            return none
        same = bool((frame.side == 2).any())
        a, b = left.rep.to_numpy(), right.rep.to_numpy()
        near = unit_rows([bytes(x) for x in left.vec]) @ unit_rows([bytes(x) for x in right.vec]).T >= least
        if same:
            np.fill_diagonal(near, False)
            near |= near.T
        nodes = [a] if same else [a, b]
        counts = [near @ right.w.to_numpy()] if same else [near @ right.w.to_numpy(), near.T @ left.w.to_numpy()]
        i, j = np.nonzero(np.triu(near) if same else near)
        if not len(i):
            return none
        moved, root = forest(a[i], b[j])
        ids, n = np.concatenate(nodes), np.concatenate(counts)
        found = pd.DataFrame({"rep": ids[n > 0], "n": n[n > 0]})
        found["root"] = found.rep.map(dict(zip(moved.tolist(), root.tolist()))).fillna(found.rep).astype("int64")
        return found.astype("int64")

    return dealt.groupBy("label", "size", "cell", "guest", "a", "b").applyInPandas(run, "rep long, n long, root long")


def _named(nodes: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``rep``, a name of its own for each node: its smallest id, or a digest where other vectors have that id, too."""
    shared = nodes.groupBy("least").agg(F.count("*").alias("n")).where("n > 1").select(F.col("least").alias("again"))
    joined = nodes.join(shared, F.col("least") == F.col("again"), "left")
    return joined.withColumn("rep", F.when(F.col("again").isNull(), F.col("least")).otherwise(F.xxhash64(*key))).drop("again")


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98,
    margin: float | None = None, sample_rows: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``id, n_links, component_id, kept`` for every row.

    Vectors of equal, non-null labels link at a cosine of ``least`` or more, in double precision. Equal
    vectors of a label are one node with a weight, so a group of copies costs one row. Nodes go to the cell
    of the nearest centroid and visit the cells whose border is within ``margin``; products of bounded blocks
    compare a cell's vectors. The default margin, the distance of two vectors at ``least``, makes the result
    exact. A smaller one makes fewer visits where vectors fill the space evenly, at some loss (README).

    ``component_id`` is the smallest id reachable over links, itself included; that row is ``kept``. Null,
    empty, zero and non-finite vectors, null labels and null ids link with nothing and are kept. Vectors of
    different lengths do not link. Rows that repeat an id and vector count once; vectors that share an id are judged
    each by itself. An empty table gives no row.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * least)) if margin is None else margin
    every = saved(vectors(df, id_col, vector_col, label_col))
    key = ["label", "size", "h1", "h2"]
    distinct = every.where("vec IS NOT NULL").dropDuplicates(["id", *key])
    nodes = saved(_named(distinct.groupBy(key).agg(F.min("id").alias("least"), F.count("*").alias("w"), F.first("vec").alias("vec")), key))
    placed = saved(assign(nodes, fit_cells(nodes, sample_rows, cell_rows), reach))
    found = saved(products(blocks(placed, block_rows), least))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")).where("u <> v"))
    result = nodes.select(*key, "rep", "least", "w").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    result = result.withColumn("root", F.coalesce("root", "rep"))
    named = result.groupBy("root").agg(F.min("least").alias("component_id"))
    result = result.join(named, "root").select(*key, (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    joined = every.where("vec IS NOT NULL").select("id", *key).join(result, key).select("id", "n_links", "component_id")
    alone = every.where("vec IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))

"""Hard negatives by Fagin's threshold algorithm over blocks of rows.

Rows of a block stand in one sorted list per dimension. An anchor reads the lists from the end that its sign
favours, scores what it meets by random access, and stops once the threshold, the best score that an unread
row can still have, falls strictly below the kth score of each of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from telemill.llm.common import written
from telemill.llm.integers import exact, integer_vectors, unpacked

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative scores between these parts of the positive's score, both included.
LOW, HIGH = (50, 100), (95, 100)
#: Rows and anchors that meet in one group.
BLOCK_ROWS, BLOCK_ANCHORS = 32_768, 2048
#: Entries of each list that are read first; each later reading goes STEP times as deep.
DEPTH, STEP = 16, 4
#: Scores held at a time.
SCORES = 1 << 22

_NONE = -(1 << 62)
#: Bounds that scores never reach.
_LOWEST, _HIGHEST = -(1 << 61), 1 << 61


class Lists:
    """The rows of a block with a sorted list per dimension; ids ascend."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, largest: int):
        self.ids, self.labels = ids, labels
        self.rows = exact(rows, largest)
        self.order = np.argsort(rows, axis=0, kind="stable")
        self.values = np.take_along_axis(rows, self.order, axis=0)
        # Depths worth a look: beyond, the lists have shown about every row.
        self.depths, depth = [], DEPTH
        while depth * rows.shape[1] < len(rows):
            self.depths.append(depth)
            depth *= STEP

    def thresholds(self, anchors: np.ndarray) -> np.ndarray:
        """The best score of an unread row after each depth, for each anchor."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        found = [up @ self.values[-d] + down @ self.values[d - 1] for d in self.depths]
        return np.array(found, np.int64).reshape(len(self.depths), len(anchors))

    def read(self, anchor: np.ndarray, depth: int) -> np.ndarray:
        """The rows among the first ``depth`` of any list, each from the end that the anchor favours."""
        seen = np.zeros(len(self.rows), bool)
        seen[self.order[-depth:, anchor > 0]] = True
        seen[self.order[:depth, anchor < 0]] = True
        return np.flatnonzero(seen)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id, in this order."""
    place = np.arange(len(scores))
    if len(scores) > k:
        place = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return place[np.lexsort((ids[place], -scores[place]))][:k]


def top_within(
    lists: Lists, anchors: np.ndarray, allowed: list[np.ndarray | None], windows: list[list[tuple[int, int]]], k: int
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, window, ids, scores) of the ``k`` best allowed rows whose score lies in the window.

    ``allowed`` masks the rows an anchor may take (none: all). An anchor's windows share its reading.
    """
    ends = lists.thresholds(anchors)
    product = exact(anchors, int(np.abs(lists.rows).max(initial=0))).astype(lists.rows.dtype)

    def pick(a: int, some: np.ndarray | None, scores: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        ids = lists.ids if some is None else lists.ids[some]
        free = allowed[a] if some is None or allowed[a] is None else allowed[a][some]
        if free is not None:
            ids, scores = ids[free], scores[free]
        found = []
        for low, high in windows[a]:
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            inside = inside[best(scores[inside], ids[inside], k)]
            found.append((ids[inside], scores[inside]))
        return found

    whole = []
    for a, own in enumerate(windows):
        own_done = None
        highest = max(high for _, high in own)
        for level, depth in enumerate(lists.depths):
            # Above the highest score that counts no threshold can end the reading.
            if ends[level, a] >= highest:
                continue
            seen = lists.read(anchors[a], depth)
            found = pick(a, seen, (lists.rows[seen] @ product[a]).astype(np.int64))
            kth = [max(low, int(s[k - 1]) if len(s) == k else _NONE) for (low, _), (_, s) in zip(own, found)]
            if all(ends[level, a] < x for x in kth):
                own_done = found
                break
        if own_done is None:
            whole.append(a)
        else:
            yield from ((a, w, ids, s) for w, (ids, s) in enumerate(own_done))
    # Readings that reach the ends of the lists: every row is scored, some anchors at a time.
    step = max(1, SCORES // max(1, len(lists.rows)))
    for start in range(0, len(whole), step):
        some = whole[start : start + step]
        for a, scores in zip(some, (product[some] @ lists.rows.T).astype(np.int64)):
            yield from ((a, w, ids, s) for w, (ids, s) in enumerate(pick(a, None, scores)))


def _lists(table: pa.Table, labels: dict, largest: int) -> Lists:
    table = table.sort_by("id")
    codes = np.array([labels.setdefault(x, len(labels)) for x in table["label"].to_pylist()], np.int64)
    size = table["size"][0].as_py()
    return Lists(table["id"].to_numpy(), codes, unpacked(table["vec"], size).astype(np.int64), largest)


def _sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    anchor = table["anchor"].combine_chunks()
    return table.filter(anchor), table.filter(pa.compute.invert(anchor))


_PAIRS = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _pairs(found: list[tuple]) -> pa.Table:
    columns = list(zip(*found)) or [()] * len(_PAIRS)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _PAIRS)], schema=_PAIRS)


def _positives(k: int):
    def run(table: pa.Table) -> pa.Table:
        anchors, rows = _sides(table)
        if not anchors.num_rows or not rows.num_rows:
            return _pairs([])
        ids, own = anchors["id"].to_pylist(), unpacked(anchors["vec"], anchors["size"][0].as_py()).astype(np.int64)
        lists = _lists(rows, {}, int(np.abs(own).max(initial=0)))
        allowed = [lists.ids != i for i in ids]
        windows = [[(_LOWEST, _HIGHEST)]] * len(ids)
        return _pairs([
            (ids[a], None, None, int(i), int(s))
            for a, _, near, scores in top_within(lists, own, allowed, windows, k) for i, s in zip(near, scores)
        ])

    return run


def _negatives(k: int, low: tuple[int, int], high: tuple[int, int]):
    def run(table: pa.Table) -> pa.Table:
        anchors, rows = _sides(table)
        if not anchors.num_rows or not rows.num_rows:
            return _pairs([])
        own = unpacked(anchors["vec"], anchors["size"][0].as_py()).astype(np.int64)
        labels: dict = {}
        lists = _lists(rows, labels, int(np.abs(own).max(initial=0)))
        others = {code: lists.labels != code for code in labels.values()}
        allowed, windows, named = [], [], []
        for label, positives in zip(anchors["label"].to_pylist(), anchors["positives"].to_pylist()):
            allowed.append(others.get(labels.get(label)))
            bounds = [(-(-low[0] * p["score"] // low[1]), high[0] * p["score"] // high[1]) for p in positives]
            windows.append(bounds)
            named.append([(p["id"], p["score"]) for p in positives])
        # An empty window takes nothing; an anchor of empty windows reads nothing.
        some = [a for a, w in enumerate(windows) if any(x <= y for x, y in w)]
        kept = [[(x, y) if x <= y else (_HIGHEST, _LOWEST) for x, y in windows[a]] for a in some]
        ids = anchors["id"].to_pylist()
        return _pairs([
            (ids[some[a]], *named[some[a]][w], int(i), int(s))
            for a, w, near, scores in top_within(lists, own[some], [allowed[a] for a in some], kept, k)
            for i, s in zip(near, scores)
        ])

    return run


def _meet(rows: DataFrame, anchors: DataFrame, keys: list[str], block_rows: int, block_anchors: int) -> DataFrame:
    """Rows and anchors of equal keys dealt to groups: every block of rows meets every block of anchors."""
    blocks = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("row_blocks"))
    blocks = blocks.join(
        anchors.groupBy(*keys).agg(F.ceil(F.count("*") / block_anchors).cast("int").alias("anchor_blocks")), keys
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("id", "vec"), F.col(n)).cast("int")
    common = [c for c in rows.columns if c not in keys]
    left = rows.join(blocks, keys).select(
        *keys, *common, F.lit(None).cast(anchors.schema["positives"].dataType).alias("positives"),
        F.lit(False).alias("anchor"), deal("row_blocks").alias("row_block"), every("anchor_blocks").alias("anchor_block"),
    )
    right = anchors.join(blocks, keys).select(
        *keys, *common, "positives", F.lit(True).alias("anchor"), every("row_blocks").alias("row_block"),
        deal("anchor_blocks").alias("anchor_block"),
    )
    return left.unionByName(right).groupBy(*keys, "row_block", "anchor_block")


def mine(
    df: DataFrame, is_anchor, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: tuple[int, int] = LOW, high: tuple[int, int] = HIGH,
    scale: int = SCALE, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on the column ``id``. A score is the inner product of two vectors with
    components floor(``scale`` * x); higher ones come first, ties by smaller id. An anchor's positives are its
    first ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels are
    given whose score is between ``low`` and ``high`` times the positive's (fractions of whole numbers).

    Rows with a null label, id or vector, or with a null or non-finite component (or one beyond
    :data:`integers.LARGEST`) take no part. Rows that share an id are one row, that of the least label and vector.
    Of equal vectors of a label only the smallest ids can be among the first, so a group of copies costs as many
    rows as an anchor takes. Vectors meet those of their size. Anchors are compared with all rows in blocks of
    ``block_rows`` rows and ``block_anchors`` anchors, whose best rows are merged. Empty tables give no row.
    """
    every = integer_vectors(df, id_col, vector_col, label_col, scale).where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    one = every.groupBy("id").agg(F.min(F.struct("label", "size", "vec")).alias("r")).select("id", "r.*")
    one = written(one)
    # Spark limits the rank before it shuffles.
    rank = F.row_number().over(W.partitionBy("label", "size", "vec").orderBy("id"))
    rows = written(one.withColumn("copy", rank).where(F.col("copy") <= max(positives + 1, negatives)).drop("copy"))
    none = F.lit(None).cast("array<struct<id:long,score:long>>").alias("positives")
    anchors = one.where(is_anchor).select("*", none)

    schema = "anchor_id long, positive_id long, positive_score long, id long, score long"
    near = _meet(rows, anchors, ["label", "size"], block_rows, block_anchors).applyInArrow(_positives(positives), schema)
    first = W.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    near = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives)
    # At most ``positives`` rows for each anchor.
    lists = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("id", "score"))).alias("positives"))
    ready = written(anchors.drop("positives").join(lists, F.col("id") == F.col("anchor_id")).drop("anchor_id"))

    far = _meet(rows, ready, ["size"], block_rows, block_anchors).applyInArrow(_negatives(negatives, low, high), schema)
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    return far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


NEGATIVES_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""

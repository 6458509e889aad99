"""Toxicity classifier with a counterfactual penalty on identity terms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import keyed, saved, steps
from telemill.llm.decontaminate import words_of

#: Labelled rows the classifier is fitted on, at most (chosen by a hash of the id, so evenly).
SAMPLE_ROWS = 20_000
#: Features the model may have.
FEATURES = 1024
#: Labelled rows a feature has to occur in.
LEAST_ROWS = 3
#: Lengths of word beginnings that are features beside the whole words.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Weight of the squared size of the coefficients, and of squared changes of the score under swaps.
RIDGE, COUNTERFACTUAL = 0.3, 10.0
#: Words whose features a Python worker remembers.
REMEMBERED = 150_000

# Groups of terms that name people; a swap puts another term of the same group in place.
IDENTITY_GROUPS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("black", "white", "asian", "latino"),
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"),
    ("immigrants", "natives"), ("immigrant", "native"), ("old", "young"), ("disabled", "blind", "deaf"),
    ("american", "african", "european", "mexican", "chinese", "arab"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_SWAPS = {
    term.encode(): tuple(group[(i + k) % len(group)].encode() for k in range(1, min(3, len(group))))
    for group in IDENTITY_GROUPS
    for i, term in enumerate(group)
}


def features_of(word: bytes) -> tuple[str, ...]:
    """The features of one word: itself and its beginnings."""
    text = word.decode("utf-8", "replace")
    return (f"={text}", *(f"^{text[:n]}" for n in BEGINNINGS if len(text) > n))


def distinct_words(text: str | None) -> set[bytes]:
    """The lower-case words of a text."""
    return set(words_of((text or "").lower().encode("utf-8", "replace")))


def swapped(words: set[bytes]) -> list[set[bytes]]:
    """The words of the text with its identity terms swapped; none if it has no such term."""
    found = [w for w in words if w in _SWAPS]
    out = []
    for turn in range(2 if found else 0):
        new = {_SWAPS[w][min(turn, len(_SWAPS[w]) - 1)] for w in found}
        out.append((words - set(found)) | new)
    return out


class _Active(dict):
    """Word to the numbers of its model features; nearly always none."""

    def __init__(self, numbers: dict[str, int]):
        self.numbers = numbers

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = tuple(self.numbers[f] for f in features_of(word) if f in self.numbers)
        self[word] = found
        return found

    def of(self, words: set[bytes]) -> list[int]:
        """The distinct features of a set of words."""
        return sorted({n for w in words for n in self[w]})


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label: str, rows: int) -> DataFrame:
    """``text, label`` of at most ``rows`` labelled documents whose crc32 of the id is no multiple of five.

    The chosen ids are broadcast: there are ``rows`` of them at most. Of several labels of an id the highest
    counts; null labels and ids are left out.
    """
    known = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).dropna()
    known = known.groupBy("id").agg(F.max("label").alias("label")).where(~held_out("id"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    return keyed(docs, id_col, text_col).join(F.broadcast(chosen), "id").select("text", "label")


def held_out(column: str):
    """Whether a row is kept from training: the crc32 of its id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, 0):
        counts: dict[str, list[int]] = {}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for f in {f for w in distinct_words(text) for f in features_of(w)}:
                counts.setdefault(f, [0, 0])[label > 0] += 1
        arrays = [pa.array(list(counts)), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays(arrays, ["feature", "neg", "pos"])


def vocabulary(rows: DataFrame, features: int) -> list[str]:
    """The features that tell most about the label by the G statistic of their two-by-two table."""
    sums = rows.agg(F.expr("count_if(label > 0)"), F.expr("count_if(label <= 0)")).first()
    positive, negative = (float(x or 0) for x in sums)
    total = positive + negative
    if not positive or not negative:
        return []
    counted = rows.mapInArrow(_counts, "feature string, neg long, pos long").groupBy("feature")
    counted = counted.agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).where(f"neg + pos >= {LEAST_ROWS}")

    def part(seen: str, expected: str) -> str:
        return f"CASE WHEN {seen} > 0 THEN ({seen}) * ln(({seen}) / ({expected})) ELSE 0 END"

    g = " + ".join((
        part("pos", f"(pos + neg) * {positive / total}D"),
        part("neg", f"(pos + neg) * {negative / total}D"),
        part(f"({positive}D - pos)", f"({total}D - pos - neg) * {positive / total}D"),
        part(f"({negative}D - neg)", f"({total}D - pos - neg) * {negative / total}D"),
    ))
    best = counted.select("feature", F.expr(g).alias("g")).orderBy(F.desc("g"), "feature").limit(features)
    return [r.feature for r in best.collect()]


def _fit(frame: pd.DataFrame, size: int, ridge: float, penalty: float) -> np.ndarray:
    """Weights and intercept by Newton's method on the ridge and counterfactual penalised logistic loss."""
    n = len(frame)
    x = np.zeros((n, size + 1), np.float32)
    x[:, size] = 1
    changes = []
    for row, (ids, others) in enumerate(zip(frame["ids"], frame["others"])):
        x[row, np.asarray(ids, np.int64)] = 1
        for other in others:
            change = x[row].copy()
            change[:size] = 0
            change[np.asarray(other, np.int64)] = 1
            change = x[row] - change
            if change.any():
                changes.append(change)
    y = (frame["label"].to_numpy() > 0).astype(np.float64)
    fixed = np.eye(size + 1) * ridge
    fixed[size, size] = 1e-6
    if changes:
        d = np.array(changes)
        fixed += penalty * (d.T @ d)
    w = np.zeros(size + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30).astype(np.float64)))
        gradient = x.T @ (p - y).astype(np.float32) + fixed @ w
        hessian = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x + fixed
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
    label: str = "toxic", rows: int = SAMPLE_ROWS, features: int = FEATURES, ridge: float = RIDGE,
    penalty: float = COUNTERFACTUAL,
) -> tuple[dict[str, float], float]:
    """Feature weights and intercept from at most ``rows`` labelled documents.

    Features are present or absent: words and word beginnings, chosen by what they tell about the label.
    Each labelled text with identity terms also appears with these swapped, and the loss adds ``penalty``
    times the squared change of the score, so that naming a group does not move it. Counting and feature
    extraction run over the sample's partitions; the fit itself is one task on at most ``rows`` short lists.
    Without labels of both kinds the model is a constant, the share of toxic labels.
    """
    chosen = saved(sample(docs, labels, id_col, text_col, label_id, label, rows))
    names = vocabulary(chosen, features)
    numbers = {f: i for i, f in enumerate(names)}
    if not names:
        n, positive = chosen.agg(F.count("*"), F.expr("count_if(label > 0)")).first()
        rate = (positive + 0.5) / (n + 2)
        return {}, math.log(rate / (1 - rate))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = _Active(numbers)
        for batch in steps(batches, 0):
            ids, others = [], []
            for text in batch.column(0).to_pylist():
                words = distinct_words(text)
                ids.append(active.of(words))
                others.append([active.of(x) for x in swapped(words)])
            kinds = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(ids, kinds[0]), pa.array(others, kinds[1])], ["label", "ids", "others"]
            )

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        # The order of rows must not matter for the last digits of the weights.
        order = sorted(range(len(frame)), key=lambda i: (list(frame["ids"].iloc[i]), int(frame["label"].iloc[i])))
        return pd.DataFrame({"weights": [_fit(frame.iloc[order], len(numbers), ridge, penalty).tolist()]})

    coded = chosen.mapInArrow(encode, "label int, ids array<int>, others array<array<int>>")
    weights = coded.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, "weights array<double>").first().weights
    return {f: weights[i] for f, i in numbers.items()}, weights[-1]


def score(df: DataFrame, model: tuple[dict[str, float], float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` for every row: the model's probability for the whole text; null and empty texts too."""
    names, intercept = list(model[0]), model[1]
    weights = np.array([model[0][f] for f in names] or [0.0])
    shared = df.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = _Active(shared.value)
        for batch in steps(batches, 1):
            found = [active.of(distinct_words(t)) for t in batch.column(1).to_pylist()]
            z = np.array([float(weights[ids].sum()) if ids else 0.0 for ids in found]) + intercept
            values = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["id", "score"])

    return keyed(df, id_col, text_col).mapInArrow(run, "id long, score double")


def reject(df: DataFrame, model: tuple[dict[str, float], float], text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose score stays below ``limit``; all columns stay and nothing is shuffled."""
    names, intercept = list(model[0]), model[1]
    weights = np.array([model[0][f] for f in names] or [0.0])
    shared, place = df.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)}), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = _Active(shared.value)
        for batch in steps(batches, place):
            found = [active.of(distinct_words(t)) for t in batch.column(place).to_pylist()]
            z = [float(weights[ids].sum()) + intercept if ids else intercept for ids in found]
            keep = [1 / (1 + math.exp(-max(-30, min(30, x)))) < limit for x in z]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)

"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import divided, free, keyed, saved, steps, utf8, written
from telemill.llm.components import components

BITS = 64


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The SimHash of one text: bit b is 1 if it is set in over half the shingles' XXH64 values.

    Words are runs without ASCII white space, A-Z in lower case; a text of fewer words is one shingle; no
    word gives zero.
    """
    found = text.lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        digests = xxhash.xxh64_digest(line, seed)
    else:
        ends = list(accumulate([len(w) + 1 for w in found]))
        starts = [0, *ends]
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(line[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :])])
    count = len(digests) // 8
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(count, 8), axis=1)
    # Groups of 255 rows add up in bytes.
    whole = count // 255 * 255
    ones = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        ones += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``id, fp`` (the 64 bits as a signed long) for every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            values = np.array([fingerprint(t, words) for t in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])

    return keyed(df, id_col, text_col).mapInArrow(run, "id long, fp long")


def segments(distance: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of the segments of a fingerprint.

    With three segments two fingerprints at distance ``d`` agree in one of them up to its radius, if the
    radii add up to ``d - 2``: otherwise they would differ in at least ``sum(radius + 1) = d + 1`` bits.
    """
    if not 0 <= distance <= 5:
        raise ValueError("distance must be between 0 and 5")
    total, widths, found, shift = max(0, distance - 2), (22, 21, 21), [], 0
    for i, width in enumerate(widths):
        # A segment of negative allowance is left out: the others already cover the distance.
        radius = total // 3 + (1 if i < total % 3 else 0)
        found.append((shift, width, radius))
        shift += width
    return found


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """``u, v``: all pairs of different fingerprints (column ``fp``) with at most ``distance`` differing bits.

    Every fingerprint stands once in the table of each segment. Probes enumerate the Hamming ball of the
    segment's radius; the join fetches table rows with that value, and the complete distance decides in the
    join itself. A pair is looked up by its smaller fingerprint only.
    """
    tables, probes = [], []
    for number, (shift, width, radius) in enumerate(segments(distance)):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        masks = [0] + ([1 << i for i in range(width)] if radius >= 1 else [])
        if radius >= 2:
            masks += [1 << i | 1 << j for i in range(width) for j in range(i)]
        tables.append(F.struct(F.lit(number).alias("segment"), value.alias("value")))
        probes += [F.struct(F.lit(number).alias("segment"), value.bitwiseXOR(F.lit(m)).alias("value")) for m in masks]
    table = distinct.select(F.col("fp").alias("v"), F.inline(F.array(*tables)))
    probe = distinct.select(F.col("fp").alias("u"), F.inline(F.array(*probes)))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)
    return probe.join(table, ["segment", "value"]).where(near).select("u", "v")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4
) -> DataFrame:
    """``id, fp, component_id`` for every row: the smallest id reachable over links of near fingerprints.

    Rows with one fingerprint are one node, so a group of copies costs one row however large it is, and
    only different fingerprints are compared. Texts without words share fingerprint zero and are linked
    like any other. A null id never becomes a component's name (a component of null ids only has none);
    rows that share an id are in the component of that id's fingerprints. An empty table gives no row.
    """
    every = saved(fingerprints(df, id_col, text_col, words))
    nodes = every.groupBy("fp").agg(F.min("id").alias("least"))
    # Rows that share an id join their fingerprints.
    ids = every.where("id IS NOT NULL").groupBy("id").agg(F.min("fp").alias("u"), F.max("fp").alias("v"))
    same = ids.where("u <> v").select("id", "u").join(every.withColumnRenamed("fp", "v"), "id").select("u", "v")
    edges = links(nodes, distance).unionByName(same)
    roots = saved(components(edges))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return every.join(rooted.select("fp", "root"), "fp").join(named, "root").select("id", "fp", "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``df`` with one document per group of near-duplicates: the one with the smallest id.

    All columns stay. Rows with a null id are kept. Rows that share an id are one document.
    """
    found = near_duplicates(df, id_col, text_col, words, distance)
    return _without(df, id_col, found.where("component_id <> id").select("id").distinct())


def _without(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id is not in ``ids``. Rows with a null id stay."""
    # No loss may follow from a null id, so the ids to remove are looked up, not those to keep.
    key = free(df, "gone")
    gone = written(ids.select(F.col("id").alias(key)))
    some, rest = divided(df, id_col, gone)
    # Only texts that may go are shuffled to meet their ids. Spark would put an anti-join before the filter.
    met = some.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(key), "left")
    return rest.unionByName(met.where(F.col(key).isNull()).drop(key))


#: Bits of a fingerprint of words, cut into segments that are keys of their own.
WORD_BITS, WORD_SEGMENT = 504, 24
#: Words of a shingle, and the least Jaccard similarity of near copies.
SHINGLE, LEAST = 5, 0.8
#: Bits of a sketch of shingles, one of each of as many least hashes. Those of texts of similarity j differ in
#: (1 - j) / 2 of the bits: 51 at 0.8, with a deviation of 7. Pairs of more differing bits than this are not compared.
SKETCH, APART = 512, 74
#: The same for the sketches of what is left then.
WIDE, WIDE_APART = 2048, 250
#: So many texts of a bucket are compared with all of it, before the rest is compared with each other.
TURNS = 3

_GOLD = 0x9E3779B97F4A7C15


def _mixed(hashes: np.ndarray, count: int) -> np.ndarray:
    """``count`` hashes from each."""
    mixed = hashes[:, None] + np.arange(1, count + 1, dtype=np.uint64)[None, :] * np.uint64(_GOLD)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return mixed ^ (mixed >> np.uint64(31))


def word_fingerprint(words: set[bytes]) -> np.ndarray:
    """The SimHash of a set of words as 64 bytes: bit b is 1 if it is set in over half the words' hashes."""
    first = np.frombuffer(b"".join([xxhash.xxh64_digest(w, 42) for w in words]), ">u8").astype(np.uint64)
    bits = np.unpackbits(_mixed(first, 8).astype(">u8").view(np.uint8).reshape(len(words), -1), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int32) > len(words))


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The different shingles of a text as hashes; a text of fewer words is one shingle, one of none has none."""
    if not words:
        return np.zeros(0, np.int64)
    line = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    digest = xxhash.xxh3_64_digest
    found = {digest(line[a : b - 1]) for a, b in zip(starts, ends[size - 1 :] or ends[-1:])}
    return np.frombuffer(b"".join(found), ">i8").astype(np.int64)


_CELLS = 1 << 16
_MULTIPLIERS = _mixed(np.array([7], np.uint64), WIDE)[0] | np.uint64(1)


def sketch(found: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """One bit of each of the least hashes of a set of shingles, packed."""
    if not len(found):
        return np.zeros(bits // 8, np.uint8)
    values, least = found.view(np.uint64), np.full(bits, np.iinfo(np.uint64).max, np.uint64)
    # Products of a step stay in the processor's cache.
    rows = max(1, _CELLS // bits)
    for start in range(0, len(values), rows):
        np.minimum(least, np.multiply.outer(values[start : start + rows], _MULTIPLIERS[:bits]).min(axis=0), out=least)
    return np.packbits((least * np.uint64(_GOLD) >> np.uint64(63)).astype(bool))


_SKETCH = [f"s{i}" for i in range(SKETCH // 64)]


def _word_rows(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``id, t1, t2, keys, s0..s7``: digest of the words in order, segments of the fingerprint, sketch of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1, 1 << 20):
            texts, prints, sketches = [], [], []
            for text in utf8(batch.column(1)):
                words = text.lower().split()
                texts.append(xxhash.xxh3_128_digest(b" ".join(words)))
                prints.append(word_fingerprint(set(words)) if words else np.zeros(64, np.uint8))
                sketches.append(sketch(shingles(words, size)))
            rows = np.array(prints, np.uint8).reshape(-1, 64)
            halves = np.frombuffer(b"".join(texts), ">i8").astype(np.int64).reshape(-1, 2)
            parts = rows[:, : WORD_BITS // 8].reshape(len(rows), -1, WORD_SEGMENT // 8).astype(np.int64)
            values = (parts[:, :, 0] << 16) + (parts[:, :, 1] << 8) + parts[:, :, 2]
            keys = values + (np.arange(values.shape[1]) << WORD_SEGMENT)[None, :]
            ends = np.arange(len(rows) + 1, dtype=np.int32) * keys.shape[1]
            bits = np.array(sketches, np.uint8).reshape(-1, SKETCH // 8).view(">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.ListArray.from_arrays(ends, pa.array(keys.ravel())),
                    *(pa.array(np.ascontiguousarray(c)) for c in bits.T),
                ],
                ["id", "t1", "t2", "keys", *_SKETCH],
            )

    slim = keyed(df, id_col, text_col).where("id IS NOT NULL")
    return slim.mapInArrow(run, f"id long, t1 long, t2 long, keys array<long>, {', '.join(f'{s} long' for s in _SKETCH)}")


def _shingle_rows(df: DataFrame, size: int) -> DataFrame:
    """``id, shingles`` of ``id, text`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1, 1 << 20):
            sets = [shingles(t.lower().split(), size) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return df.mapInArrow(run, "id long, shingles array<long>")


def _wide_rows(df: DataFrame, size: int) -> DataFrame:
    """``id, wide, shingles`` of ``id, text`` rows: the wide sketch, and what it is made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1, 1 << 20):
            sets = [shingles(t.lower().split(), size) for t in utf8(batch.column(1))]
            found = [sketch(s, WIDE).view(">i8").astype(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in (found, sets))], ["id", "wide", "shingles"])

    return df.mapInArrow(run, "id long, wide array<long>, shingles array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``u, v`` whose shingles have a Jaccard similarity of ``least`` or more, exactly."""
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    either = F.size("a") + F.size("b") - both
    return pairs.join(left, "u").join(right, "v").where((both >= F.lit(least) * either) & (either > 0)).select("u", "v")


def similar_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = LEAST, apart: int = APART
) -> DataFrame:
    """``id, component_id`` for each row with an id: the smallest id reachable over near copies.

    Near copies have a Jaccard similarity of ``least`` or more over shingles of ``size`` words. Fingerprints of
    shingles of such texts differ in up to a quarter of their bits, beyond what segments can retrieve, so the
    fingerprints are those of the words a text has: near copies share nearly all of them. Each of the 21 segments
    of 24 bits is a key, so any two fingerprints with 20 or fewer differing bits meet. Texts that share a key are
    compared by their shingles, if sketches of these differ in at most ``apart`` of 512 bits.

    Texts of equal words are one node, however many. The texts of a bucket are compared with ``TURNS`` of them. What is
    then in other components is compared with all others of the bucket: every pair of a bucket is in one component or
    has been looked at, though a large group of near copies does not become all its pairs. Texts of no words are copies
    of each other. Rows that share an id may be different texts; what links one of them counts for the id. An empty
    table gives no row.

    Fingerprints and sketches are made in one pass. Texts are read again only if they are near another by their
    sketches, and no others are shuffled, however large the table is.
    """
    rows = written(_word_rows(df, id_col, text_col, size))
    # All copies have one fingerprint and one sketch, so those of any of them serve.
    nodes = written(rows.groupBy("t1", "t2").agg(F.min("id").alias("node"), *(F.first(c).alias(c) for c in ("keys", *_SKETCH))))
    texts = keyed(df, id_col, text_col)
    shared = written(nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    placed = nodes.select("node", F.explode("keys").alias("key")).join(shared, "key")
    placed = written(placed.join(nodes.select("node", *_SKETCH), "node"))
    other = [f"o{c}" for c in _SKETCH]

    def differ(of: str = "") -> Column:
        """The bits in which a row's sketch differs from that of ``of``."""
        return sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{of}{o}"))) for c, o in zip(_SKETCH, _SKETCH if of else other)), F.lit(0))

    def picked(ids: DataFrame) -> DataFrame:
        """The texts of some different ids; only those that may be theirs are shuffled to meet them."""
        # Spark would put a semi-join before the filter.
        return divided(texts, "id", ids)[0].join(ids, "id").select("id", "text")

    def ordered(pairs: DataFrame) -> DataFrame:
        return written(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())

    ones = placed.groupBy(F.col("key").alias("okey")).agg(
        *(F.min_by(F.struct("node", *_SKETCH), F.xxhash64("node", F.lit(turn))).alias(f"t{turn}") for turn in range(TURNS))
    )
    near = [(F.col("node") != F.col(f"t{turn}.node")) & (differ(f"t{turn}.") <= apart) for turn in range(TURNS)]
    star = placed.join(ones, (F.col("key") == F.col("okey")) & reduce(Column.__or__, near))
    found = F.array(*(F.when(near[turn], F.col(f"t{turn}.node")) for turn in range(TURNS)))
    pairs = ordered(star.select("node", F.explode(found).alias("u")).where("u IS NOT NULL").withColumnRenamed("node", "v"))
    ends = written(pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "id"))
    links = written(_similar(pairs, written(_shingle_rows(picked(ends), size)), least))
    roots = written(components(links))
    # The rows of buckets whose texts are in more than one component.
    every = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = every.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min_by("root", F.xxhash64("node", F.lit(0))).alias("home")
    )
    open_rows = written(every.join(mixed.where("low < high").select("key", "home"), "key"))
    # The component of a bucket's first text is told from the others, whose texts meet all of the bucket.
    away = open_rows.where("root <> home").select(
        "key", F.col("node").alias("u"), F.col("root").alias("oroot"), *(F.col(c).alias(o) for c, o in zip(_SKETCH, other))
    )
    meet = (F.col("root") != F.col("oroot")) & (differ() <= apart)
    # Those that are near none by their sketches are done with, before wide ones are made.
    away = written(away.join(open_rows.withColumnRenamed("key", "okey"), (F.col("key") == F.col("okey")) & meet, "left_semi"))
    close = written(open_rows.join(away.withColumnRenamed("key", "okey"), (F.col("key") == F.col("okey")) & meet, "left_semi"))
    some = written(away.select("u").union(close.select("node")).distinct().withColumnRenamed("u", "id"))
    sets = written(_wide_rows(picked(some), size))
    keys = open_rows.join(some, open_rows.node == some.id, "left_semi").groupBy("node").agg(F.collect_set("key").alias("keys"))
    known = written(keys.join(sets.select(F.col("id").alias("node"), "wide"), "node"))
    away = away.join(known.select(F.col("node").alias("u"), F.col("keys").alias("okeys"), F.col("wide").alias("owide")), "u")
    # A pair is looked at in one of the buckets it shares.
    once = F.array_min(F.array_intersect("keys", "okeys")) == F.col("key")
    far = F.aggregate(F.zip_with("wide", "owide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    rest = away.join(close.join(known, "node"), "key").where(meet & once & (far <= WIDE_APART))
    pairs = ordered(rest.select("u", F.col("node").alias("v")))
    links = links.unionByName(_similar(pairs, sets.select("id", "shingles"), least))
    roots = written(components(links))
    named = nodes.join(roots, "node", "left").select("t1", "t2", F.coalesce("root", "node").alias("component_id"))
    return rows.select("id", "t1", "t2").join(named, ["t1", "t2"]).groupBy("id").agg(F.min("component_id").alias("component_id"))


def near_or_similar(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = LEAST, apart: int = APART,
    words: int = 4, distance: int = 4,
) -> DataFrame:
    """``id, component_id`` for each row that is near another: the smallest id reachable over the links of
    :func:`near_duplicates` and of :func:`similar_copies` together.

    A link of either counts, so a group may hold links of both. Ids that neither links do not appear.
    """
    found = near_duplicates(df, id_col, text_col, words, distance).select("id", "component_id")
    found = found.unionByName(similar_copies(df, id_col, text_col, size, least, apart))
    edges = found.where("component_id <> id").select(F.col("id").alias("u"), F.col("component_id").alias("v"))
    return components(edges).select(F.col("node").alias("id"), F.col("root").alias("component_id"))


def keep_first_similar(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = LEAST, apart: int = APART
) -> DataFrame:
    """The rows of ``df`` with one document per group of :func:`similar_copies`: the one with the smallest id.

    All columns stay. Rows with a null id are kept.
    """
    found = similar_copies(df, id_col, text_col, size, least, apart)
    return _without(df, id_col, found.where("component_id <> id").select("id"))


def keep_first_of_both(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = LEAST, apart: int = APART,
    words: int = 4, distance: int = 4,
) -> DataFrame:
    """The rows of ``df`` with one document per group of :func:`near_or_similar`: the one with the smallest id.

    All columns stay. Rows with a null id are kept. Rows that share an id are one document.
    """
    found = near_or_similar(df, id_col, text_col, size, least, apart, words, distance)
    return _without(df, id_col, found.where("component_id <> id").select("id"))

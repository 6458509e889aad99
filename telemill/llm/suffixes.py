"""Removal of repeated substrings with a distributed difference-cover suffix array."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import STEP_BYTES, written

#: Bytes of a repeat.
LENGTH = 100
#: Bytes of the piece that names a string's group: the least of its pieces by hash.
PIECE = 32
#: Bytes of text one suffix array is built on, about.
ARRAY_BYTES = 1 << 19
#: Bytes of text that are hashed at a time; a place takes some 60 bytes of memory.
HASH_BYTES = 1 << 18
#: Groups of more texts are dealt further, by the ends of their strings.
GROUP_UNITS = 4096
#: Strings of crowded groups that one step of a task holds, to send equal ones once.
STEP_STRINGS = 1 << 17

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LOW24 = np.uint64((1 << 24) - 1)


# ---------------------------------------------------------------- suffix array


def _names(*keys: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each tuple among the distinct tuples, from 1, and their number."""
    ranks = keys[0].astype(np.int64)
    for key in keys[1:]:
        letters = int(key.max(initial=0)) + 1
        if (int(ranks.max(initial=0)) + 1) * letters >= 1 << 62:
            # Ranks instead, so that a key stays below 64 bits.
            _, ranks = np.unique(ranks, return_inverse=True)
        ranks = ranks * letters + key
    _, ranks = np.unique(ranks, return_inverse=True)
    ranks = ranks.astype(np.int64) + 1
    count = int(ranks.max(initial=0))
    return ranks, count


def _order(ranks: np.ndarray, top: int) -> np.ndarray:
    """The places of whole numbers from 0 to ``top`` in their order; they are only sorted if one comes twice."""
    places = np.full(top + 1, -1, np.int64)
    places[ranks] = np.arange(len(ranks))
    order = places[places >= 0]
    return order if len(order) == len(ranks) else np.argsort(ranks, kind="stable")


def suffix_ranks(s: np.ndarray, depth: int, reach: int = 1) -> np.ndarray:
    """Ranks of all suffixes of a sequence of positive numbers by their first ``depth`` letters or more.

    The difference cover modulo three: the triples at positions 1 and 2 (mod 3) are sorted and named; unless
    all names differ, or a name already stands for ``depth`` letters (``reach`` letters per number), the
    sequence of names is ranked in the same way. The remaining suffixes are sorted by their first number and
    the rank of the next suffix, and both are merged. Suffixes that agree in ``depth`` letters may share a
    rank or be neighbours; their order is that of the first letter in which they differ.
    """
    n = len(s)
    if n < 3:
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        out = np.empty(n, np.int64)
        out[order] = np.arange(1, n + 1)
        return out
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    # A sample position past the end keeps both halves of the names apart.
    one, two, rest = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    names, count = _names(t[sample], t[sample + 1], t[sample + 2])
    if count < len(sample) and reach * 3 < depth:
        names = suffix_ranks(names, depth, reach * 3)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    # Merge: a remaining suffix meets those at 1 (mod 3) by (number, rank) and those at 2 by (two numbers, rank).
    top = int(rank.max()) + 1
    letters = int(t.max()) + 1
    by_one = lambda i: t[i] * top + rank[i + 1]
    pairs = t[:-1] * letters + t[1:]
    if letters * letters * top >= 1 << 62:
        # Pairs by rank, so that a key stays below 64 bits.
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    by_two = lambda i: pairs[i] * top + rank[i + 2]
    k_rest = by_one(rest)
    own = np.argsort(k_rest, kind="stable")
    s_one, s_two = np.sort(by_one(one[one < n])), np.sort(by_two(two))
    place = np.empty(n, np.int64)
    sorted_rest = rest[own]
    place[sorted_rest] = np.arange(len(rest)) + np.searchsorted(s_one, k_rest[own]) + np.searchsorted(s_two, by_two(sorted_rest))
    order12 = _order(names, top - 1)
    p12 = sample[order12]
    p12 = p12[p12 < n]
    before = np.empty(len(p12), np.int64)
    first = p12 % 3 == 1
    before[first] = np.searchsorted(k_rest[own], by_one(p12[first]), side="right")
    before[~first] = np.searchsorted(by_two(sorted_rest), by_two(p12[~first]), side="right")
    place[p12] = np.arange(len(p12)) + before
    return place + 1


def later_windows(texts: list[bytes], counts: np.ndarray, ids: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of the strings of ``length`` bytes that also start earlier, by id and start.

    Text t holds the strings at its offsets below ``counts[t]``. All texts make one suffix array; equal
    strings are neighbours in it, found by comparing each with the one before.
    """
    pad = bytes(length)
    data = np.frombuffer(b"\0".join([*texts, pad]), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])[:-1]]).astype(np.int64)
    ranks = suffix_ranks(data.astype(np.int64) + 1, length)
    owner = np.repeat(np.arange(len(texts)), counts)
    offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    place = at[owner] + offset
    order = _order(ranks[place], int(ranks.max(initial=0)))
    owner, offset, place = owner[order], offset[order], place[order]
    same = np.ones(max(0, len(place) - 1), bool)
    # Eight letters at a time; the last eight may overlap those before.
    wide = min(8, length)
    words = np.lib.stride_tricks.sliding_window_view(data, wide)
    letters = np.zeros((len(words), 8), np.uint8)
    letters[:, :wide] = words
    letters = letters.view(np.uint64).ravel()
    for k in sorted({*range(0, length - wide + 1, wide), length - wide}):
        some = letters[place + k]
        same &= some[1:] == some[:-1]
    # Only strings with an equal neighbour are sorted by where they stand.
    run = np.concatenate([[0], np.cumsum(~same)]) if len(place) else np.zeros(0, np.int64)
    shared = np.r_[False, same] | np.r_[same, False] if len(place) else np.zeros(0, bool)
    owner, offset, run = owner[shared], offset[shared], run[shared]
    sort = np.lexsort((starts[owner] + offset, ids[owner], run))
    later = np.concatenate([[False], np.diff(run[sort]) == 0]) if len(run) else np.zeros(0, bool)
    return owner[sort][later], offset[sort][later]


# ---------------------------------------------------------------- groups of strings


def _rolling(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every stretch of ``length`` bytes."""
    current, factor, size, out, done = data.astype(np.uint64) + np.uint64(1), _FACTOR, 1, None, 0
    while True:
        if length & 1:
            if out is None:
                out, done = current, size
            else:
                m = len(out) - size
                out = out[:m] * factor + current[done : done + m]
                done += size
        length >>= 1
        if not length:
            break
        m = len(current) - size
        current = current[:m] * factor + current[size : size + m]
        with np.errstate(over="ignore"):
            factor, size = factor * factor, 2 * size
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value (the first of equals) in each stretch of ``width`` values."""
    n = len(values) - width + 1
    key = (values & ~_LOW24) | np.arange(len(values), dtype=np.uint64)
    rows = np.concatenate([key, np.full(-len(key) % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _LOW24).astype(np.int64)


def units(pieces: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """(group, digest, id, start, count) of the units of some texts, given as (id, offset, bytes).

    A unit is a run of neighbouring strings of ``length`` bytes with one least piece, which names the group;
    its digest is that of all bytes the strings have. Equal strings have equal least pieces, wherever they
    stand, so they are in units of one group.
    """
    data = b"".join([p[2] for p in pieces])
    sizes = np.array([len(p[2]) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    array = np.frombuffer(data, np.uint8)
    piece = min(PIECE, length)
    hashes = _rolling(array, piece)
    least = _least(hashes, length - piece + 1)
    cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1, ends - sizes, np.maximum(ends - length + 1, ends - sizes), [len(least)]]))
    cuts = cuts[cuts <= len(least)]
    start, stop = cuts[:-1], cuts[1:]
    owner = np.searchsorted(ends, start, side="right")
    whole = start <= ends[owner] - length
    start, stop, owner = start[whole], stop[whole], owner[whole]
    digest = xxhash.xxh3_64_intdigest
    tail = length - 1
    digests = np.array([digest(data[a : b + tail]) for a, b in zip(start.tolist(), stop.tolist())], np.uint64)
    ids = np.array([p[0] for p in pieces], np.int64)[owner]
    offsets = np.array([p[1] for p in pieces], np.int64)[owner] + start - (ends - sizes)[owner]
    return hashes[least[start]], digests, ids, offsets, stop - start


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """The texts of ``id, text`` in steps of bounded size; a long text in pieces that overlap by a string."""
    step, size = [], 0
    for batch in batches:
        for doc, column in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = column.as_py()
            if doc is None or text is None or len(text) < length:
                continue
            for at in range(0, len(text) - length + 1, HASH_BYTES):
                part = text[at : at + HASH_BYTES + length - 1]
                if step and size + len(part) > HASH_BYTES:
                    yield step
                    step, size = [], 0
                step.append((doc, at, part))
                size += len(part)
    if step:
        yield step


_UNITS = "bucket int, groups binary, digests binary, ids binary, starts binary, counts binary"


def _deal(batches: Iterator[pa.RecordBatch], buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    """The units of each step, packed by bucket of their group; of equal units of a step the rest go to bucket -1."""

    def found() -> Iterator[tuple[np.ndarray, ...]]:
        held, size = [], 0
        for step in _pieces(batches, length):
            held.append(units(step, length))
            size += sum(len(p[2]) for p in step)
            if size >= STEP_BYTES:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            yield tuple(map(np.concatenate, zip(*held)))

    for group, digest, ids, start, count in found():
        bucket = ((group >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        small = (group & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.lexsort((start, ids, digest, small, bucket))
        bucket, small, digest, ids, start, count = (x[order] for x in (bucket, small, digest, ids, start, count))
        again = np.zeros(len(order), bool)
        again[1:] = (bucket[1:] == bucket[:-1]) & (small[1:] == small[:-1]) & (digest[1:] == digest[:-1])
        bucket[again] = -1
        order = np.argsort(bucket, kind="stable")
        bucket, small, digest, ids, start, count = (x[order] for x in (bucket, small, digest, ids, start, count))
        present, first = np.unique(bucket, return_index=True)
        bounds = [*first.tolist(), len(bucket)]
        columns = [
            [x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            for x in (small, digest, ids, start, count.astype(np.uint8))
        ]
        # Steps number the pieces that are removed already, so that they do not meet in one place.
        key = np.where(present < 0, -1 - int(digest[0] % np.uint64(buckets)), present).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c, pa.binary()) for c in columns)], _UNITS.replace(" int", "").replace(" binary", "").split(", "))


_RANGES = "id long, start long, count long, kind int, part long"
#: Kinds of ranges: their strings start earlier elsewhere; to be compared; to be dealt further and compared.
REMOVED, COMPARE, DEAL = 0, 1, 2


def _settle(frame: pd.DataFrame, group_units: int) -> pd.DataFrame:
    """Of one bucket's units: which are later copies, and which differ from others of their group."""
    bucket = int(frame.bucket.iloc[0])
    small, digest, ids, start, count = (
        np.frombuffer(b"".join(bytes(x) for x in frame[c]), t)
        for c, t in (("groups", np.uint32), ("digests", np.uint64), ("ids", np.int64), ("starts", np.int64), ("counts", np.uint8))
    )
    if bucket < 0:
        kind, part = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64)
    else:
        order = np.lexsort((start, ids, digest, small))
        small, digest, ids, start, count = (x[order] for x in (small, digest, ids, start, count))
        new_group = np.r_[True, small[1:] != small[:-1]]
        first = new_group | np.r_[True, digest[1:] != digest[:-1]]
        number = np.cumsum(new_group) - 1
        distinct = np.bincount(number, weights=first)[number]
        kind = np.where(~first, REMOVED, np.where(distinct > group_units, DEAL, COMPARE)).astype(np.int32)
        keep = ~first | (distinct > 1)
        part = (np.int64(bucket) << 32 | small.astype(np.int64))[keep]
        ids, start, count, kind = ids[keep], start[keep], count[keep], kind[keep]
    return pd.DataFrame({"id": ids, "start": start, "count": count.astype(np.int64), "kind": kind, "part": part})


_TEXTS = "part long, id long, start long, count long, text binary"


def _cut(batches: Iterator[pa.RecordBatch], length: int, step_strings: int = STEP_STRINGS) -> Iterator[pa.RecordBatch]:
    """The bytes of the ranges of each text; strings of crowded groups one by one, under a part of their own.

    Of equal strings of a step only the earliest is sent with its bytes, the others as ranges without any.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    tail = length - 1
    first: dict[bytes, tuple[int, int, int]] = {}
    later: list[tuple[int, int]] = []
    for batch in (b.slice(i, 100) for b in batches for i in range(0, b.num_rows, 100)):
        rows: list[tuple] = []
        size = 0
        for doc, packed, ranges in zip(*(c.to_pylist() for c in batch.columns)):
            text = unpack(packed)
            for r in ranges:
                a, n = r["start"], r["count"]
                if r["kind"] == COMPARE:
                    rows.append((r["part"], doc, a, n, text[a : a + n + tail]))
                    size += n + tail
                    continue
                # Rows that share an id have each other's ranges, which may reach beyond a text.
                for i in range(a, min(a + n, len(text) - tail)):
                    window = text[i : i + length]
                    old = first.get(window)
                    if old is None:
                        first[window] = (doc, i, r["part"])
                    elif old[:2] <= (doc, i):
                        later.append((doc, i))
                    else:
                        first[window] = (doc, i, r["part"])
                        later.append(old[:2])
                if len(first) + len(later) >= step_strings:
                    yield _packed(_strings(first, later))
                    first, later = {}, []
            if size > STEP_BYTES:
                yield _packed(rows)
                rows, size = [], 0
        if rows:
            yield _packed(rows)
    if first:
        yield _packed(_strings(first, later))


def _strings(first: dict[bytes, tuple[int, int, int]], later: list[tuple[int, int]]) -> list[tuple]:
    """Rows of the earliest strings, and of the others as ranges that any array may pass on."""
    rows = []
    for window, (doc, at, group) in first.items():
        part = xxhash.xxh3_64_intdigest(window[:16] + window[-16:], seed=group & 0xFFFFFFFF) >> 1
        rows.append((part, doc, at, 1, window))
    runs: list[list[int]] = []
    for doc, at in sorted(later):
        if runs and runs[-1][0] == doc and runs[-1][1] + runs[-1][2] == at:
            runs[-1][2] += 1
        else:
            runs.append([doc, at, 1])
    return rows + [(xxhash.xxh3_64_intdigest(b"%d %d" % (doc, at)) >> 1, doc, at, n, None) for doc, at, n in runs]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["part", "id", "start", "count", "text"])


def _compare(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    """The strings of one bucket's texts that start earlier, as ranges. Equal texts reach the suffix array once."""
    texts = frame.text.tolist()
    ids, starts, counts = (frame[c].to_numpy(np.int64) for c in ("id", "start", "count"))
    seen: set[bytes] = set()
    own, later = [], []
    for i in np.lexsort((starts, ids)).tolist():
        text = texts[i]
        # A text without bytes is known to stand earlier.
        if text is None or text in seen:
            later.append(i)
            continue
        own.append(i)
        if len(text) == counts[i] + length - 1:
            seen.add(text)
    known = pd.DataFrame({"id": ids[later], "start": starts[later], "count": counts[later]}).astype("int64")
    texts = [bytes(texts[i]) for i in own]
    ids, starts, counts = ids[own], starts[own], counts[own]
    if len(texts) < 2 and counts.sum() < 2:
        return known
    owner, offset = later_windows(texts, counts, ids, starts, length)
    order = np.lexsort((offset, owner))
    owner, offset = owner[order], offset[order]
    if not len(owner):
        return known
    new = np.r_[True, (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)]
    head = np.flatnonzero(new)
    found = {"id": ids[owner[head]], "start": starts[owner[head]] + offset[head], "count": np.diff(np.r_[head, len(owner)])}
    return pd.concat([known, pd.DataFrame(found)])


def packed_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, packed``: texts compressed for the shuffle; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([pack(x or b"") for x in batch.column(1).to_pylist()], pa.binary())], ["id", "packed"]
            )

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return slim.mapInArrow(run, "id long, packed binary")


def later_strings(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group_units: int = GROUP_UNITS
) -> DataFrame:
    """``id, start, count``: ranges of offsets (UTF-8 bytes) where a string of ``length`` bytes starts again.

    1. Every string of ``length`` bytes belongs to the group of its least 32-byte piece (by hash), so equal
       strings are in one group wherever they stand. Neighbouring strings of a group are one unit. Units are
       counted per group: a unit that equals an earlier one is a later copy, a group of one unit repeats
       nothing. This sends some 20 bytes for each 35 of text, equal units of a step only once.
    2. What is left are groups of different units: the edges of copies. Their texts are gathered by group in
       buckets of about ``ARRAY_BYTES``; each gets a suffix array by the difference-cover algorithm, and
       neighbours that agree in ``length`` bytes are equal strings, of which the earliest stays.

    A group of more than ``group_units`` different units is dealt further by the first and last bytes of its
    strings. Of equal strings of these each step of a task sends one, and an array holds it once, so a bucket
    grows with the number of steps and not with the copies. What is not bounded: the units of one group,
    some 29 bytes each, are settled in one task, and strings that differ but share both ends are one part.
    Both steps are exact but for digests of 64 bits within a group.
    """
    spark = df.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    dealt = slim.mapInArrow(lambda batches: _deal(batches, buckets, length), _UNITS)
    settled = written(dealt.groupBy("bucket").applyInPandas(lambda frame: _settle(frame, group_units), _RANGES))
    open_ = settled.where(F.col("kind") != REMOVED)
    sums = open_.agg(F.sum(F.when(F.col("kind") == COMPARE, F.col("count") + length).otherwise(F.col("count") * length))).first()
    arrays = max(1, math.ceil((sums[0] or 0) / ARRAY_BYTES))
    asked = open_.groupBy("id").agg(F.collect_list(F.struct("start", "count", "kind", "part")).alias("ranges"))
    texts = packed_texts(df, id_col, text_col).join(asked, "id").select("id", "packed", "ranges")
    cut = texts.mapInArrow(lambda batches: _cut(batches, length), _TEXTS)
    placed = cut.withColumn("array", F.pmod(F.xxhash64("part"), F.lit(arrays)))
    compared = placed.groupBy("array").applyInPandas(lambda frame: _compare(frame, length), "id long, start long, count long")
    return settled.where(F.col("kind") == REMOVED).select("id", "start", "count").unionByName(written(compared))


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group_units: int = GROUP_UNITS
) -> DataFrame:
    """``id, n_bytes, spans, kept``: for each row its size, the removed byte spans and the bytes that stay.

    A byte is removed if a string of ``length`` bytes over it also starts earlier: in a document of a smaller
    id, or at a smaller offset of the same one. Strings are judged on the input and never cross documents;
    spans are maximal. A null text is empty, a shorter text loses nothing, and a row with a null id neither
    loses bytes nor counts as an earlier place. Rows that share an id count as one document: their offsets
    lie over each other and each loses the spans of all. An empty table gives no row.
    """
    found = later_strings(df, id_col, text_col, length, group_units)
    spans = found.groupBy("id").agg(F.collect_list(F.struct("start", "count")).alias("ranges"))
    joined = packed_texts(df, id_col, text_col).join(spans, "id", "left").select("id", "packed", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                sizes, out, kept = [], [], []
                for packed, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    text = unpack(packed)
                    merged: list[list[int]] = []
                    for a, b in sorted((r["start"], r["start"] + r["count"] + length - 1) for r in ranges or ()):
                        b = min(b, len(text))
                        if a < b and merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        elif a < b:
                            merged.append([a, b])
                    sizes.append(len(text))
                    out.append([{"start": a, "end": b} for a, b in merged])
                    edges = [0, *(x for span in merged for x in span), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(out, kind), pa.array(kept, pa.binary())],
                    ["id", "n_bytes", "spans", "kept"],
                )

    return joined.mapInArrow(run, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")

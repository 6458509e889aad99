"""Removal of repeated lines and passages by global digests of their units.

A line is cut into units at borders that only its own words decide, so a passage that stands in several texts
is cut alike in all of them, wherever it begins. Digests of normalised units are grouped globally, the earliest
one stays, and later ones go where whole lines or long enough stretches of them repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from telemill.llm.common import free, keyed, steps, utf8, written

#: Words of a unit, on average.
UNIT_WORDS = 8
#: UTF-8 bytes that a repeated line, and a stretch of repeated units, must have to go.
LEAST_LINE, LEAST_STRETCH = 30, 60
#: Digests are hot if more than one in so many units has them: there are fewer hot ones than that.
HOT_SHARE = 4096
#: Bytes of text that are cut at a time; a longer text is cut alone.
STEP_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A unit ends after these marks, as scripts that use them write no blanks.
MARKS = "。！？"
_MARKS = [tuple(m.encode()) for m in MARKS]


def _mark_ends(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes that end a mark, bytes that begin one)."""
    ends, begins = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if len(data) > 2:
        for a, b, c in _MARKS:
            found = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
            ends[2:] |= found
            begins[:-2] |= found
    return ends, begins


@dataclass
class Units:
    """The units of some texts joined by line breaks: byte offsets, digests and lengths.

    Unit i covers the bytes ``start[i]`` to ``stop[i]``; the units of a line cover it all. ``size`` is the length
    of the normalised unit, ``line`` its line, ``half`` and ``other`` the halves of its digest of 128 bits.
    """

    line: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    size: np.ndarray
    half: np.ndarray
    other: np.ndarray

    def owners(self, texts: list[bytes]) -> np.ndarray:
        """The text of each unit."""
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        return np.searchsorted(starts, self.start, side="right") - 1


def cut(text: bytes, unit_words: int = UNIT_WORDS) -> Units:
    """The units of a text, or of several joined by line breaks, as no unit goes beyond its line.

    Words are runs without ASCII white space; one also ends after marks. A unit ends with its line, after a
    mark, and after a word whose length, with those of the words beside it in the line, adds up to a multiple
    of ``unit_words`` (3 times the one before, 5 times its own, 7 times the one after, in bytes). Compared are
    the words joined by single blanks, A-Z in lower case. A line of no words has no unit.
    """
    data = np.frombuffer(text, np.uint8)
    none = np.zeros(0, np.int64)
    word = ~_SPACE[data]
    if not word.any():
        return Units(none, none, none, none, none, none)
    ends_mark, begins_mark = _mark_ends(data)
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    # A mark ends a word unless another mark follows.
    last = word & (~after | (ends_mark & ~np.concatenate([begins_mark[1:], [False]])))
    first = word & (~before | np.concatenate([[False], last[:-1]]))
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    breaks = np.flatnonzero(data == 0x0A)
    line = np.searchsorted(breaks, starts)
    size = stops - starts
    same = line[1:] == line[:-1]
    left = np.concatenate([[0], np.where(same, size[:-1], 0)])
    right = np.concatenate([np.where(same, size[1:], 0), [0]])
    border = (3 * left + 5 * size + 7 * right) % unit_words == 0
    border |= np.concatenate([~same, [True]]) | ends_mark[stops - 1]
    ends = np.flatnonzero(border)
    begins = np.concatenate([[0], ends[:-1] + 1])
    # The normalised text: words, and one blank for the white space after each.
    kept = word | (~word & before)
    place = np.concatenate([[0], np.cumsum(kept, dtype=np.int32)])
    plain = np.where(word, _LOWER[data], 0x20)[kept].astype(np.uint8).tobytes()
    a, z = place[starts[begins]], place[stops[ends]]
    digest = xxhash.xxh3_128_digest
    digests = b"".join([digest(plain[i:j]) for i, j in zip(a.tolist(), z.tolist())])
    half, other = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2).T
    # Units cover their line: from its start, to the next unit or its end.
    unit_line = line[begins]
    fresh = np.concatenate([[True], unit_line[1:] != unit_line[:-1]])
    line_starts = np.concatenate([[0], breaks + 1])
    line_stops = np.concatenate([breaks, [len(data)]])
    start = np.where(fresh, line_starts[unit_line], starts[begins])
    stop = np.where(np.concatenate([fresh[1:], [True]]), line_stops[unit_line], np.concatenate([start[1:], [0]]))
    return Units(unit_line, start, stop, (z - a).astype(np.int64), half, other)


def first_in_text(units: Units, owner: np.ndarray) -> np.ndarray:
    """Which units have no equal one before them in their text."""
    order = np.lexsort((units.other, units.half, owner))
    same = np.ones(max(0, len(order) - 1), bool)
    for key in (owner, units.half, units.other):
        same &= key[order][1:] == key[order][:-1]
    first = np.ones(len(order), bool)
    # The sort is stable, so of equal ones the first stands first.
    first[order[1:]] = ~same
    return first


def gone(units: Units, owner: np.ndarray, repeated: np.ndarray, least_line: int, least_stretch: int) -> np.ndarray:
    """Which units go, of those that stand earlier.

    All of a line's units, if each is repeated and the line has ``least_line`` bytes; all units of a stretch of
    repeated ones, across the lines of a text, that has ``least_stretch`` bytes. Lengths are those of the normalised
    text.
    """
    if not repeated.any():
        return repeated
    length = units.size + 1
    _, of_line = np.unique(units.line, return_inverse=True)
    whole = np.bincount(of_line, ~repeated) == 0
    whole &= np.bincount(of_line, length) - 1 >= least_line
    breaks = (repeated[1:] != repeated[:-1]) | (owner[1:] != owner[:-1])
    stretch = np.cumsum(np.concatenate([[True], breaks])) - 1
    long = np.bincount(stretch, length) - 1 >= least_stretch
    return repeated & (whole[of_line] | long[stretch])


def unit_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_words: int = UNIT_WORDS) -> DataFrame:
    """``id, h1, h2``: the digests, of 128 bits, of the different units of each row with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1, STEP_BYTES):
            texts = utf8(batch.column(1))
            units = cut(b"\n".join(texts), unit_words)
            owner = units.owners(texts)
            own = first_in_text(units, owner)
            ids = batch.column(0).to_numpy()[owner[own]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, units.half[own], units.other[own])], ["id", "h1", "h2"])

    return keyed(df, id_col, text_col).where("id IS NOT NULL").mapInArrow(run, "id long, h1 long, h2 long")


def repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_words: int = UNIT_WORDS, hot_share: int = HOT_SHARE
) -> DataFrame:
    """``id, found``: for each document the digests (their first halves) of its units that stand in one of a smaller id.

    A digest's group is never gathered: its smallest id is an aggregate with partial results, joined back to the
    slim unit rows. Digests that more than one in ``hot_share`` of these rows have, fewer than ``hot_share`` then,
    are broadcast, so that no task gets all rows of one; the others are joined by shuffle. The list of a document is
    bounded by its own units.
    """
    every = written(unit_digests(df, id_col, text_col, unit_words))
    first = every.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    first = written(first.where("first < last").drop("last"))
    bound = every.count() // hot_share
    hot = first.where(F.col("n") > bound).select("h1", "h2", F.col("first").alias("hot"))
    marked = every.join(F.broadcast(hot), ["h1", "h2"], "left")
    cold = marked.where("hot IS NULL").drop("hot").join(first.where(F.col("n") <= bound), ["h1", "h2"])
    later = marked.where("id > hot").select("id", "h1").unionByName(cold.where("id > first").select("id", "h1"))
    return later.groupBy("id").agg(F.collect_list("h1").alias("found"))


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "removed", unit_words: int = UNIT_WORDS,
    least_line: int = LEAST_LINE, least_stretch: int = LEAST_STRETCH,
) -> DataFrame:
    """The rows of ``df`` with repeated lines and passages cut out of the text, and their places in ``removed_col``.

    A unit (see :func:`cut`) is repeated if an equal one stands in a document of a smaller id or earlier in the same
    text; see :func:`gone` for those that go. Units that stay keep their order and wording, white space included;
    a line that loses all its units goes with its line break. ``removed_col`` holds (line, start, end) of each cut
    stretch of a line, in code points of the original text, in order; null where nothing is cut. If ``df`` has a column
    of that name, underscores are added to it.

    Blank lines, null texts and rows with a null id stay as they are. Rows that share an id are one document: what
    stands in a smaller id goes from each, and each is compared with itself. An empty table stays empty. Texts are
    shuffled once, to meet their digests.
    """
    key, found, removed_col = (free(df, name) for name in ("key", "found", removed_col))
    lists = repeats(df, id_col, text_col, unit_words).withColumnsRenamed({"id": key, "found": found})
    joined = df.join(lists, F.col(f"`{id_col}`").cast("long") == F.col(key), "left").drop(key)
    columns, place, number = df.columns, df.columns.index(text_col), df.columns.index(id_col)
    ordered = joined.select(*(F.col(f"`{c}`") for c in [*columns, found]))
    kind = pa.list_(pa.struct([("line", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def left(data: bytes, lines: np.ndarray, starts: np.ndarray, stops: np.ndarray, out: np.ndarray) -> tuple[str, list[dict]]:
        """A text without its units ``out``, and what was cut."""
        kept = np.ones(len(data) + 1, bool)
        _, of_line = np.unique(lines, return_inverse=True)
        empty = (np.bincount(of_line, ~out) == 0)[of_line]
        # Code points before each byte.
        points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        places: list[dict] = []
        for i in np.flatnonzero(out).tolist():
            start, stop, number = int(starts[i]), int(stops[i]), int(lines[i])
            kept[start:stop] = False
            if empty[i]:
                kept[stop] = False
            if places and places[-1]["line"] == number and places[-1]["end"] == points[start]:
                places[-1]["end"] = int(points[stop])
            else:
                places.append({"line": number, "start": int(points[start]), "end": int(points[stop])})
        rest = np.frombuffer(data, np.uint8)[kept[:-1]].tobytes()
        # The last line has no break of its own: if it goes, so does the one before.
        if not kept[-1] and rest.endswith(b"\n"):
            rest = rest[:-1]
        return rest.decode("utf-8"), places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, place, STEP_BYTES):
            texts = utf8(batch.column(place))
            units = cut(b"\n".join(texts), unit_words)
            owner = units.owners(texts)
            repeated = ~first_in_text(units, owner)
            lists = batch.column(len(columns)).to_pylist()
            ends = np.searchsorted(owner, np.arange(len(texts) + 1))
            for i, known in enumerate(lists):
                if known:
                    own = slice(ends[i], ends[i + 1])
                    repeated[own] |= np.isin(units.half[own], np.array(known, np.int64))
            # Rows without an id or a text stay as they are.
            alone = ~np.array(batch.column(number).is_valid()) | ~np.array(batch.column(place).is_valid())
            repeated &= ~alone[owner]
            out = gone(units, owner, repeated, least_line, least_stretch)
            arrays, places = list(batch.columns)[: len(columns)], [None] * len(texts)
            if out.any():
                new = batch.column(place).to_pylist()
                before = np.cumsum([0] + [len(t) + 1 for t in texts])
                breaks = np.cumsum([0] + [t.count(b"\n") + 1 for t in texts])
                for i in np.unique(owner[out]).tolist():
                    own = slice(ends[i], ends[i + 1])
                    new[i], places[i] = left(
                        texts[i], units.line[own] - breaks[i], units.start[own] - before[i], units.stop[own] - before[i], out[own]
                    )
                arrays[place] = pa.array(new, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(places, kind)], names=[*columns, removed_col])

    place_type = StructType([StructField("line", IntegerType()), StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([*df.schema.fields, StructField(removed_col, ArrayType(place_type))])
    return ordered.mapInArrow(run, schema)


#: The same rows in SQL.
LINE_REPEATS_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - len(line) - 1 AS pos
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
),
w AS (
  SELECT doc_id, i, pos, k, word, sum(len(word)) OVER t - len(word) AS o,
    trim(word, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM (
    SELECT doc_id, i, pos, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM (
      SELECT doc_id, i, pos, regexp_extract_all(line,
        '[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D。！？]*[。！？]+|[^\x20\x09-\x0D。！？]+)[\x20\x09-\x0D]*') AS ws FROM l))
  WINDOW t AS (PARTITION BY doc_id, i ORDER BY k)
),
b AS (
  SELECT *, lead(k) OVER t IS NULL OR right(bare, 1) IN ('。', '！', '？')
    OR (3 * coalesce(lag(strlen(bare)) OVER t, 0) + 5 * strlen(bare) + 7 * coalesce(lead(strlen(bare)) OVER t, 0)) % 8 = 0 AS border
  FROM w WINDOW t AS (PARTITION BY doc_id, i ORDER BY k)
),
n AS (
  SELECT *, sum(border::INT) OVER (PARTITION BY doc_id, i ORDER BY k) - border::INT AS unit FROM b
),
u AS (
  SELECT doc_id, i, unit, any_value(pos) + min(o) AS start, sum(len(word)) AS n, string_agg(word, '' ORDER BY k) AS body,
    translate(string_agg(bare, ' ' ORDER BY k), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS plain
  FROM n GROUP BY doc_id, i, unit
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY plain ORDER BY doc_id, i, unit) > 1 AS again,
    row_number() OVER (PARTITION BY doc_id ORDER BY i, unit) AS k FROM u
),
s AS (
  SELECT *, bool_and(again) OVER (PARTITION BY doc_id, i) AND sum(strlen(plain) + 1) OVER (PARTITION BY doc_id, i) - 1 >= 30 AS whole,
    k - row_number() OVER (PARTITION BY doc_id, again ORDER BY k) AS stretch FROM r
),
g AS (
  SELECT *, again AND (whole OR sum(strlen(plain) + 1) OVER (PARTITION BY doc_id, again, stretch) - 1 >= 60) AS gone FROM s
),
c AS (
  SELECT *, k - row_number() OVER (PARTITION BY doc_id, i, gone ORDER BY k) AS run FROM g
),
p AS (
  SELECT doc_id, i, min(start) AS a, sum(n) AS n FROM c WHERE gone GROUP BY doc_id, i, run
),
x AS (
  SELECT doc_id, count(*) AS n_removed, sum(n) AS removed_chars,
    string_agg(CAST(a AS BIGINT) || '-' || CAST(a + n AS BIGINT), ',' ORDER BY a) AS spans FROM p GROUP BY doc_id
),
k AS (
  SELECT l.doc_id, l.i, CASE WHEN count(c.doc_id) = 0 THEN any_value(l.line) ELSE string_agg(body, '' ORDER BY unit) FILTER (NOT gone) END AS line
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id, l.i
),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM k GROUP BY doc_id)
SELECT d.doc_id, len(coalesce(t.text, '')) AS n_chars, len(coalesce(d.text, '')) AS n_chars_in, coalesce(n_removed, 0) AS n_removed,
  CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars, coalesce(spans, '') AS spans, sha256(coalesce(t.text, '')) AS kept_sha256
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN x ON d.doc_id = x.doc_id
"""

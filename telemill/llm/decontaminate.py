"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import keyed, saved, steps, utf8

#: Words of one automaton at most. Larger benchmarks are cut into several automata, used one after another.
AUTOMATON_WORDS = 400_000
#: Words of a window: shorter common stretches are no contamination.
WINDOW = 10

# Lower case for A-Z; every byte that belongs to no word becomes a space. Words are digits, letters and
# everything beyond ASCII.
_WORD = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_TO_WORDS = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20) for b in range(256))
_WORD_AT = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """The normalised words of a UTF-8 text."""
    return text.translate(_TO_WORDS).split()


class Automaton:
    """The smallest automaton of all substrings of several word sequences, and what their windows name.

    ``step`` follows the longest suffix of the words read so far that is a substring of an item. For each
    state two things are known beforehand: the items that hold the window which ends there, and the items
    shorter than a window that end there as a whole.
    """

    def __init__(self, items: Iterable[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [
            (item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words
        ]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.shortest = min((min(len(ids), window) for _, ids in coded), default=window)
        # Stretches of so many words are looked up as a whole before the automaton is asked.
        self.gram = min(3, self.shortest)
        codes = {self._code(ids[i : i + self.gram]) for _, ids in coded for i in range(len(ids) - self.gram + 1)}
        self.codes = np.array(sorted(codes), np.int64)
        self.whole: dict[int, set[int]] = {}
        ends: dict[int, set[tuple[int, int]]] = {}
        for item, ids in coded:
            state = 0
            for i, c in enumerate(ids):
                state = self.go[state][c]
                if i >= window - 1:
                    self.whole.setdefault(self.at(state, window), set()).add(item)
            if len(ids) < window:
                ends.setdefault(self.at(state, len(ids)), set()).add((len(ids), item))
        # Short items of a state are its own and those of all states its suffixes are in.
        self.short: dict[int, list[tuple[int, int]]] = {}
        for state in sorted(range(1, len(self.go)), key=self.length.__getitem__):
            found = [*self.short.get(self.link[state], ()), *ends.get(state, ())]
            if found:
                self.short[state] = found

    def packed(self) -> bytes:
        """The automaton as bytes."""
        return pickle.dumps(vars(self))

    @classmethod
    def unpacked(cls, data: bytes) -> Automaton:
        """The automaton of :meth:`packed`."""
        made = cls.__new__(cls)
        vars(made).update(pickle.loads(data))
        return made

    def _code(self, ids: list[int]) -> int:
        code = 0
        for c in ids:
            code = code << 20 | c
        return code

    def _extend(self, last: int, c: int) -> int:
        go, link, length = self.go, self.link, self.length
        if c in go[last]:
            q = go[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        state = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = state
            p = link[p]
        if p >= 0:
            q = go[p][c]
            link[state] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return state

    def _clone(self, p: int, c: int, q: int) -> int:
        go, link, length = self.go, self.link, self.length
        copy = len(go)
        go.append(dict(go[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and go[p].get(c) == q:
            go[p][c] = copy
            p = link[p]
        return copy

    def at(self, state: int, length: int) -> int:
        """The state of the suffix of ``length`` words of a state's strings."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of the word ids (-1: in no item) outside of which no window and no short item can lie."""
        n = len(ids) - self.gram + 1
        if n <= 0 or not len(self.codes):
            return []
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(self.gram):
            part = ids[k : k + n]
            code = code << 20 | part
            known &= part >= 0
        place = np.flatnonzero(known)
        found = np.searchsorted(self.codes, code[place])
        found[found == len(self.codes)] = 0
        place = place[self.codes[found] == code[place]]
        if not len(place):
            return []
        cuts = np.flatnonzero(np.diff(place) > 1)
        starts = place[np.concatenate([[0], cuts + 1])]
        stops = place[np.concatenate([cuts, [len(place) - 1]])] + self.gram
        long = stops - starts >= self.shortest
        return list(zip(starts[long].tolist(), stops[long].tolist()))

    def match(self, ids: np.ndarray, start: int, stop: int) -> Iterator[tuple[int, int, Iterable[int]]]:
        """(first word, end, items) of every occurrence of a window or short item in a stretch."""
        state, matched = 0, 0
        go, link, length, window = self.go, self.link, self.length, self.window
        for i, c in enumerate(ids[start:stop].tolist(), start):
            while state and c not in go[state]:
                state = link[state]
                matched = length[state]
            if c in go[state]:
                state = go[state][c]
                matched += 1
            if matched >= window and (items := self.whole.get(self.at(state, window))):
                yield i + 1 - window, i + 1, items
            for size, item in self.short.get(state, ()):
                if size <= matched:
                    yield i + 1 - size, i + 1, (item,)


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> list[bytes]:
    """The items as pickled automata of at most about ``AUTOMATON_WORDS`` words each.

    Each is built in a task of its own; only its size decides how many there are. One text longer than the
    bound is cut into pieces that overlap by a window less one word, so no window is lost.
    """
    bound = AUTOMATON_WORDS

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for item, text in zip(frame.id, frame.text):
                words = words_of((text or "").encode())
                if words:
                    step = range(0, max(1, len(words) - window + 1), bound)
                    rows += [(item, b" ".join(words[i : i + bound + window - 1]), min(len(words), bound)) for i in step]
            yield pd.DataFrame(rows, columns=["id", "words", "size"])

    cut = keyed(items, id_col, text_col).where("id IS NOT NULL").mapInPandas(pieces, "id long, words binary, size long").distinct()
    cut = saved(cut)
    shards = max(1, math.ceil((cut.agg(F.sum("size")).first()[0] or 0) / bound))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(frame.id, frame.words))
        return pd.DataFrame({"automaton": [Automaton([(int(i), bytes(w).split()) for i, w in rows], window).packed()]})

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("id", "words"), F.lit(shards)))
    built = saved(dealt.groupBy("shard").applyInPandas(build, "automaton binary"))
    return [bytes(row.automaton) for row in built.toLocalIterator()]


_FOUND = "n_words long, hits array<struct<start:long,end:long>>, items array<long>"


def _scan(automaton, batches: Iterator[pa.RecordBatch], carry: bool) -> Iterator[pa.RecordBatch]:
    """Adds what one automaton finds to ``id, text, hits, items``; hits are word numbers [start, end)."""
    tool = Automaton.unpacked(automaton.value)
    get = tool.vocabulary.get
    for batch in steps(batches, 1):
        flat, bounds = [], [0]
        for text in utf8(batch.column(1)):
            flat += [get(w, -1) for w in words_of(text)]
            flat.append(-1)
            bounds.append(len(flat))
        ids = np.array(flat, np.int64)
        spans: dict[int, list[tuple[int, int]]] = {}
        named: dict[int, set[int]] = {}
        for start, stop in tool.candidates(ids):
            row = int(np.searchsorted(bounds, start, "right")) - 1
            first = bounds[row]
            for a, b, items in tool.match(ids, start, stop):
                spans.setdefault(row, []).append((a - first, b - first))
                named.setdefault(row, set()).update(items)
        hits, items = [], []
        for row, (old, known) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            new = spans.get(row)
            pairs = [(x["start"], x["end"]) for x in old] + (new or [])
            hits.append([{"start": a, "end": b} for a, b in merged(pairs)] if new else old)
            items.append(sorted({*known, *named[row]}) if new else known)
        counts = np.diff(bounds) - 1
        hit_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [pa.array(hits, hit_type), pa.array(items, pa.list_(pa.int64()))]
        if carry:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "text", "hits", "items"])
        else:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), *columns], ["id", "n_words", "hits", "items"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they overlap or touch, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """``id, n_words, hits, items`` for every row: maximal stretches of hit words and the items found.

    A hit word lies in an occurrence of ``window`` consecutive words of an item, or of a whole shorter item.
    Texts are streamed through the automaton: stretches whose every group of three words occurs in an item
    are followed word by word with the length of the longest match, all others cannot hold a window. No
    shuffle takes place. The automaton that is broadcast has at most ``AUTOMATON_WORDS`` words; a larger
    benchmark takes several passes, each kept in the shared folder. Null and wordless texts have no words;
    items with a null id or no word are left out; repeated rows give repeated rows.
    """
    context = df.sparkSession.sparkContext
    state = keyed(df, id_col, text_col).select(
        "id", "text", F.expr("cast(array() AS array<struct<start:long,end:long>>)").alias("hits"),
        F.expr("cast(array() AS array<long>)").alias("items"),
    )
    parts = automata(items, item_id, item_text, window)
    if not parts:
        parts = [Automaton([], window).packed()]
    for number, part in enumerate(parts):
        shared, carry = context.broadcast(part), number < len(parts) - 1
        schema = "id long, " + (_FOUND.replace("n_words long", "text string") if carry else _FOUND)
        state = state.mapInArrow(lambda batches, shared=shared, carry=carry: _scan(shared, batches, carry), schema)
        if carry:
            state = saved(state)
    return state


def contamination_digests(found: DataFrame) -> DataFrame:
    """``id, n_words, n_hit, n_items, items_sha256, contaminated`` of :func:`contamination`."""
    names = F.array_sort(F.col("items").cast("array<string>"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the given word spans: from the first byte of the first word to the last of the last."""
    data = text.encode()
    places = [m.span() for m in _WORD_AT.finditer(data)]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode()


def decontaminate(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, max_coverage: float = 0.8,
) -> DataFrame:
    """The rows of ``df`` with all contaminated spans cut out of the text; all columns stay.

    A span is removed when it reaches the length limit (``window`` words) or covers a whole shorter item.
    A row more than ``max_coverage`` of whose words are hit goes altogether. Clean rows, null texts and
    further columns are untouched. The text travels with its row, so nothing is joined or shuffled. With
    several automata the uncut text and the hits so far go from pass to pass; coverage is tested and spans
    are cut once, after the last, so the result does not depend on how the items are dealt.
    """
    context = df.sparkSession.sparkContext
    columns, name = df.columns, "_hits"
    while name in (c.lower() for c in columns):
        name += "_"
    place, last = columns.index(text_col), len(columns)
    parts = automata(items, item_id, item_text, window)
    if not parts:
        return df
    state = df.select("*", F.expr("cast(array() AS array<struct<start:long,end:long>>)").alias(name))
    for number, part in enumerate(parts):
        shared, carry = context.broadcast(part), number < len(parts) - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, carry=carry) -> Iterator[pa.RecordBatch]:
            nothing = pa.array([[]], pa.list_(pa.int64()))
            for batch in steps(batches, place):
                n = batch.num_rows
                # The row number stands in for the id, which may be null or repeated.
                asked = pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n)), batch.column(place), batch.column(last), nothing.take(pa.array(np.zeros(n, np.int64)))],
                    ["id", "text", "hits", "items"],
                )
                for found in _scan(shared, iter([asked]), False):
                    first = found.column(0)[0].as_py()
                    part = batch.slice(first, found.num_rows)
                    arrays = list(part.columns)
                    if carry:
                        arrays[last] = found.column(2).cast(part.schema.field(last).type)
                        yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)
                    else:
                        yield _without_hits(part, found, place, last, max_coverage)

        if number:
            state = saved(state)
        state = state.mapInArrow(run, state.schema if carry else df.schema)
    return state


def _without_hits(batch: pa.RecordBatch, found: pa.RecordBatch, place: int, last: int, max_coverage: float) -> pa.RecordBatch:
    """The first ``last`` columns of a batch with the hits cut out of the texts, less the rows that are mostly hits."""
    texts, keep = batch.column(place).to_pylist(), np.ones(batch.num_rows, bool)
    for row, (words, hits) in enumerate(zip(found.column(1).to_pylist(), found.column(2).to_pylist())):
        if hits:
            spans = [(x["start"], x["end"]) for x in hits]
            keep[row] = sum(b - a for a, b in spans) <= max_coverage * words
            texts[row] = cut_words(texts[row], spans)
    arrays = batch.columns[:last]
    arrays[place] = pa.array(texts, batch.schema.field(place).type)
    schema = pa.schema([batch.schema.field(i) for i in range(last)])
    return pa.RecordBatch.from_arrays(arrays, schema=schema).filter(pa.array(keep))

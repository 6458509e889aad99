"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telemill.llm.common import kept, keyed, steps

#: Distinct pieces a Python worker remembers; beyond it the memory is emptied and fills again.
REMEMBERED = 450_000

#: White space as Unicode defines it; Python's own split also takes the four separators below.
_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_EXTRA = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


#: Pair positions that one bottom node of the tree covers.
_BLOCK = 16
#: Above every pair's value.
_NONE = 1 << 50


def merge(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Merges symbols until no adjacent pair has a rank, always the leftmost pair of the lowest rank.

    ``pairs`` has ``rank << 24 | new symbol`` by ``left << 24 | right``. A segment tree holds that value and
    the pair's position for each pair; a bottom node covers ``_BLOCK`` positions, every other node its two
    children, and each knows its least entry, so the root is the next merge. A merge changes three entries,
    each with the way to the root: n symbols take O(n log n). A word of one block has one node.
    """
    n = len(ids)
    if n < 2:
        return ids
    get = pairs.get
    values = [get(a << 24 | b, _NONE) for a, b in zip(ids, ids[1:])]
    if n - 1 <= _BLOCK:
        return _merge_block(ids, values, get)
    depth = (n - 1).bit_length()
    low, limit = (1 << depth) - 1, _NONE << depth
    leaves = [v << depth | i for i, v in enumerate(values)]
    blocks = [min(leaves[k : k + _BLOCK]) for k in range(0, n - 1, _BLOCK)]
    size = 1 << (len(blocks) - 1).bit_length()
    tree = [limit] * size + blocks + [limit] * (size - len(blocks))
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    while (best := tree[1]) < limit:
        i = best & low
        j = after[i]
        new = ids[i] = best >> depth & 0xFFFFFF
        ids[j] = -1
        k = after[i] = after[j]
        changed = {i // _BLOCK}
        if k >= 0:
            before[k] = i
            leaves[j] = limit
            changed.add(j // _BLOCK)
            leaves[i] = get(new << 24 | ids[k], _NONE) << depth | i
        else:
            leaves[i] = limit
        h = before[i]
        if h >= 0:
            leaves[h] = get(ids[h] << 24 | new, _NONE) << depth | h
            changed.add(h // _BLOCK)
        for block in changed:
            node, value = size + block, min(leaves[block * _BLOCK : (block + 1) * _BLOCK])
            tree[node] = value
            while node > 1:
                value = min(value, tree[node ^ 1])
                node >>= 1
                if tree[node] == value:
                    break
                tree[node] = value
    return [x for x in ids if x >= 0]


def _merge_block(ids: list[int], values: list[int], get) -> list[int]:
    """The merges of a word whose tree is one bottom node: its entries close up instead of being marked."""
    while values and (best := min(values)) < _NONE:
        i = values.index(best)
        new = ids[i] = best & 0xFFFFFF
        del ids[i + 1], values[i]
        if i < len(values):
            values[i] = get(new << 24 | ids[i + 1], _NONE)
        if i:
            values[i - 1] = get(ids[i - 1] << 24 | new, _NONE)
    return ids


class _Memory(dict):
    """Results by key, made when first asked for, at most ``REMEMBERED`` at a time."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """One public tokenizer file: lower-case byte-level BPE with word ends.

    Encoding follows the file: special tokens are found in the raw text; the rest is NFC-normalised, white
    space is dropped, letters are lowered one by one, and the split pattern's matches become words of bytes,
    the last symbol of each with the word-end mark.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab = model["vocab"]
        end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.pairs = {}
        for rank, (a, b) in enumerate(model["merges"]):
            # Of a pair that is listed twice the later rank counts.
            self.pairs[vocab[a] << 24 | vocab[b]] = rank << 24 | vocab[a + b]
        letters = byte_letters()
        self.byte = {c: b for b, c in enumerate(letters)}
        self.library = Tokenizer.from_file(path)
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        (split,) = (p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_of = regex.compile(split).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.mark = "<|"
        self.assigned: set[str] = set()
        self.words = _Memory(self._word)
        self.pieces = _Memory(self._piece)

    def _word(self, word: str) -> bytes:
        """The ids of a word, four bytes each: as numbers, those of remembered words would be millions of objects."""
        data = word.encode()
        return array("i", merge([self.inner[b] for b in data[:-1]] + [self.last[data[-1]]], self.pairs)).tobytes()

    def _assigned(self, piece: str) -> bool:
        """Whether this Python's Unicode tables know all characters of a piece."""
        known = {c for c in piece if unicodedata.category(c) != "Cn"}
        self.assigned |= known
        return known.issuperset(piece)

    def _newer(self, piece: str) -> list[str]:
        """Words of a piece with characters this Python's Unicode tables do not know: as the library splits it."""
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return [bytes(map(self.byte.__getitem__, word)).decode() for word, _ in split]

    def _piece(self, piece: str) -> tuple[bytes, str]:
        if piece.isascii():
            words = self.words_of(piece.lower())
        elif self.assigned.issuperset(piece) or self._assigned(piece):
            # The capital sigma is lowered without looking at its neighbours.
            words = self.words_of(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())
        else:
            words = self._newer(piece)
        known = self.words
        ids = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])
        return ids, " ".join(map(self.token.__getitem__, array("i", ids)))

    def _split(self, text: str) -> list[str]:
        return _SPACE.split(text) if _EXTRA.search(text) else text.split()

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids, four bytes each, and the decoded text of one text."""
        if self.mark in text and len(parts := self.specials.split(text)) > 1:
            found = []
            for part in parts:
                if part in self.special:
                    found.append((array("i", [self.special[part]]).tobytes(), part))
                else:
                    found += [x for x in map(self.pieces.__getitem__, self._split(part)) if x[0]]
        else:
            found = [*map(self.pieces.__getitem__, filter(None, self._split(text)))]
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found])


def encoder(path: str) -> Encoder:
    """The encoder of a file, read once in a worker, and let go when the worker turns to other work."""
    return kept(("bpe", path), lambda: Encoder(path))


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids array<int>, decoded string`` for every row; a null text is empty, repeated rows stay.

    ``path`` is a tokenizer file every worker can read. ``decoded`` is what the ids stand for: the file
    names no decoder, so tokens are joined by spaces with their word-end marks. Rows are independent; nothing
    is shuffled. Memory is bounded by one slice of texts (or one longer text) and the remembered pieces. A
    word of n bytes takes O(n log n), so one very long word is no danger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in steps(batches, 1, work=("bpe", path)):
            found = [encode(t or "") for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(ids) // 4 for ids, _ in found], out=offsets[1:])
            ids = np.frombuffer(b"".join([ids for ids, _ in found]), np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, ids), pa.array([d for _, d in found], pa.string())],
                ["id", "ids", "decoded"],
            )

    return keyed(df, id_col, text_col).mapInArrow(run, "id long, ids array<int>, decoded string")


def encoded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256``: the digests of :func:`encode_decode`."""
    return encode_decode(df, path, id_col, text_col).select(
        "id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

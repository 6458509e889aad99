"""SimHash, suffix-array, line and embedding de-duplication against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from telemill.llm import components, embeddings, lines, simhash, suffixes

WORDS = "a of the and over into winter mountain letters yesterday nevertheless é 日本 x1 can't".split()
DOCS = "doc_id long, text string, id long, fp long, u string"


def texts(seed: int, count: int, alphabet: str = "ab cd\n") -> dict[int, str | None]:
    """Texts that share passages, some copied, some nearly."""
    rnd = random.Random(seed)
    shared = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(20, 200))) for _ in range(6)]
    out: dict[int, str | None] = {}
    for i in range(count):
        parts = [rnd.choice(shared) if rnd.random() < 0.6 else "".join(rnd.choice("xyzé w") for _ in range(40)) for _ in range(4)]
        out[i * 3] = "".join(parts)
    keys = list(out)
    for k in keys[::7]:
        out[k] = out[keys[1]]
    for k in keys[3::9]:
        text = list(out[keys[2]])
        text[rnd.randrange(len(text))] = "q"
        out[k] = "".join(text)
    out[1], out[2], out[4], out[5], out[7] = None, "", "ab", " \n ", "a" * 5000
    return out


def frame(spark, rows: dict[int, str | None]):
    """The rows with further columns that are named like the operators' own."""
    return spark.createDataFrame([(k, v, -1, -1, "x") for k, v in rows.items()], DOCS).repartition(5)


@pytest.mark.parametrize("seed, length, group_units", [(1, 20, 4096), (2, 40, 4096), (3, 40, 1)])
def test_substring_repeats(spark, seed, length, group_units):
    """Also with groups over the bound, which are dealt further."""
    rows = texts(seed, 60)
    found = suffixes.remove_repeats(frame(spark, rows), length=length, group_units=group_units)
    got = {
        r.id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), brute.sha(bytes(r.kept))) for r in found.collect()
    }
    assert got == brute.substring_repeats(rows, length)


def test_equal_strings_of_a_crowded_group_are_sent_and_sorted_once(monkeypatch):
    """A passage behind different text in many documents."""
    passage = bytes(range(60, 95))
    pack = suffixes.zstandard.ZstdCompressor().compress
    rows = [(doc, pack(b"%03d" % doc + passage), [{"start": 0, "count": 19, "kind": suffixes.DEAL, "part": 5}]) for doc in range(300)]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("count", pa.int64()), ("kind", pa.int32()), ("part", pa.int64())]))
    columns = [pa.array(c, t) for c, t in zip(zip(*reversed(rows)), (pa.int64(), pa.binary(), kind))]
    cut = list(suffixes._cut(iter([pa.RecordBatch.from_arrays(columns, ["id", "packed", "ranges"])]), 20))
    sent = pa.Table.from_batches(cut).to_pandas()
    # 16 strings of the passage; before it three, two or one digit.
    distinct = 16 + 300 + 100 + 10
    assert sent.text.notna().sum() == distinct
    sorted_texts = []
    later = suffixes.later_windows
    monkeypatch.setattr(suffixes, "later_windows", lambda texts, *rest: sorted_texts.extend(texts) or later(texts, *rest))
    again = sent.assign(id=sent.id + 1000)
    found = suffixes._compare(pd.concat([again, sent]), 20)
    assert len(sorted_texts) == len(set(sorted_texts)) == distinct
    got = sorted((r.id, i) for r in found.itertuples() for i in range(r.start, r.start + r.count))
    strings = [(d, i, (b"%03d" % (d % 1000) + passage)[i : i + 20]) for d in [*range(300), *range(1000, 1300)] for i in range(19)]
    seen, want = set(), []
    for d, i, string in strings:
        want += [(d, i)] if string in seen else []
        seen.add(string)
    assert got == want


def test_suffix_ranks():
    rnd = random.Random(5)
    for n in (1, 2, 3, 4, 5, 6, 7, 30, 301):
        for letters in (1, 2, 30):
            s = [rnd.randint(1, letters) for _ in range(n)]
            order = np.argsort(suffixes.suffix_ranks(np.array(s), 10**9), kind="stable").tolist()
            assert order == sorted(range(n), key=lambda i: s[i:])


def test_substring_repeats_empty_and_nulls(spark):
    empty = spark.createDataFrame([], DOCS)
    assert suffixes.remove_repeats(empty).count() == 0
    rows = [(None, "z" * 300, 0, 0, ""), (3, "z" * 300, 0, 0, ""), (3, None, 0, 0, "")]
    got = sorted((r.id or 0, r.n_bytes, len(r.spans)) for r in suffixes.remove_repeats(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, 300, 0), (3, 0, 0), (3, 300, 1)]


def simhash_brute(rows, distance=4):
    prints = {k: brute.fingerprint(v) for k, v in rows.items()}
    return prints, brute.groups(rows, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= distance)


def test_simhash(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows: dict[int, str | None] = {}
    for base in range(12):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 300))]
        for copy in range(rnd.randrange(1, 12)):
            new = list(words)
            if copy > 1:
                for _ in range(rnd.randrange(1, 4)):
                    new[rnd.randrange(len(new))] = rnd.choice(vocabulary)
            rows[100 * copy + base] = " ".join(new)
    rows |= {9001: None, 9002: "", 9003: " \n", 9004: "One", 9005: "one", 9006: "word " * 20_000}
    prints, roots = simhash_brute(rows)
    got = {r.id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {k: (prints[k], roots[k]) for k in rows}
    kept = simhash.keep_first(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "id", "fp", "u"]
    assert {r.doc_id for r in kept.collect()} == set(roots.values())


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 5])
def test_simhash_links_are_complete(spark, distance):
    rnd = random.Random(distance)
    prints = {rnd.getrandbits(63) for _ in range(6)}
    for p in list(prints):
        for flips in range(1, 7):
            x = p
            for b in rnd.sample(range(64), flips):
                x ^= 1 << b
            prints.add(x - 2**64 if x >= 2**63 else x)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {(r.u, r.v) for r in simhash.links(df, distance).collect()}
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) % 2**64).bit_count() <= distance}
    assert got == want


def test_simhash_nulls_and_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c d e", 0, 0, ""), (None, "a b c d e", 0, 0, ""), (8, "a b c d e", 0, 0, ""), (8, "other", 0, 0, ""), (9, "other", 0, 0, "")]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((r.id or 0, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, 8), (0, 8), (8, 8), (8, 8), (9, 8)]
    assert sorted(r.doc_id or 0 for r in simhash.keep_first(df).collect()) == [0, 0, 8, 8]


def near(rnd, words: list[str], share: float) -> str:
    """The words with a share of them changed."""
    return " ".join(f"z{rnd.randrange(99)}" if rnd.random() < share else w for w in words)


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_copies(spark, seed):
    """Groups of near copies, chains, exact copies, short and empty texts, against all pairs by their shingles."""
    rnd = random.Random(seed)
    rows: dict[int, str | None] = {}
    for _ in range(12):
        words = [f"{rnd.choice('abcdefgh')}{rnd.randrange(400)}" for _ in range(rnd.randrange(90, 300))]
        for _ in range(rnd.randrange(1, 9)):
            rows[len(rows) * 3] = near(rnd, words, rnd.choice([0, 0.01, 0.02, 0.03]))
            if rnd.random() < 0.3:
                # A chain drifts away from its start.
                words = rows[max(rows)].split()
    rows |= {1: None, 2: "", 4: " \n", 5: "a b c", 7: "A  b\nC", 8: "a b d", 10: rows[0].upper(), 11: "w " * 9000, 13: "w " * 9001}
    got = {r.id: r.component_id for r in simhash.similar_copies(frame(spark, rows)).collect()}
    sets = {k: brute.shingles(v) for k, v in rows.items()}
    assert got == brute.groups(rows, lambda a, b: brute.jaccard(sets[a], sets[b]) >= 0.8)
    assert len(set(got.values())) < len(got) - 20


def test_similar_copies_recall(spark):
    """Of pairs that are just near enough, nearly all are found."""
    rnd = random.Random(4)
    rows, pairs = {}, []
    while len(pairs) < 150:
        words = [f"{rnd.choice(WORDS)}{rnd.randrange(60)}" for _ in range(rnd.randrange(80, 500))]
        other = near(rnd, words, 0.02)
        likeness = brute.jaccard(brute.shingles(" ".join(words)), brute.shingles(other))
        if 0.8 <= likeness <= 0.87:
            i = 2 * len(pairs)
            rows[i], rows[i + 1] = " ".join(words), other
            pairs.append(i)
    got = {r.id: r.component_id for r in simhash.similar_copies(frame(spark, rows)).collect()}
    assert sum(got[i + 1] == i for i in pairs) >= 0.95 * len(pairs)
    assert all(got[i] == i for i in pairs)


def test_similar_copies_edge_cases(spark):
    assert simhash.similar_copies(spark.createDataFrame([], DOCS)).count() == 0
    same = "one two three four five six seven eight nine ten"
    rows = [(None, same), (1, same), (1, "other words here"), (2, same), (3, "Other words  here"), (None, None)]
    df = spark.createDataFrame([(k, v, 0, 0, "") for k, v in rows], DOCS).withColumn("gone", F.lit(1))
    kept = simhash.keep_first_similar(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, same), (1, same), (1, "other words here")]


def test_a_large_group_of_near_copies_is_not_compared_in_pairs(spark):
    rnd = random.Random(6)
    words = [f"{rnd.choice(WORDS)}{rnd.randrange(60)}" for _ in range(200)]
    rows = {i: near(rnd, words, 0.005) for i in range(400)}
    compared = []
    plain = simhash._similar
    simhash._similar = lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest)
    try:
        got = {r.id: r.component_id for r in simhash.similar_copies(frame(spark, rows)).collect()}
    finally:
        simhash._similar = plain
    sets = {k: brute.shingles(v) for k, v in rows.items()}
    assert got == brute.groups(rows, lambda a, b: brute.jaccard(sets[a], sets[b]) >= 0.8)
    assert len(set(got.values())) < 5 and sum(compared) < 400 * 22


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 200)] + [(rnd.randrange(300, 500), rnd.randrange(300, 500)) for _ in range(150)]
    df = spark.createDataFrame([*edges, (None, 3), (7, 7)], "u long, v long").repartition(7)
    got = {r.node: r.root for r in components.components(df).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    pairs = {frozenset(e) for e in edges}
    want = brute.groups(nodes, lambda a, b: frozenset((a, b)) in pairs)
    assert got == want


@pytest.mark.parametrize("seed", [6, 16])
def test_lines(spark, seed):
    """Against the rule written out, with passages inside lines, long and null texts, and marks."""
    rnd = random.Random(seed)
    words = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    passages = [words(40) + rnd.choice(["\n", ""]) + words(20) for _ in range(4)] + ["これは長い文です。" * 5]
    rows = {}
    for i in range(60):
        rows[i * 2] = "".join(rnd.choice([words(rnd.randrange(12)), rnd.choice(passages), rnd.choice(passages).upper()]) + rnd.choice([" ", "\n", " \n\n", "\t"]) for _ in range(4))
    rows |= {1: None, 3: "", 5: " \n ", 7: "\n".join([passages[0]] * 3), 9: words(3) + "x" * 5000, 11: rows[4]}
    found = lines.remove_repeats(frame(spark, rows).withColumn("removed", F.lit(1)).withColumn("key", F.lit(2)))
    assert found.columns == ["doc_id", "text", "id", "fp", "u", "removed", "key", "removed_"]
    got = {r.doc_id: (r.text, [(s.line, s.start, s.end) for s in r.removed_ or []]) for r in found.collect()}
    assert got == brute.line_repeats(rows)
    assert sum(len(s) for _, s in got.values()) > 40


def test_lines_edge_cases(spark):
    assert lines.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    line = "seven words that make thirty bytes long"
    rows = [(None, line), (1, f"{line}\n{line.upper()}  "), (1, f"{line}\n{line.upper()}  "), (2, line), (3, "a b"), (4, "a b"), (5, f"a\n\n{line}"), (6, "文" * 10), (7, "文" * 10)]
    df = spark.createDataFrame([(k, v, 0, 0, "") for k, v in rows], DOCS)
    got = sorted((r.doc_id or 0, r.text) for r in lines.remove_repeats(df).collect())
    assert got == [(0, line), (1, line), (1, line), (2, ""), (3, "a b"), (4, "a b"), (5, "a\n"), (6, "文" * 10), (7, "")]
    # Texts that share an id are one document: neither repeats the other.
    rows = [(1, "one " * 20), (1, "two " * 20), (2, "one " * 20 + "\n" + "two " * 20)]
    got = {r.text for r in lines.remove_repeats(spark.createDataFrame([(k, v, 0, 0, "") for k, v in rows], DOCS)).collect()}
    assert got == {"one " * 20, "two " * 20, ""}


def test_hot_digests_meet_their_rows_once(spark):
    rows = {i: f"the very same line stands in all of these texts\n{i} own words number {i * 7} only here" for i in range(300)}
    every = {share: {r.id: sorted(r.found) for r in lines.repeats(frame(spark, rows), hot_share=share).collect()} for share in (2, 4096, 1 << 40)}
    assert every[2] == every[4096] == every[1 << 40] and len(every[2]) == 299


def test_passages_are_caught(spark):
    """Words of passages that stand behind other words in an earlier document: nine of ten go, none of the others."""
    rnd = random.Random(9)
    words = lambda n: [f"{rnd.choice(WORDS)}{rnd.randrange(999)}" for _ in range(n)]
    rows, spans = {}, {}
    for i in range(0, 80, 2):
        passage = words(rnd.randrange(51, 160))
        rows[i] = " ".join(words(30) + passage + words(30))
        head = words(rnd.randrange(40))
        spans[i + 1] = (" ".join(head), " ".join(passage))
        rows[i + 1] = " ".join([*head, *passage, *words(20)])
    kept = {r.doc_id: r.text for r in lines.remove_repeats(frame(spark, rows)).collect()}
    before = after = 0
    for i, (head, passage) in spans.items():
        before += len(passage.split())
        after += len(set(passage.split()) & set(kept[i].split()))
        assert set(head.split()) <= set(kept[i].split()) and passage not in kept[i]
    assert after < 0.15 * before
    assert all(kept[i] == rows[i] for i in range(0, 80, 2))


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        for _ in range(25):
            base = rng.normal(size=8)
            for _ in range(rng.integers(1, 6)):
                rows.append((len(rows), (base + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.2])).tolist(), label))
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [None] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0] * 5, [2.0] * 5, [1e300] * 8, [1e-300] * 8]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(2000, [1.0] * 8, None), (2001, [1.0] * 8, None), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, rep int").repartition(4)

    def good(v, label):
        return v and label is not None and None not in v and all(map(math.isfinite, v)) and any(v)

    units = {i: (label, len(v), np.array(v) / max(map(abs, v))) for i, v, label in rows if i is not None and good(v, label)}

    def linked(a, b):
        (x, m, p), (y, n, q) = units[a], units[b]
        return x == y and m == n and p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= 0.98

    roots = brute.groups(units, linked)
    want = {i: (sum(linked(i, j) for j in units if j != i), roots[i]) if i in units else (0, i) for i, _, _ in rows}
    for settings in ({}, {"cell_rows": 10, "block_rows": 7}):
        got = embeddings.near_duplicates(df, **settings).collect()
        assert {r.id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(rows)
        assert all(r.kept == (r.id is None or r.id == r.component_id) for r in got)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embedding_copies_are_counted(spark):
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.lit(1).alias("label"))
    got = embeddings.near_duplicates(df.union(df)).collect()
    assert len(got) == 600 and {(r.n_links, r.component_id) for r in got} == {(299, 0)}


def test_vectors_that_share_an_id(spark):
    """Each is judged by itself, though both have the smallest id of their group."""
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (3, [0.001, 1.0], 0), (4, [1.0, 0.0], 0), (5, [1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 2, 1), (5, 0, 5)]


def test_an_array_is_sorted_no_more_than_it_must(monkeypatch):
    """Distinct ranks are put in place, a name is sorted for once a level, and eight letters are compared at a time."""
    rnd = random.Random(8)
    shared = [bytes(rnd.choice(b"abcdefgh ") for _ in range(160)) for _ in range(12)]
    texts = [bytes(rnd.choice(b"xyz") for _ in range(rnd.randrange(40))) + rnd.choice(shared)[: rnd.randrange(100, 161)] for _ in range(60)] + [b"a" * 300]
    sorts, plain = [], np.unique
    monkeypatch.setattr(suffixes.np, "unique", lambda *a, **k: sorts.append(1) or plain(*a, **k))
    for length in (100, 9, 8, 3):
        counts = np.array([max(0, len(t) - length + 1) for t in texts])
        ids, starts = np.arange(len(texts)) // 2, np.arange(len(texts)) % 2 * 1000
        sorts.clear()
        owner, offset = suffixes.later_windows(texts, counts, ids, starts, length)
        assert len(sorts) <= 1 + math.ceil(math.log(length, 3))
        places: dict[bytes, list] = {}
        for t, (text, n) in enumerate(zip(texts, counts.tolist())):
            for i in range(n):
                places.setdefault(text[i : i + length], []).append((int(ids[t]), int(starts[t]) + i, t, i))
        want = {p[2:] for found in places.values() for p in sorted(found)[1:]}
        assert set(zip(owner.tolist(), offset.tolist())) == want and len(owner) == len(want) > 500

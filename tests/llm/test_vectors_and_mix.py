"""Codes, hard negatives and the source mix against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from telemill.llm import codes, integers, mixing, negatives

VECTORS = "vec_id long, embedding array<double>, label int, id long, size string, code int, positives string, anchor int"


def vectors(spark, rows):
    """Rows ``(id, vector, label)`` with further columns named like the operators' own."""
    return spark.createDataFrame([(i, v, x, -1, "s", 0, "p", 1) for i, v, x in rows], VECTORS).repartition(4)


def clustered(seed: int, count: int, size: int = 8, clusters: int = 5) -> list[tuple]:
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(clusters, size))
    rows = []
    for i in range(count):
        label = i % clusters
        v = centres[label] + 0.2 * rnd.normal(size=size)
        rows.append((i * 3, (v / np.linalg.norm(v)).tolist(), label))
    # Copies, and components on borders of the steps.
    for i in range(7, count, 7):
        rows[i] = (rows[i][0], rows[7][1], rows[i][2])
    for i in range(3, count, 11):
        rows[i] = (rows[i][0], [round(4 * x) / 4 for x in rows[i][1]], rows[i][2])
    return rows


BAD = [(1, None, 1), (2, [1.0, None] * 4, 1), (4, [float("nan")] * 8, 1), (5, [float("inf")] + [0.0] * 7, None)]


@pytest.mark.parametrize("seed, count, entries", [(1, 150, 16), (2, 90, 256), (3, 400, 31)])
def test_codes(spark, monkeypatch, seed, count, entries):
    """Also with small blocks and rings, fewer rows than entries, and ties."""
    monkeypatch.setattr(codes, "BLOCK_ROWS", 17)
    monkeypatch.setattr(codes, "RING", 3)
    rows = clustered(seed, count)
    found, books = codes.compress(vectors(spark, rows + BAD), entries=entries)
    got = {r.id: (bytes(r.code), r.error) for r in found.collect()}
    want, plain = brute.codes({i: v for i, v, _ in rows}, entries, codes.ROUNDS)
    assert got == want
    assert [b.tolist() for b in books] == plain


def test_codes_prune(spark):
    """Balls of tight groups leave few entries to compare, and quiet ones none."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, size=(60, 4))
    rows = (centres[:, None] + rng.integers(-9, 9, size=(60, 40, 4))).reshape(-1, 4)
    first = codes.Balls(centres.astype(np.int64))
    owner, gaps = codes.assign(rows, first, None)
    far = np.zeros(60, np.int64)
    np.maximum.at(far, owner, gaps)
    book = codes.balls(centres.astype(np.int64), first.entries, far)
    assert book.reach.max() < 10 and book.quiet.all()
    again, gaps_again = codes.assign(rows, book, owner)
    assert (again == owner).all() and (gaps_again == gaps).all()


def test_codes_edge_cases(spark):
    empty, books = codes.compress(vectors(spark, []).where("false"))
    assert empty.count() == 0 and books == []
    rows = [(i, [0.25 * i] * 8, None) for i in range(3)] + [(None, [0.0] * 8, 1), (9, [1.0] * 4, 1), (8, [], 1), (7, [1e30] * 8, 2)]
    found, books = codes.compress(vectors(spark, rows + rows[:1]))
    got = {(r.id, bytes(r.code) if r.code is not None else None, r.error) for r in codes.with_label_errors(found).collect()}
    assert found.count() == 8 and all(len(b) == 4 for b in books)
    # The repeated row starts two equal entries; ties go to the lower one.
    assert {(0, b"\0" * 4, 0), (9, None, None), (8, None, None), (7, None, None)} <= got
    errors = {(r.label, r.label_error) for r in codes.with_label_errors(found).collect()}
    assert (None, 0) in errors and len(codes.books_digest(books)) == 64
    back = {r.id: list(r.vector) for r in codes.decode(found.where("id < 3"), books).collect()}
    assert all(abs(x - 0.25 * i) < 0.001 for i, v in back.items() for x in v)


def test_large_components_stay_exact():
    rows = np.array([[(1 << 25) - 1, 1], [-(1 << 25), 3], [5, 5]], np.int64)
    assert integers.exact(rows, 1).dtype == np.int64
    owner, gaps = codes.assign(rows, codes.Balls(rows[[2, 0]].copy()), None)
    assert owner.tolist() == [1, 0, 0] and gaps.tolist() == [0, ((1 << 25) + 5) ** 2 + 4, 0]


@pytest.mark.parametrize("seed, count, block", [(1, 160, 4096), (2, 220, 40), (3, 60, 7)])
def test_hard_negatives(spark, monkeypatch, seed, count, block):
    monkeypatch.setattr(negatives, "DEPTH", 1)
    monkeypatch.setattr(negatives, "STEP", 2)
    rows = clustered(seed, count)
    # A hot vector under two labels.
    rows += [(10_000 + i, rows[0][1], i % 2) for i in range(40)]
    bad = [*BAD, (6, [0.1] * 8, None), (None, [0.1] * 8, 1)]
    found = negatives.mine(vectors(spark, rows + bad + rows[:3]), F.col("id") % 9 == 0, block_rows=block, block_anchors=5)
    got = {tuple(r) for r in found.collect()}
    assert got == brute.hard_negatives([(i, x, v) for i, v, x in rows], lambda i: i % 9 == 0, 5, 3)
    assert len(got) > 100


def test_threshold_stops_early():
    """Where few rows are near, the reading ends long before the lists do."""
    rng = np.random.default_rng(3)
    rows = rng.integers(-3, 3, size=(5000, 4))
    rows[:6] = [[90, 80, -90, 70]] * 6
    lists = negatives.Lists(np.arange(5000), np.zeros(5000, np.int64), rows, 100)
    anchor = np.array([[9, 8, -9, 7]])
    read = []
    plain = lists.read
    lists.read = lambda a, depth: read.append(depth) or plain(a, depth)
    (_, _, ids, scores), = negatives.top_within(lists, anchor, [None], [[(-(1 << 61), 1 << 61)]], 5)
    assert ids.tolist() == [0, 1, 2, 3, 4] and len(set(scores.tolist())) == 1 and max(read) <= 64


def test_hard_negatives_edge_cases(spark):
    assert negatives.mine(vectors(spark, []).where("false"), F.col("id") % 2 == 0).count() == 0
    # No positives, negative positive scores, other sizes, an id with two vectors.
    rows = [(0, [1.0] * 8, 1), (1, [1.0] * 8, 2), (2, [-1.0] * 8, 3), (4, [1.0] * 8, 3), (5, [1.0] * 2, 1), (6, [0.6] * 8, 2), (6, [9.0] * 8, 4)]
    got = {tuple(r) for r in negatives.mine(vectors(spark, rows), F.col("id") % 2 == 0).collect()}
    plain = [(0, 1, [1.0] * 8), (1, 2, [1.0] * 8), (2, 3, [-1.0] * 8), (4, 3, [1.0] * 8), (6, 2, [0.6] * 8)]
    assert got == brute.hard_negatives(plain, lambda i: i % 2 == 0, 5, 3)


DOCS = "doc_id long, text string, source string, id long, size int, start long, place int, block long, taken long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, -1, 0, 0, 0, 0, 0) for i, t, s in rows], DOCS).repartition(4)


@pytest.mark.parametrize("seed, block", [(1, 16), (2, 100), (3, 100_000)])
def test_mix(spark, seed, block):
    rnd = random.Random(seed)
    names = [None, "", "a", "b", "é", "z", "ab"]
    rows = [(i, " ".join("w" * rnd.randrange(1, 4) for _ in range(rnd.randrange(0, 60))), names[0] if i % 3 else rnd.choice(names)) for i in range(200)]
    rows += [(1000, None, "a"), (1001, " \n\t ", "b"), (1002, "x " * 5000, "b"), (None, "no id", "z"), (1003, None, "empty")]
    rows += [rows[4]] * 3
    parts, given = mixing.mix(docs(spark, rows), block_words=block)
    given, parts = given.collect(), parts.collect()
    assert Counter((r.id, r.source, r["size"]) for r in given) == Counter((i, s, len((t or "").split())) for i, t, s in rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    target = brute.mix_targets(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.REPEATS)
    taken = Counter()
    for r in given:
        taken[r.source] += r.taken
        assert r.target == target[r.source] and r.source_size == sizes[r.source] and r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    # Blocks are full but for a source's last one, and each slot holds one block.
    words, at = Counter(), {}
    for r in parts:
        words[r.slot] += r["to"] - r["from"]
        assert at.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    last = {s: max(b for x, b in at.values() if x == s) for s, _ in at.values()}
    assert all(words[k] == block or b == last[s] for k, (s, b) in at.items())
    assert sorted(at.values(), key=str) == sorted({*at.values()}, key=str)
    again = mixing.mix(docs(spark, rows[::-1]), block_words=block)[1].collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, given))


def test_mix_is_even_along_the_schedule(spark):
    """Any beginning of the schedule holds the sources nearly in proportion."""
    rows = [(i, "w " * 100, f"s{i % 3}") for i in range(600)]
    parts, _ = mixing.mix(docs(spark, rows), block_words=50)
    order = [r.source for r in sorted({(r.slot, r.source) for r in parts.select("slot", "source").collect()}) for r in [type("R", (), {"source": r[1]})]]
    share = {s: n / len(order) for s, n in Counter(order).items()}
    for k in range(50, len(order), 97):
        seen = Counter(order[:k])
        assert all(abs(seen[s] - share[s] * k) <= 2 + np.log2(k) for s in share)


def test_mix_of_many_sources_and_of_nothing(spark):
    rows = [(i, "a b c", f"s{i:05}") for i in range(3000)]
    given = mixing.mix(docs(spark, rows))[1]
    sums = given.groupBy((F.col("target") > 4.5).alias("x")).agg(F.sum("taken").alias("n"), F.count("*").alias("c")).collect()
    target = brute.mix_targets({s: 3 for _, _, s in rows}, mixing.WEIGHTS, mixing.SHARE, mixing.REPEATS)
    assert sum(r.c for r in sums) == 3000 and abs(sum(r.n for r in sums) - sum(target.values())) <= 1500
    parts, none = mixing.mix(docs(spark, rows).where("false"))
    assert parts.count() == 0 and none.count() == 0
    parts, zero = mixing.mix(docs(spark, [(1, None, None), (2, "", "a")]))
    assert parts.count() == 0 and [(r.target, r.taken) for r in zero.collect()] == [(0.0, 0)] * 2


def test_mix_runs_no_python(spark):
    parts, given = mixing.mix(docs(spark, [(1, "a b", "x"), (2, "c", "y")]))
    for df in (parts, given):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_reversed_bits(spark):
    got = spark.range(64).select("id", mixing.reversed_bits(F.col("id"), 6).alias("r")).collect()
    assert [r.r for r in got] == [int(f"{r.id:06b}"[::-1], 2) for r in got]

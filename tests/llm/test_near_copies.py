"""What near copies move, the filter by ids, links in blocks, and what an encoder remembers."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from telemill.llm import bpe, common, components, simhash

WORDS = "a of the and over into winter mountain letters yesterday nevertheless é 日本 x1 can't".split()


def shuffled_bytes(df) -> int:
    """Bytes that the exchanges of a query get, its broadcasts left out."""

    def below(plan) -> int:
        if plan.nodeName() == "AdaptiveSparkPlan":
            return below(plan.executedPlan())
        if plan.nodeName().endswith("QueryStage"):
            return below(plan.plan())
        own = plan.metrics().get("dataSize").get().value() if plan.nodeName() == "Exchange" else 0
        return own + sum(below(plan.children().apply(i)) for i in range(plan.children().size()))

    query = df._jdf.queryExecution()
    query.toRdd().count()
    return below(query.executedPlan())


def test_texts_that_are_near_no_other_are_not_shuffled(spark):
    """However many ids there are, and so too many to be broadcast by size."""
    rnd = random.Random(9)
    rows = {i: " ".join([f"{rnd.choice(WORDS)}{rnd.randrange(60)}" for _ in range(900)]) + f" {i}" for i in range(200)} | {500: None}
    rows |= {1000 + i: rows[i] + " more" for i in range(4)}
    size, moved = sum(len(t or "") for t in rows.values()), []
    plain, limit = simhash._shingle_rows, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    simhash._shingle_rows = lambda df, *rest: moved.append(shuffled_bytes(df)) or plain(df, *rest)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_first_similar(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
        moved.append(shuffled_bytes(kept))
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in rows if i < 1000)
    finally:
        simhash._shingle_rows = plain
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(moved) > 1 and max(moved) < size / 5


def test_divided(spark):
    rows = [(i, "x") for i in range(5000)] + [(None, "y"), (7, "z")]
    df = spark.createDataFrame(rows, "`a.id` long, word string")
    ids = spark.createDataFrame([(i,) for i in range(0, 5000, 7)] + [(None,), (9999,)], "bits long")
    some, rest = common.divided(df, "a.id", ids)
    assert some.columns == rest.columns == df.columns
    maybe, never = [tuple(r) for r in some.collect()], [tuple(r) for r in rest.collect()]
    assert sorted(maybe + never, key=str) == sorted(rows, key=str)
    assert {k for k, _ in maybe} >= set(range(0, 5000, 7)) and (7, "z") in maybe and len(maybe) < 800
    empty = common.divided(df, "a.id", ids.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == len(rows)


@pytest.mark.parametrize("block", [8, 1 << 20])
def test_components_of_links_beyond_a_block(spark, monkeypatch, block):
    """Turn by turn and in one task: chains in any order, a star, rings."""
    monkeypatch.setattr(components, "_BLOCK", block)
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)]
    edges += [(2000 + 10 * r + i, 2000 + 10 * r + (i + 1) % 5) for r in range(20) for i in range(5)]
    rnd.shuffle(edges)
    df = spark.createDataFrame(edges, "u long, v long").repartition(9)
    want = {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1100)}
    want |= {2000 + 10 * r + i: 2000 + 10 * r for r in range(20) for i in range(5)}
    assert {r.node: r.root for r in components.components(df).collect()} == want


def test_remembered_words_are_four_bytes_an_id():
    """Remembering a word makes no object of each of its ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = bpe.Encoder(path), Tokenizer.from_file(path)
    for word in ("winter", "mountains", "zqxjqzx", "x2024", "é"):
        want = [i for part in encoder.words_of(word) for i in np.frombuffer(encoder.words[part], np.int32).tolist()]
        assert want == library.encode(word, add_special_tokens=False).ids
        assert all(isinstance(ids, bytes) for ids in encoder.words.values())


def test_the_stage_drops_near_duplicates_by_simhash_and_near_copies(spark):
    """Groups over links of both kinds: fingerprints within 4 bits as op7 links them, and five-word shingles at 0.8 or more."""
    rnd = random.Random(12)
    line = lambda n: [f"{rnd.choice(WORDS)}{rnd.randrange(400)}" for _ in range(n)]
    rows: dict[int, str | None] = {}
    for base in range(6):
        # Most shingles are the same ones over and over: they set the fingerprint, but are few among the different ones.
        often = " ".join(line(4)) + " "
        rows[10 * base + 1] = often * 300 + " ".join(line(30))
        rows[10 * base + 2] = often * 300 + " ".join(line(30))
        words = line(200)
        rows[10 * base + 3] = " ".join(words)
        rows[10 * base + 4] = " ".join([*words[:100], "other", *words[101:]])
        # A chain over both: the last shares shingles with the second, which has the first's fingerprint.
        rows[10 * base + 5] = rows[10 * base + 2] + " end"
    rows |= {900: None, 901: "", 902: " ".join(line(60))}
    prints = {k: brute.fingerprint(v) for k, v in rows.items()}
    sets = {k: brute.shingles(v) for k, v in rows.items()}
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4
    alike = lambda a, b: brute.jaccard(sets[a], sets[b]) >= 0.8
    both = brute.groups(rows, lambda a, b: near(a, b) or alike(a, b))
    assert len(set(both.values())) < min(len(set(brute.groups(rows, f).values())) for f in (near, alike))
    docs = spark.createDataFrame([(k, v, "clash") for k, v in [*rows.items(), (None, rows[1])]], "doc_id long, text string, u string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, *sorted(set(both.values()))]

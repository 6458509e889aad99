"""Sources mixed to target weights: a van der Corput schedule of slots over shuffled equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import written
from telemill.operators.ordinals import index_within, running_sum

#: Words are counted as runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block; the last block of a source may have fewer.
BLOCK_WORDS = 1024
#: Weights of the sources in their order, over and over.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the corpus, and how often a word may be taken.
SHARE, REPEATS = 1.5, 2

# Pairs of (shift, mask) that turn the bits of a long around.
_SWAPS = ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF))


def reversed_bits(number: Column, bits: int) -> Column:
    """The lowest ``bits`` bits (1 to 63) of a whole number in reverse order."""
    for shift, mask in _SWAPS:
        low = F.lit(mask)
        number = F.shiftrightunsigned(number, shift).bitwiseAND(low).bitwiseOR(F.shiftleft(number.bitwiseAND(low), shift))
    number = F.shiftrightunsigned(number, 32).bitwiseOR(F.shiftleft(number, 32))
    return F.shiftrightunsigned(number, 64 - bits)


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``id, source, size, mark``: the words of each row, and a number that shuffles the rows by their id."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return df.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long").alias("mark"),
    )


def targets(
    rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``source, place, weight, source_size, target, words, first, blocks`` for each source of :func:`sized` rows.

    Sources stand in the order of their code points, null last. They share ``share`` times all words by
    weight; where that is more than ``repeats`` times a source's words, the excess is shared again by weight
    until none is above. Two numbers, what is left to share and the weight that shares it, decide who is
    above, and each turn is one aggregate over the sources. ``words`` is the target in whole words, ``blocks``
    the blocks it fills, ``first`` the blocks of the sources before.
    """
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = found.withColumn("last", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long"))
    found = running_sum(found, [], ["last", "source"], "one", "place")
    turns = F.array(*(F.lit(w) for w in weights))
    found = written(found.select(
        "source", F.col("place").cast("long").alias("place"), "source_size",
        F.element_at(turns, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double").alias("weight"),
    ))
    most = F.col("source_size") * F.lit(repeats)
    whole = found.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    total, held = share * (whole.n or 0), None
    rest, weight = total, whole.w or 0.0
    while True:
        above = F.lit(weight > 0) & (F.lit(rest) * F.col("weight") / F.lit(weight or 1.0) > most)
        turn = found.where(above).agg(F.count("*").alias("n"), F.sum(most).alias("s"), F.sum("weight").alias("w")).first()
        if turn.n == held:
            break
        held, rest, weight = turn.n, total - (turn.s or 0), (whole.w or 0.0) - (turn.w or 0.0)
    fair = F.lit(rest) * F.col("weight") / F.lit(weight or 1.0)
    target = F.when(F.lit(weight <= 0) | (fair > most), most.cast("double")).otherwise(fair)
    found = found.withColumn("target", target).withColumn("words", F.floor(F.col("target") + 0.5))
    found = found.withColumn("blocks", F.ceil(F.col("words") / F.lit(block_words)).cast("long"))
    found = running_sum(found, [], ["place"], "blocks", "upto")
    return written(found.withColumn("first", (F.col("upto") - F.col("blocks")).cast("long")).drop("upto"))


def schedule(sources: DataFrame) -> DataFrame:
    """``slot, place, block``: which block of which source stands at which slot of the mix.

    The points of the van der Corput sequence, whole numbers over a power of two, are mapped through the
    cumulative blocks of the sources, so every stretch of the schedule holds the sources nearly in proportion
    and each source gets exactly its blocks; points beyond the last block are gaps. A source's slots are
    ranked by ranges of slots, as one source may hold a third of them.
    """
    ends = sources.agg(F.sum("blocks").alias("n"), F.count("*").alias("s")).first()
    count = int(ends.n or 0)
    width = max(1, count // (4096 + int(ends.s)))
    # Cumulative weights by stretches of points: each stretch meets the few sources that overlap it.
    parts = F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("blocks") - 1) / width))
    spans = sources.where("blocks > 0").select("place", "first", "blocks", F.explode(parts).alias("part"))
    points = sources.sparkSession.range(count).select(F.col("id").alias("point"), F.floor(F.col("id") / width).alias("part"))
    inside = (F.col("point") >= F.col("first")) & (F.col("point") < F.col("first") + F.col("blocks"))
    slots = points.join(spans, "part").where(inside)
    slots = slots.select(reversed_bits(F.col("point"), max(1, count.bit_length())).alias("slot"), "place")
    return index_within(slots, ["place"], "slot", "block")


def streams(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows with their source's columns and the words of the source that stand before them, ``start``.

    The words of a source are one stream, rows in the order of their marks.
    """
    named = sources.select(F.col("source").alias("_source"), "place", "source_size", "target", "words")
    joined = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return running_sum(joined, ["place"], ["mark", "id", "size"], "size", "_end").withColumn(
        "start", (F.col("_end") - F.col("size")).cast("long")
    ).drop("_end")


def pieces(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``place, block, start, id, from, to``: the words of each row that fall into each block of its source.

    Blocks cut the stream into equal numbers of words and go on at its start after its end, up to the
    source's target; a row of any length may stand in many blocks.
    """
    b = F.lit(block_words)
    passes = F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / F.col("source_size")))
    every = placed.where("size > 0 AND words > 0").select("place", "id", "start", "size", "words", "source_size", F.explode(passes).alias("pass"))
    every = every.withColumn("a", F.col("pass") * F.col("source_size") + F.col("start"))
    every = every.withColumn("z", F.least(F.col("a") + F.col("size"), "words")).where("a < z")
    cut = every.select("*", F.explode(F.sequence(F.floor(F.col("a") / b), F.floor((F.col("z") - 1) / b))).alias("block"))
    return cut.select(
        "place", "block", "start", "id", (F.greatest(F.col("a"), F.col("block") * b) - F.col("a")).alias("from"),
        (F.least(F.col("z"), (F.col("block") + 1) * b) - F.col("a")).alias("to"),
    )


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """The mix, and what each row gives to it.

    The first table has a row for every row's part in a slot: ``slot`` (the order of the mix), ``source,
    block, id, from, to`` (words of that row's text, counted from 0). The second has one row per row of
    ``df``: ``id, source, size, source_size, target, taken``, where ``taken`` counts words as often as the mix
    takes them. Each source gives its target rounded to a word, so no row gives more than ``repeats`` times its
    words. Ids only shuffle: reruns agree, and of rows that share an id the smaller stands first (equal ones
    cannot be told apart). A null text has no words, a null source is the last source, a null id stands at a
    place of its own. Rows without words and sources without a target take no part. Empty tables give no rows.
    """
    rows = written(sized(df, id_col, text_col, source_col))
    sources = targets(rows, weights, share, repeats, block_words)
    placed = written(streams(rows, sources))
    parts = schedule(sources).join(pieces(placed, block_words), ["place", "block"])
    given = parts.groupBy("place", "start").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    # A row without words shares its start with the next one.
    keyed = placed.withColumn("start", F.when(F.col("size") > 0, F.col("start")))
    result = keyed.join(given, ["place", "start"], "left").select(
        "id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
    names = sources.select("place", "source")
    return parts.join(names, "place").select("slot", "source", "block", "id", "from", "to"), result


#: The same rows in SQL, with the targets in closed form: in the order of words by weight, a source is above
#: its cap if its cap by weight is less than what the later ones would share.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS mark
  FROM documents
),
s AS (
  SELECT source, sum(size) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
),
r AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
    coalesce(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w
  FROM s
),
c AS (SELECT *, (total - capped)::DOUBLE * weight::DOUBLE / w::DOUBLE > 2 * source_size AS above FROM r),
f AS (
  SELECT any_value(total) - coalesce(sum(2 * source_size) FILTER (above), 0) AS rest, sum(weight) FILTER (NOT above) AS w FROM c
),
t AS (
  SELECT source, source_size::BIGINT AS source_size,
    CASE WHEN above THEN 2.0::DOUBLE * source_size ELSE rest::DOUBLE * weight::DOUBLE / f.w::DOUBLE END AS target FROM c, f
),
p AS (
  SELECT d.*, source_size, target, floor(target + 0.5)::BIGINT AS words,
    sum(size) OVER (PARTITION BY d.source ORDER BY mark, doc_id, size ROWS UNBOUNDED PRECEDING) AS stop
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE
    (words // source_size) * size + greatest(0, least(stop, words % source_size) - (stop - size)) END::BIGINT AS taken
FROM p
"""

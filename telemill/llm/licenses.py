"""License scans by MinHash bands over overlapping windows, with built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle, share of a template's shingles that makes a match.
SHINGLE, CONTAINMENT = 5, 0.8
#: Bands of one MinHash row each. A window has at most twice its template's words (see ``window_words``), so
#: even a template of six words with 0.8 of its shingles has a similarity above 0.12 and is missed with a
#: chance of 0.88 ** 64 < 0.0003.
BANDS = 64

# Notices as their licences' publishers word them.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def window_words(words: int) -> int:
    """Words of the windows for a template: a power of two, so that half a window and a word hold it.

    Windows start every half window, so each stretch of the template's length lies whole in one of them.
    """
    size = 8
    while words > size // 2 + 1:
        size *= 2
    return size


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits, A-Z in lower case."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+"), lambda w: w != "")


def shingle_at(words: Column, place: Column) -> Column:
    """The hash of the shingle that starts at a word (0-based)."""
    return F.xxhash64(F.array_join(F.slice(words, place + 1, SHINGLE), " "))


def shingles(words: Column, start: Column, stop: Column) -> Column:
    """The hashes of all shingles within the words [start, stop), in order."""
    places = F.when(stop - start >= SHINGLE, F.sequence(start, stop - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: shingle_at(words, i))


def signature(hashes: Column) -> Column:
    """One MinHash value per band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, j))))


def templates(spark: SparkSession, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """``license, width, needed``: window size and distinct shingles of each notice of five words or more."""
    frame = spark.createDataFrame([(str(n), str(t)) for n, t in notices], "license string, text string")
    split = frame.select("license", words_of(F.col("text")).alias("words")).where(F.size("words") >= SHINGLE)
    sizes = split.select("license", "words", F.size("words").alias("n"))
    half = F.ceil(F.log2(F.greatest(F.col("n") - 1, F.lit(4)).cast("double"))).cast("int")
    return sizes.select(
        "license", F.pow(F.lit(2), half + 1).cast("int").alias("width"),
        F.array_distinct(shingles(F.col("words"), F.lit(0), F.col("n"))).alias("needed"),
    )


def scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Sequence[tuple[str, str]] = NOTICES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """``id, license, containment, n_windows, first_word``: every notice found in a text.

    Windows of ``width`` words start every half width. A window without a single shingle of any notice has a
    containment of zero for all of them and is left out before signatures are made; this looks at each
    shingle of each text once. MinHash bands of the other windows retrieve notices of their window size, and
    a match is a window with ``containment`` of a notice's distinct shingles or more. The best containment,
    the number of matching windows and the first word (0-based) of a notice's shingle in them are given.

    Only the shingle list of the notices, which the caller passes, is part of the plan. Texts are not
    shuffled; the few windows that may match are. Null and short texts match nothing; rows that share an
    id are one document; a notice of fewer than five words is left out.
    """
    known = templates(df.sparkSession, notices)
    rows = known.select("width", "needed").collect()
    hashes, widths = sorted({h for r in rows for h in r.needed}), sorted({r.width for r in rows} or {8})

    def found_in(words: Column) -> Column:
        n = F.size(words)
        places = F.when(n >= SHINGLE, F.sequence(F.lit(0), n - SHINGLE)).otherwise(F.array().cast("array<int>"))
        # The test is against a constant set, by hash.
        hits = F.filter(places, lambda i: shingle_at(words, i).isin(hashes)) if hashes else F.array().cast("array<int>")
        return F.struct(words.alias("words"), hits.alias("hits"))

    # A lambda's variable is computed once, and a generator's result is not copied into later filters.
    split = F.transform(F.array(words_of(F.col(text_col).cast("string"))), found_in)
    hit = df.select(F.col(id_col).cast("long").alias("id"), F.inline(split)).where(F.size("hits") > 0)

    def windows(width: int) -> Column:
        step, reach = width // 2, width - SHINGLE
        return F.array_distinct(F.flatten(F.transform(
            "hits", lambda p: F.sequence(F.greatest(F.lit(0), F.ceil((p - reach) / step)).cast("int"), F.floor(p / step).cast("int"))
        )))

    each = F.array(*(F.struct(F.lit(w).alias("width"), windows(w).alias("numbers")) for w in widths))
    cut = hit.select("id", "words", F.inline(each)).select("id", "words", "width", F.explode("numbers").alias("number"))
    start = (F.col("number") * (F.col("width") / 2)).cast("int")
    stop = F.least(start + F.col("width"), F.size("words"))
    have = F.array(shingles(F.col("words"), start, stop))
    made = cut.select("id", "width", start.alias("start"), F.explode(have).alias("have"))
    banded = made.select("id", "width", "start", "have", F.posexplode(signature(F.col("have"))).alias("band", "value"))
    wanted = known.select("license", "width", F.posexplode(signature(F.col("needed"))).alias("band", "value"))
    found = banded.join(wanted, ["width", "band", "value"]).dropDuplicates(["id", "start", "width", "license", "have"])
    checked = found.join(known.drop("width"), "license").select(
        "id", "license", "start",
        (F.size(F.array_intersect("have", "needed")) / F.size("needed")).alias("share"),
        F.array_position(F.transform("have", lambda h: F.array_contains("needed", h)), True).alias("at"),
    )
    return checked.where(F.col("share") >= containment).groupBy("id", "license").agg(
        F.max("share").alias("containment"), F.count_distinct("start").alias("n_windows"),
        F.min(F.col("start") + F.col("at") - 1).cast("long").alias("first_word"),
    )


def scan_sql(notices: Sequence[tuple[str, str]] = NOTICES, containment: float = CONTAINMENT) -> str:
    """SQL that compares every window with every notice by whole shingles."""
    quoted = ", ".join("('{}', '{}')".format(a.replace("'", "''"), b.replace("'", "''")) for a, b in notices)
    split = f"list_filter(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT license, {split} AS w FROM (VALUES {quoted}) v(license, text)),
tw AS (SELECT license, w, 2 * CAST(pow(2, ceil(log2(greatest(len(w) - 1, 4)))) AS BIGINT) AS width FROM t WHERE len(w) >= {SHINGLE}),
ts AS (
  SELECT DISTINCT license, width, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS s
  FROM (SELECT license, width, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM tw)
),
tn AS (SELECT license, width, count(*) AS needed FROM ts GROUP BY ALL),
d AS (SELECT doc_id, {split} AS w FROM documents),
ds AS (
  SELECT doc_id, i - 1 AS p, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d)
),
m AS (SELECT doc_id, license, width, p, s FROM ds JOIN ts USING (s)),
-- A shingle lies in each window that starts every half width and holds all its words.
win AS (
  SELECT doc_id, license, width, k, p, s FROM (
    SELECT *, unnest(range(greatest(0, CAST(ceil((p - width + {SHINGLE}) / (width / 2)) AS BIGINT)), CAST(floor(p / (width / 2)) AS BIGINT) + 1)) AS k FROM m
  )
),
c AS (
  SELECT doc_id, license, k, count(DISTINCT s) / any_value(needed) AS share, min(p) AS p
  FROM win JOIN tn USING (license, width) GROUP BY doc_id, license, k
)
SELECT doc_id, license, max(share) AS containment, count(*) AS n_windows, min(p) AS first_word
FROM c WHERE share >= {containment} GROUP BY doc_id, license
"""

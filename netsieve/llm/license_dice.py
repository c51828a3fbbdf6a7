"""License scans: Dice coefficient over word bigrams, in DataFrame operations only.

A text is normalised (lower case, runs of anything but letters and digits become
one space), and its set of word bigrams A is compared to each template's set B:
2|A & B| / (|A| + |B|). What is compared are a text's units: its lines, its
paragraphs, itself, and its runs of as many consecutive sentences as the
template has, so that a notice inside a longer line, a wrapped one and a whole
license inside a longer text are units too.

The coefficient t asks for c = t / (2 - t) |B| common bigrams at least, and for
|A| between c and (2 - t) / t |B|. So templates are pruned in three steps, all
exact. Of any |B| - c + 1 bigrams of a template one must occur in the text: the
longest ones are its anchors. Of the templates whose anchors a text holds at
least c bigrams must occur in it. And a unit is only compared to templates
whose size its own allows. Of the templates that reach t in a unit the one with
the highest coefficient names its license.

Templates are a table of any length. Up to ``MOST_ANCHORS`` anchors are a set
of values in the plan, and a text that holds none of them never leaves its
task; anchors of a longer table are joined to all bigrams. Tables are measured,
and broadcast up to ``MOST_BYTES`` or else joined by shuffle. Texts with
anchors meet by their hash, copies counting once.

Defined results: null, empty and blank texts have no license; templates
without a name or two words are left out; a unit of one word matches nothing; a
license found in several units counts once, with its highest coefficient; ties
in a unit go to the first license by name; licenses are listed by name;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsieve.llm.shared import MOST_BYTES, Tables, broadcast_if_small

#: Notices of common licenses, as their publishers word them. Whole licenses are the files in ``licenses``.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Anchors that are values of a plan.
MOST_ANCHORS = 50_000

BLANKS = r"[ \t\n\x0B\f\r]+"


def templates(folder: str | Path | None = None) -> list[tuple[str, str]]:
    """(license, text): the notices and the whole licenses in a folder of the driver, whose files are named by them."""
    files = sorted(Path(folder or Path(__file__).parent / "licenses").glob("*.txt"))
    return [*NOTICES, *((f.stem, f.read_text("utf-8")) for f in files)]


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _pairs(unit: Column) -> Column:
    """The bigrams of a normalised text, repeated ones too."""
    words = F.split(unit, " ")
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.contains(unit, F.lit(" ")), pairs).otherwise(F.array().cast("array<string>"))


def bigrams(unit: Column) -> Column:
    return F.array_distinct(_pairs(unit))


def sentences(text: Column) -> Column:
    """A text, its blanks made single spaces, cut behind . ! ? and :"""
    plain = F.trim(F.regexp_replace(text, BLANKS, " "))
    return F.split(F.regexp_replace(plain, "([.!?:]) ", "$1\u0001"), "\u0001", -1)


def _units(text: Column, lengths: Column) -> Column:
    """array<struct<n, unit>>, normalised: lines, paragraphs and the text with n 0, and its runs of n sentences for each n of lengths."""

    def unit(n: Column, part: Column) -> Column:
        return F.struct(n.alias("n"), normalised(part).alias("unit"))

    def runs(cut: Column) -> Column:
        def of(n: Column) -> Column:
            starts = F.when(F.size(cut) >= n, F.sequence(F.lit(1), F.size(cut) - n + 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda at: unit(n, F.array_join(F.slice(cut, at, n), " ")))

        return F.flatten(F.transform(lengths, of))

    parts = F.concat(F.split(text, "\n", -1), F.split(text, r"\n[ \t]*\n", -1), F.array(text))
    return F.array_distinct(F.concat(F.transform(parts, lambda p: unit(F.lit(0), p)), F.get(F.transform(F.array(sentences(text)), runs), F.lit(0))))


def _prepared(given: DataFrame, least: float, tables: Tables) -> DataFrame:
    """(t, license, bigrams, n, needed, sentences) of the templates that have bigrams."""
    text = given.select(F.col("license"), F.col("text").alias("template")).where("license IS NOT NULL AND template IS NOT NULL").distinct()
    sets = text.select("license", bigrams(normalised(F.col("template"))).alias("bigrams"), F.size(sentences(F.col("template"))).alias("sentences")).where(F.size("bigrams") > 0)
    n = F.size("bigrams")
    rows = sets.select(F.monotonically_increasing_id().alias("t"), "license", "bigrams", n.alias("n"), F.ceil(F.round(n * (least / (2 - least)), 9)).cast("int").alias("needed"), "sentences")
    return tables.write(rows, "templates")


HASH = ("h1", "h2")


def _hashed(text: Column) -> list[Column]:
    """128 bits that name a text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def find(docs: DataFrame, text_col: str = "text", given: DataFrame | None = None, least: float = 0.8, most_bytes: int = MOST_BYTES, most_anchors: int = MOST_ANCHORS) -> DataFrame:
    """(h1, h2, license, dice), one row for each unit of a text that reaches ``least``; texts are named by their hash, copies counting once."""
    spark = docs.sparkSession
    tables = Tables(spark, "licenses")
    if given is None:
        given = spark.createDataFrame(templates(), "license string, text string")
    known = _prepared(given, least, tables)
    size = F.lit(64) + F.coalesce(F.aggregate("bigrams", F.lit(0), lambda a, b: a + F.length(b) + 24), F.lit(0))
    # of the longest bigrams so many that a unit without any of them stays under the coefficient
    ordered = F.array_sort("bigrams", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    anchors = tables.write(known.select("t", F.explode(F.slice(ordered, 1, F.col("n") - F.col("needed") + 1)).alias("pair")), "anchors")
    listed = [r["pair"] for r in anchors.select("pair").distinct().limit(most_anchors + 1).collect()]
    anchors = broadcast_if_small(anchors, F.length("pair") + 24, most_bytes)
    rows = docs.select(*_hashed(F.col(text_col)), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain = normalised(F.col("text"))
    if len(listed) <= most_anchors:  # words are letters and digits: they need no escapes
        values = ", ".join(f"'{pair}'" for pair in sorted(listed)) or "NULL"
        rows = rows.withColumn("pairs", _pairs(plain)).where(F.expr(f"exists(pairs, p -> p IN ({values}))")).drop("pairs")
    else:
        met = rows.select(*HASH, F.explode(_pairs(plain)).alias("pair")).join(anchors, "pair").select(*HASH).distinct()
        rows = rows.join(tables.write(met, "hashes"), list(HASH), "left_semi")
    # copies meet in the map-side part of the aggregate, so a text of very many copies is no hot group
    texts = tables.write(rows.groupBy(*HASH).agg(F.first("text").alias("text")), "texts")
    met = tables.write(texts.select(*HASH, F.explode(bigrams(plain)).alias("pair")).join(anchors, "pair").select(*HASH, "t").distinct(), "met")
    small = broadcast_if_small(known, size, most_bytes)
    own = texts.select(*HASH, bigrams(normalised(F.col("text"))).alias("own")).join(met, list(HASH)).join(small, "t")
    hit = tables.write(own.where(F.size(F.array_intersect("own", "bigrams")) >= F.col("needed")).select(*HASH, "t", "sentences", "needed"), "hit")
    wanted = hit.groupBy(*HASH).agg(F.collect_set("sentences").alias("lengths"), F.min("needed").alias("needed"))
    units = texts.join(wanted, list(HASH)).select(*HASH, "needed", F.explode(_units(F.col("text"), F.col("lengths"))).alias("u"))
    units = units.select(*HASH, F.col("u.n").alias("run"), F.xxhash64("u.unit").alias("unit"), "needed", bigrams(F.col("u.unit")).alias("own")).where(F.size("own") >= F.col("needed")).drop("needed")
    a, b = F.size("own"), F.col("n")
    fits = F.col("run").isin(0, F.col("sentences")) & (a >= F.col("needed")) & (a <= F.floor(F.round(b * ((2 - least) / least), 9)))
    dice = (2.0 * F.size(F.array_intersect("own", "bigrams")) / (a + b)).alias("dice")
    compared = units.join(hit.select(*HASH, "t"), list(HASH)).join(small, "t").where(fits).select(*HASH, "unit", "license", dice).where(F.col("dice") >= least)
    best = compared.groupBy(*HASH, "unit").agg(F.min(F.struct((-F.col("dice")).alias("less"), "license")).alias("best"))
    return tables.write(best.select(*HASH, F.col("best.license").alias("license"), (-F.col("best.less")).alias("dice")), "found")


def _by_text(found: DataFrame) -> DataFrame:
    names = F.array_sort(F.collect_set("license")).alias("names")
    return Tables(found.sparkSession, "licenses").write(found.groupBy(*HASH).agg(names, F.round(F.max("dice"), 9).alias("dice"), F.count("*").alias("units")), "texts")


def _join(rows: DataFrame, found: DataFrame, most_bytes: int) -> DataFrame:
    size = F.lit(64) + F.aggregate("names", F.lit(0), lambda a, name: a + F.length(name) + 24)
    return rows.join(broadcast_if_small(found, size, most_bytes), list(HASH), "left")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", given: DataFrame | None = None, least: float = 0.8, most_bytes: int = MOST_BYTES, most_anchors: int = MOST_ANCHORS) -> DataFrame:
    """(id, licenses, best_dice, n_matches): names by comma (empty if none), the highest coefficient (null if none), units that matched.

    given: a table of templates (license, text), or None for those of ``templates()``.
    """
    found = _by_text(find(docs, text_col, given, least, most_bytes, most_anchors))
    rows = _join(docs.select(F.col(id_col), *_hashed(F.col(text_col))), found, most_bytes)
    return rows.select(id_col, F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"), F.col("dice").alias("best_dice"), F.coalesce("units", F.lit(0).cast("long")).alias("n_matches"))


def without_licenses(docs: DataFrame, allowed: set[str], text_col: str = "text", given: DataFrame | None = None, least: float = 0.8, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows all of whose licenses are allowed, with all their columns."""
    found = _by_text(find(docs, text_col, given, least, most_bytes))
    rows = _join(docs.select(F.struct(*docs.columns).alias("_row"), *_hashed(F.col(text_col))), found, most_bytes)
    clear = F.forall("names", lambda name: name.isin(*allowed) if allowed else F.lit(False))
    return rows.where(F.coalesce(clear, F.lit(True))).select("_row.*")

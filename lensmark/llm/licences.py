"""License scans by MinHash bands over overlapping text windows, in DataFrame functions only.

Texts are cut into lower-cased words and these into shingles of five. Windows of shingles overlap by half or more;
a window's minima under some permutations are its bands, one row a band. A template is banded at every offset, in windows
of the widest kind of BANDS of which a text's window lies within any unbroken LEAST of the template, wherever that is set in
the text. Such a window is equal in both, so the two share its bands for certain: all matches of which only the ends are
changed are retrieved. With changes inside, a window of similarity s shares one of h bands with probability 1 - (1 - s)^h, and a
match has many windows. Documents that share a band with a template are then compared on full shingle sets: a match holds LEAST of
the template's shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmark.llm.common import Scratch

SHINGLE, LEAST = 5, 0.8
#: Kinds of windows: width in shingles, step in a text (half the width), and permutations. Short templates can't be changed
#: inside and match, so one permutation does.
BANDS = [(1, 1, 1), (2, 1, 1), (4, 2, 1), (8, 4, 4)]
#: Permutations of 64-bit hashes: exclusive or with these.
_PERMUTE = [0x1B873593CC9E2D51, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x6C8E9CF570932BD5]
#: Above so many documents with candidates, these are joined by shuffle rather than broadcast (about 100 bytes each).
BROADCAST_CANDIDATES = 500_000

# Notices by which texts declare public licenses, as their stewards word them.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT line": "Released under the MIT License.",
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
}


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, r"[\s\p{Punct}]+"), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: as a lambda's variable it can't be inlined where it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(text: Column) -> Column:
    """Shingle hashes in order; empty for texts of fewer than five words."""

    def of(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(SHINGLE))))
        return F.when(F.size(w) >= SHINGLE, hashed).otherwise(F.array().cast("array<bigint>"))

    return let(words(text), of)


def kind_for(n: int) -> int:
    """The widest kind of BANDS for a template of n shingles."""
    whole = math.ceil(LEAST * n - 1e-9)
    return max(i for i, (width, step, _) in enumerate(BANDS) if whole >= width + step - 1)


def bands(s: Column, kind: int, every: bool = False) -> Column:
    """Minima of a kind's windows over shingles s (not null, not empty) under all its permutations, marked by kind, in one array. A
    window is two blocks of ``step`` shingles, so windows overlap by half; every: windows at every offset instead. The last windows,
    and that of a short text, hold what there is."""
    width, step, permutations = BANDS[kind]
    n, block = F.size(s), width if every else step

    def minima(c: int) -> Column:
        c ^= kind * 0x1000193
        if block == 1:
            least = F.transform(s, lambda x: x.bitwiseXOR(F.lit(c)))
        else:
            starts = F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)) if every else n, F.lit(1 if every else step))
            least = F.transform(starts, lambda i: F.array_min(F.transform(F.slice(s, i, block), lambda x: x.bitwiseXOR(F.lit(c)))))
        if block == width:
            return least
        return let(least, lambda m: F.zip_with(m, F.slice(m, F.lit(2), F.size(m)), lambda x, y: F.least(x, y)))

    return F.concat(*map(minima, _PERMUTE[:permutations]))


def _templates(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    own = spark.createDataFrame([(i, *t) for i, t in enumerate(sorted(templates.items()))], "n int, id string, text string")
    own = own.select("n", F.col("id").alias("license"), shingles(F.col("text")).alias("s")).filter(F.size("s") > 0)
    sizes = {r[0] for r in own.select(F.size("s")).distinct().collect()}
    keys = F.coalesce(*(F.when(F.size("s") == n, bands(F.col("s"), kind_for(n), True)) for n in sorted(sizes)), F.array().cast("array<bigint>"))
    return own.select("n", "license", F.array_distinct("s").alias("template"), keys.alias("keys"))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document and license whose template it holds: id, license, n_matched (distinct shingles of the template found),
    containment, and position (of the word, from 1, at which the template's first found shingle first starts).

    Null, empty and short texts hold nothing, very long ones are scanned whole; rows that repeat an id are matched on their own, each
    giving a row; rows of a null id are left out. Templates of fewer than five words never match, of equal ones each does. An empty
    table gives an empty result; other columns are ignored.
    """
    known = _templates(docs.sparkSession, TEMPLATES if templates is None else templates)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).filter("id IS NOT NULL")
    keys = F.broadcast(known.select("n", F.explode("keys").alias("key")).distinct())  # as many as the templates have windows
    cut = let(shingles(F.col("text")), lambda s: F.when(F.size(s) > 0, F.concat(*(bands(s, k) for k in range(len(BANDS))))))
    met = rows.select("id", F.explode(cut).alias("key")).join(keys, "key")
    wanted = Scratch(docs.sparkSession).save(met.groupBy("id").agg(F.collect_set("n").alias("wanted")), "licences")
    few = wanted.count() <= BROADCAST_CANDIDATES
    texts = rows.join(F.broadcast(wanted) if few else wanted, "id")
    each = texts.select("id", shingles(F.col("text")).alias("s"), "wanted").select("id", "s", F.explode("wanted").alias("n"))
    found = each.join(F.broadcast(known.select("n", "license", "template")), "n").withColumn("f", F.array_intersect("template", "s"))
    held = F.size("f") / F.size("template").cast("double")
    out = found.select(F.col("id").alias(id_column), "license", F.size("f").cast("long").alias("n_matched"), held.alias("containment"), F.array_position("s", F.get("f", F.lit(0))).alias("position"))
    return out.filter(F.col("containment") >= LEAST)

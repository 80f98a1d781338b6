"""License scan with MinHash over text windows (operator 7). DataFrame expressions only.

Texts are cut into words, words into 5-word shingles, shingles into overlapping windows of four,
two apart, reaching over both ends of the text, so that every shingle lies in two. A window's
signature has ``bands`` values of one row each: the least of its shingle hashes, mixed anew for each
band. Templates are cut into windows at every offset. Windows that hold no shingle of a template
cannot agree with one and are dropped first, by a bitmap of the templates' shingle hashes. Windows
that agree with a template in some band nominate (document, template). A shared shingle makes a
quarter of each of its windows, so it is missed with probability (3/4)^(2 * bands), about 1e-6 with
24 bands, where all of the window is shared. Templates of up to ``FEW`` shingles have little more
than one to be found by, so any of their shingles nominates them; they are never missed. The
templates' distinct shingles in the full text decide: a match has at least ``percent`` of them.

The windows are rows while they are compared, but hold four hashes and the document's key only.
Templates may be a list or a table of any length. Up to ``MAX_TEMPLATE_WINDOWS`` windows their
signatures and shingles are broadcast; longer lists meet the documents in shuffled joins, each key
dealt to ``SALTS`` tasks, since a frequent notice may lie in a third of all rows. The bitmap has
``BITMAP_BITS`` bits at most (twice that after rounding); with more than ``MAX_BITMAP`` shingles a
join on the shingle takes its place. The result is the same either way. Nominated documents are few;
they are broadcast up to a counted bound and shuffled beyond it.

Cases: null, empty and short texts (under five words) match nothing. Repeated rows are found once
each. Documents without id are scanned like others. An empty table or template list gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .texts import Bitmap, lower_words, once

SHINGLE = 5
WINDOW = 4
STEP = 2
BANDS = 24
#: Templates of so many shingles are nominated by each of them.
FEW = 8
PERCENT = 75
#: Template windows that may be broadcast (bands times 30 bytes each).
MAX_TEMPLATE_WINDOWS = 20_000
#: Distinct template shingles that a bitmap holds, its bits, and bits a shingle.
MAX_BITMAP = 1_000_000
BITMAP_BITS = 1 << 24
SPARE = 2048
#: Tasks that a key of a shuffled join is dealt to.
SALTS = 8
#: Nominations (about 40 bytes each) that may be broadcast.
MAX_BROADCAST = 200_000
SEPARATOR = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"

# Standard notices of public licenses.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 (short)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 (short)": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 (short)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT (short)": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _shingle_hashes(words: Column) -> Column:
    """One hash per 5-word shingle, in order."""
    starts = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(0), F.size(words) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))


def _shingles(words: Column) -> Column:
    starts = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(0), F.size(words) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " ")))


def _windows(hashes: Column, step: int) -> Column:
    """Windows as structs h0 to h3, from the first to the last that holds a shingle; those that
    reach over an end repeat the shingle there."""
    last = F.size(hashes) - 1
    starts = F.when(last >= 0, F.sequence(F.lit(step - WINDOW), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(*[F.get(hashes, F.greatest(F.least(s + k, last), F.lit(0))).alias(f"h{k}") for k in range(WINDOW)]))


def _signature(bands: int) -> list[Column]:
    return [F.least(*[F.xxhash64(F.col(f"h{k}"), F.lit(b)) for k in range(WINDOW)]) for b in range(bands)]


def _beside(rows: DataFrame, listed: DataFrame, key: list[str], few: bool) -> DataFrame:
    """Rows (with id and fp) beside what the templates have for their key: sent to each task if that is
    little, else shuffled in ``SALTS`` shares a key."""
    if few:
        return rows.join(F.broadcast(listed), key)
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id", "fp"), F.lit(SALTS)))
    every = listed.withColumn("salt", F.explode(F.array(*[F.lit(s).cast("long") for s in range(SALTS)])))
    return dealt.join(every, [*key, "salt"]).drop("salt")


def _holding(tiles: DataFrame, hashes: DataFrame, max_bitmap: int) -> DataFrame:
    """The windows that hold a shingle of a template."""
    parts = [F.col(f"h{k}") for k in range(WINDOW)]
    known = [r.h for r in hashes.limit(max_bitmap + 1).collect()]
    if len(known) <= max_bitmap:
        shingles = Bitmap(known, max(16, min(SPARE, BITMAP_BITS // max(1, len(known)))))
        return tiles.where(reduce(Column.__or__, [shingles.holds(h) for h in parts]))
    window = F.struct(*parts).alias("x")
    each = tiles.select("id", "fp", window, F.explode(F.array_distinct(F.array(*parts))).alias("h"))
    return _beside(each, hashes, ["h"], False).select("id", "fp", "x").distinct().select("id", "fp", "x.*")


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] | DataFrame = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, percent: int = PERCENT, max_windows: int = MAX_TEMPLATE_WINDOWS, max_bitmap: int = MAX_BITMAP) -> DataFrame:
    """One row per document and template that it holds: id, ``license``, ``n_shared`` and
    ``n_template`` (distinct shingles), ``containment``. Templates: notices by name, or a table of
    ``license`` and ``notice``, a row a name."""
    spark = docs.sparkSession
    listed = templates.select("license", "notice") if isinstance(templates, DataFrame) else spark.createDataFrame([(k, v) for k, v in sorted(templates.items())], "license string, notice string")
    names = listed.select("license", once(lower_words(F.col("notice"), SEPARATOR)).alias("w"))
    cut = names.select("license", once(_shingle_hashes(F.col("w"))).alias("h")).select("license", F.explode(_windows(F.col("h"), 1)).alias("x")).select("license", "x.*")
    signed = cut.select("license", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), v.alias("value")) for b, v in enumerate(_signature(bands))])).alias("s")).select("license", "s.*").distinct()
    short_list = signed.limit(max_windows * bands + 1).count() <= max_windows * bands
    if not short_list:
        signed = materialise(signed, "license-signatures")
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("fp", F.xxhash64("text"))
    tiles = source.select("id", "fp", once(lower_words(F.col("text"), SEPARATOR)).alias("w")).select("id", "fp", once(_shingle_hashes(F.col("w"))).alias("h")).select("id", "fp", once(_windows(F.col("h"), STEP)).alias("t")).select("id", "fp", F.explode("t").alias("x")).select("id", "fp", "x.*")
    hashes = names.select("license", F.explode(F.array_distinct(_shingle_hashes(F.col("w")))).alias("h"))
    parts = [F.col(f"h{k}") for k in range(WINDOW)]
    near = materialise(_holding(tiles, hashes.select("h").distinct(), max_bitmap), "license-windows")
    signature = near.select("id", "fp", F.posexplode(F.array(*_signature(bands))).alias("band", "value"))
    by_band = _beside(signature, signed, ["band", "value"], short_list).select("id", "fp", "license")
    short = hashes.groupBy("license").agg(F.collect_set("h").alias("hs")).where(F.size("hs") <= FEW).select("license", F.explode("hs").alias("h"))
    by_shingle = near.select("id", "fp", F.explode(F.array(*parts)).alias("h"))
    by_shingle = _beside(by_shingle, short, ["h"], short_list).select("id", "fp", "license")
    nominated = by_band.unionByName(by_shingle).distinct().groupBy("id", "fp").agg(F.collect_set("license").alias("licenses"))
    nominated = materialise(nominated, "license-nominated").select(F.col("id").alias("nid"), F.col("fp").alias("nfp"), "licenses")
    few = nominated.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    joined = source.join(F.broadcast(nominated) if few else nominated, F.col("id").eqNullSafe(F.col("nid")) & (F.col("fp") == F.col("nfp")))
    held = joined.select("id", "fp", "licenses", once(lower_words(F.col("text"), SEPARATOR)).alias("w")).select("id", "fp", "licenses", once(_shingles(F.col("w"))).alias("own"))
    wanted = names.select(F.col("license"), once(_shingles(F.col("w"))).alias("needed"))
    pairs = _beside(held.select("id", "fp", "own", F.explode("licenses").alias("license")), wanted, ["license"], short_list)
    counted = pairs.select(F.col("id").alias(id_col), "license", F.size(F.array_intersect("own", "needed")).cast("long").alias("n_shared"), F.size("needed").cast("long").alias("n_template"))
    matched = counted.where(100 * F.col("n_shared") >= percent * F.col("n_template"))
    return matched.withColumn("containment", F.col("n_shared") / F.col("n_template"))

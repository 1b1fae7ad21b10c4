"""License scans, in DataFrame operations only: MinHash bands over text windows retrieve templates, exact shingles verify.

Words are the lower-cased runs of letters and digits; a shingle is five of them.

1. Shingles. A window can share a minimum with a template only if it holds one of the templates' shingles, so the
   positions of those (by hash, one look-up each) are found first. Most texts have none and end here.
2. Retrieval. Templates are cut into windows of ``WINDOW`` shingles, or of the largest power of two that fits a shorter template,
   one at every word; texts into windows of the same sizes, one at every half window (over positions with a shingle). Each has
   ``BANDS`` bands of one minimum, by hashes that are independent of each other. An equal window collides for certain; one that shares
   half of its shingles (Jaccard 1/3) with a probability of 1 - (2/3) ** BANDS, over 0.998, and a passage has several windows.
   A text that holds 4/5 of a long template has an unchanged window, since every changed word breaks five shingles.
3. Verification. Of each template retrieved, the share of its distinct shingles, as texts, that the whole document holds is
   compared with ``threshold``.

At scale: one pass over the texts without a shuffle; a shuffle of the matches only, by (doc_id, license_id). The template list is an
argument: its shingle hashes are one literal of 8 bytes each; its window keys and its shingles are broadcast only if the list is small (``BROADCAST_KEYS``).

Defined cases: a null text, and one of under five words, has no hit; repeated rows (equal doc_id) give one
row, with the best share; rows with a null doc_id are reported each; a text of any length is scanned whole (its words and their hashes are
one row's arrays); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

BANDS, WINDOW, SHINGLE, BROADCAST_KEYS = 16, 8, 5, 200_000

# Notices and passages of public licenses.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause-line": "Released under the BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def template_words(text: str) -> list[str]:
    """Words by the same rule as for texts."""
    return [w for w in re.split(r"[^\w]|_", text.lower()) if w]


def window_size(shingles: int) -> int:
    """Shingles in a window of a template of so many."""
    return min(WINDOW, 1 << (shingles.bit_length() - 1))


def _held(expression: str) -> str:
    """The expression as a value worked out once for a row: the optimizer moves no such column into lambdas or filters."""
    return f"if(spark_partition_id() >= 0, {expression}, null)"


def _hashes(words: str) -> str:
    return f"if(size({words}) < {SHINGLE}, cast(array() as array<bigint>), transform(sequence(0, greatest(size({words}), {SHINGLE}) - {SHINGLE}), i -> xxhash64({', '.join(f'get({words}, i + {k})' for k in range(SHINGLE))})))"


def minima(window: str) -> str:
    """The minimum of each band over an array of shingle hashes. A shingle's hash for band j is that of (shingle, j)."""
    return f"array({', '.join(f'array_min(transform({window}, x -> xxhash64(x, {j})))' for j in range(BANDS))})"


def _windows(rows: DataFrame, names: list[str], starts: str) -> DataFrame:
    """(names, size, at, band, key) of the windows of h (of ``size`` shingles, or of all if there are fewer) at ``starts``."""
    placed = rows.select(*names, "size", "h", F.explode(F.expr(starts)).alias("at"))
    keyed = placed.select(*names, "size", "at", F.expr(minima("slice(h, at + 1, size)")).alias("m"))
    return keyed.select(*names, "size", "at", F.posexplode("m").alias("band", "key"))


def template_keys(spark, templates: dict[str, str]) -> tuple[DataFrame, DataFrame, list[int]]:
    """(size, band, key, license_id) rows of all template windows, (license_id, shingles) rows, and the hashes of all shingles."""
    words = {name: template_words(text) for name, text in templates.items()}
    if any(len(w) < SHINGLE for w in words.values()):
        raise ValueError("a template needs five words at least")
    rows = [(n, w, sorted({" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}), window_size(len(w) - SHINGLE + 1)) for n, w in words.items()]
    base = spark.createDataFrame(rows, "license_id string, w array<string>, shingles array<string>, size int").withColumn("h", F.expr(_hashes("w")))
    keys = _windows(base, ["license_id"], "sequence(0, greatest(size(h) - size, 0))").select("size", "band", "key", "license_id").distinct()
    held, hashes = keys.collect(), {x for r in base.select("h").collect() for x in r["h"]}  # as many as the templates have windows and shingles
    small = F.broadcast if len(held) <= BROADCAST_KEYS else lambda df: df
    return small(spark.createDataFrame(held, keys.schema)), small(base.select("license_id", "shingles")), sorted(hashes)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id, license_id, containment, at_word: the templates each document of (doc_id, text) holds to ``threshold`` or more.

    containment is the share of the template's distinct shingles that the document has, at_word where its first window that met the template begins.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    if not templates:
        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit("").alias("license_id"), F.lit(0.0).alias("containment"), F.lit(0).cast("bigint").alias("at_word")).limit(0)
    table, shingles, hashes = template_keys(spark, templates)
    sizes = sorted({window_size(len(template_words(t)) - SHINGLE + 1) for t in templates.values()})
    words = _held(r"filter(split(lower(coalesce(cast(text as string), '')), '[^\\p{L}\\p{N}]+'), w -> w <> '')")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.expr(words).alias("w"))
    rows = rows.select("doc_id", "w", F.expr(_held(_hashes("w"))).alias("h"))
    known = f"array({', '.join(f'{x}L' for x in hashes)})"
    met = rows.where(F.expr(f"arrays_overlap(h, {known})"))
    at = f"filter(sequence(0, size(h) - 1), i -> get(h, i) in ({', '.join(f'{x}L' for x in hashes)}))"
    met = met.select("doc_id", "w", "h", F.expr(_held(at)).alias("hits"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("nth"))
    held = f"array_distinct(transform(hits, i -> concat_ws(' ', slice(w, i + 1, {SHINGLE}))))"
    met = met.select("doc_id", "nth", "h", "hits", F.expr(_held(held)).alias("held"), F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"))
    # Windows begin at every half window, and the last one ends with the text; those that cover a hit are wanted.
    step = "greatest(size div 2, 1)"
    covering = f"sequence(greatest(0, (i - size + {step}) div {step}) * {step}, (i div {step}) * {step}, {step})"
    starts = f"array_distinct(transform(flatten(transform(hits, i -> {covering})), s -> least(s, greatest(size(h) - size, 0))))"
    found = _windows(met, ["doc_id", "nth", "held"], starts).join(table, ["size", "band", "key"])
    pairs = found.select("doc_id", "nth", "held", "at", "license_id").join(shingles, "license_id").withColumn("containment", F.size(F.array_intersect("shingles", "held")) / F.size("shingles")).where(F.col("containment") >= threshold)
    best = pairs.groupBy("doc_id", "nth", "license_id").agg(F.max("containment").alias("containment"), F.min("at").cast("bigint").alias("at_word"))
    return best.select("doc_id", "license_id", "containment", "at_word")

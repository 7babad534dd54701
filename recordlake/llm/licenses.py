"""License scan: MinHash bands over text windows retrieve templates, exact containment verifies.

Words are the runs of a-z and 0-9 of the lower-cased text; a shingle is five words.
A template of m shingles belongs to the window width W (a power of two) that holds it
wherever it starts, windows starting every W/4 shingles.  A window that contains a
share s of the template has a Jaccard similarity of at least
j = s m / (W + m - s m) with it; every band is one MinHash value, and a width has so
many bands that a match goes unseen with a probability of at most ``miss``.

A window's value in a band is the template's if it holds the template's smallest shingle
of this band and nothing smaller.  So only windows around those few shingles are looked
at, inside the row of their text: nothing is exploded, shuffled or written.

Contract of edge cases: null and empty texts, and those of under five words, match
nothing; a text is scanned whole; of windows that match a template equally well the
first one counts; repeated rows are scanned one by one and each has its rows; an
empty table has no matches; only the id and text columns are read.  A template of
under five words cannot be found and is an error.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stages import fence

SHINGLE = 5

# Notices as their publishers word them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "cc-by-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
}


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_shingles(text: str) -> list[str]:
    words = template_words(text)
    if len(words) < SHINGLE:
        raise ValueError("a template needs at least five words")
    return sorted({" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)})


def needed(m: int, containment: float) -> int:
    """How many of m shingles make a match."""
    return max(1, math.ceil(containment * m - 1e-9))


def window_width(m: int) -> int:
    width = 1
    while width < m + max(1, width // 4) - 1:
        width *= 2
    return width


def window_step(width: int) -> int:
    return max(1, width // 4)


def bands_for(sizes: list[int], width: int, containment: float, miss: float) -> int:
    """Bands so that the least similar match of these template sizes is seen but with probability ``miss``."""
    least = min(needed(m, containment) / (width + m - needed(m, containment)) for m in sizes)
    return 1 if least >= 1 else math.ceil(math.log(miss) / math.log(1 - least))


def marker_words(text: str, containment: float) -> list[str]:
    """Words of which every match of the template contains at least one.

    Long words first, until more shingles hold one of them than a match may lack.
    """
    shingles = [set(s.split()) for s in template_shingles(text)]
    spare = len(shingles) - needed(len(shingles), containment)
    chosen: list[str] = []
    for word in sorted(set(template_words(text)), key=lambda w: (-len(w), w)):
        if sum(1 for s in shingles if s & set(chosen)) > spare:
            break
        chosen.append(word)
    return chosen


def _template_array(spark: SparkSession, templates: dict[str, str], containment: float, miss: float) -> tuple[str, list[int]]:
    """SQL of an array with all templates, and the shingles that are smallest in any band.

    The driver reads one row for each template and band.
    """
    shingles = {name: template_shingles(body) for name, body in templates.items()}
    widths = {name: window_width(len(all_)) for name, all_ in shingles.items()}
    bands = {}
    for width in set(widths.values()):
        names = [n for n in shingles if widths[n] == width]
        bands[width] = bands_for([len(shingles[n]) for n in names], width, containment, miss)
    rows = ", ".join(
        f"({i}, {bands[widths[name]]}, '{gram}')" for i, (name, all_) in enumerate(shingles.items()) for gram in all_
    )
    minima = spark.sql(
        f"""
        WITH known AS (SELECT i, bands, xxhash64(gram) AS gram FROM VALUES {rows} AS t(i, bands, gram)),
        valued AS (SELECT i, gram, band, xxhash64(gram, band) AS value FROM known LATERAL VIEW explode(sequence(0, bands - 1)) b AS band),
        least AS (SELECT i, array_sort(collect_list(low)) AS lows FROM (SELECT i, struct(band, min(struct(value, gram)) AS at) AS low FROM valued GROUP BY i, band) GROUP BY i)
        SELECT i, lows, grams FROM least JOIN (SELECT i, collect_list(gram) AS grams FROM known GROUP BY i) USING (i)
        """
    ).collect()
    by_number = {r["i"]: r for r in minima}
    structs, smallest = [], set()
    for i, (name, all_) in enumerate(shingles.items()):
        row = by_number[i]
        lows = [(x["band"], x["at"]["gram"], x["at"]["value"]) for x in row["lows"]]
        smallest |= {gram for _, gram, _ in lows}
        low_array = ", ".join(f"struct({b} AS band, {g}L AS gram, {v}L AS value)" for b, g, v in lows)
        structs.append(
            f"struct('{name}' AS license_id, {len(all_)}L AS n_shingles, {needed(len(all_), containment)} AS needed, "
            f"{widths[name]} AS width, {window_step(widths[name])} AS step, "
            f"array({', '.join(f'{g}L' for g in row['grams'])}) AS grams, array({low_array}) AS lows)"
        )
    return f"array({', '.join(structs)})", sorted(smallest)


def license_scan(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    containment: float = 0.8,
    miss: float = 1e-6,
) -> DataFrame:
    """One row for each document and template found in it: doc_id, license_id, n_shingles, n_matched, first_shingle.

    ``n_matched`` is the most shingles of the template in one window and
    ``first_shingle`` that window's start.  Texts without any marker word of any
    template cannot match and are left out before the shingles are made; this loses
    nothing.  A narrow step of plain SQL.
    """
    array, smallest = _template_array(docs.sparkSession, templates, containment, miss)
    markers = sorted({w for body in templates.values() for w in marker_words(body, containment)})
    # A marker that contains another one is found by that.
    markers = [w for w in markers if not any(o != w and o in w for o in markers)]
    spoken = " OR ".join(f"contains(__lower, '{w}')" for w in markers)
    words = "filter(split(__lower, '[^a-z0-9]+', -1), w -> w <> '')"
    grams = (
        "IF(size(__words) < 5, array(), transform(sequence(1, greatest(size(__words) - 4, 1)), "
        "i -> xxhash64(array_join(slice(__words, i, 5), ' '))))"
    )
    seeds = (
        "IF(size(__grams) = 0, array(), filter(sequence(0, greatest(size(__grams) - 1, 0)), "
        f"i -> __grams[i] IN ({', '.join(f'{g}L' for g in smallest)})))"
    )
    # Numbers of a template's windows that hold one of its smallest shingles.
    around = (
        "array_distinct(flatten(transform(filter(__seeds, p -> exists(t.lows, b -> b.gram = __grams[p])), "
        "p -> sequence(CAST(greatest(0, (p - t.width + t.step) DIV t.step) AS INT), CAST(p DIV t.step AS INT)))))"
    )
    window = "slice(__grams, w * t.step + 1, t.width)"
    collides = (
        f"exists(t.lows, b -> array_contains({window}, b.gram) "
        f"AND NOT exists({window}, g -> xxhash64(g, b.band) < b.value))"
    )
    counted = f"transform(filter({around}, w -> {collides}), w -> struct(size(array_intersect({window}, t.grams)) AS n, -w * t.step AS back))"
    found = (
        docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text).cast("string")).alias("__lower"))
        .filter(spoken)
        .select("doc_id", F.expr(words).alias("__words"))
        .select("doc_id", F.expr(grams).alias("__grams"))
    )
    # Arrays are computed once: the row passes a generator, which later projections do not cross.
    seeded = fence(found).withColumn("__seeds", F.expr(seeds))
    seeded = fence(seeded).filter("size(__seeds) > 0")
    best = f"transform({array}, t -> struct(t.license_id, t.n_shingles, t.needed, array_max({counted}) AS best))"
    rows = seeded.select("doc_id", F.inline(F.expr(f"filter({best}, f -> f.best.n >= f.needed)")))
    return rows.select(
        "doc_id",
        "license_id",
        "n_shingles",
        F.col("best.n").cast("long").alias("n_matched"),
        (-F.col("best.back")).cast("long").alias("first_shingle"),
    )

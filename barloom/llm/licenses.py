"""License scan in DataFrame functions: MinHash bands retrieve templates, containment confirms them.

A template of n words is sought in windows of a size class of about n words; windows overlap so that each
run of n words lies whole in one.  A window that holds at least ``threshold`` of a template's shingles has
a Jaccard similarity of at least J = threshold * |T| / (|W| + (1 - threshold) * |T|) with it; bands of one
minimum each, ``bands(J)`` of them, share a value with probability 1 - (1 - J)**bands >= 1 - miss.  Only
windows around a shingle of some template are formed: others have containment 0.  Retrieved pairs are
confirmed by exact containment of the template's shingles in the window.

Templates are a dictionary of fixed size; their shingles and bands are broadcast.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
THRESHOLD = 0.8
MISS = 1e-4
#: fixed values: opening statements and grants of public licenses
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-terms": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-licensed": "This project is licensed under the MIT License",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "BSD-3-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "AGPL-header": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
}
_WORD = r"[\p{L}\p{N}]+"


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def shape(n: int) -> tuple[int, int]:
    """(stride, shingles in a window) for templates of at most n words: windows hold n + n // 4 + stride - 1 words."""
    stride = max(1, n // 4)
    return stride, n + n // 4 + stride - 1 - SHINGLE + 1


def classes(templates: dict[str, str]) -> dict[str, int]:
    """The window class of each template: its number of words, rounded up to 8, 12, 18, 27, ..."""
    out = {}
    for name, text in templates.items():
        n, size = len(words_of(text)), 8
        if n < SHINGLE:
            raise ValueError(f"a template needs {SHINGLE} words: {name}")
        while size < n:
            size = size * 3 // 2
        out[name] = size
    return out


def bands(n_template: int, size: int, threshold: float, miss: float) -> int:
    """Bands of one minimum that retrieve a window of the class at the threshold with probability 1 - miss."""
    own = n_template - SHINGLE + 1
    similar = threshold * own / (shape(size)[1] + (1 - threshold) * own)
    return math.ceil(math.log(miss) / math.log(1 - similar))


def anchors(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every text with a match holds at least one.

    Leaving out all of a template's anchors breaks more than 1 - threshold of its shingles.
    """
    chosen: list[str] = []
    for text in templates.values():
        words = words_of(text)
        distinct = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        broken = lambda picked: len({t for t in distinct if set(t) & picked})
        picked = set(chosen) & set(words)
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            if broken(picked) > (1 - threshold) * len(distinct):
                break
            picked.add(w)
        chosen += sorted(picked - set(chosen))
    return chosen


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shingles(words: Column) -> Column:
    """Hashes of all shingles in order; empty for fewer words."""

    def made(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
        return F.when(F.size(w) >= SHINGLE, hashed).otherwise(F.array().cast("array<long>"))

    return _let(words, made)


def _minima(shingles: Column, count: Column) -> Column:
    """The keys of ``count`` bands: each a minimum of the shingles under the band's own permutation."""
    return F.transform(F.sequence(F.lit(1), count), lambda b: F.xxhash64(b, F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b)))))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """Per document and template found: doc_id, license, containment, word (first word of the best window).

    Null and empty texts and texts of fewer than SHINGLE words hold nothing, very long ones are searched whole; a null
    doc_id is reported as null; rows that share a doc_id report once per template, with the best containment, and of
    equal ones the first window.  Templates that resemble one another, such as headers of two versions, are reported
    each with their own containment.  Other columns are ignored.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    size_of = classes(templates)
    rows = [(name, size_of[name], words_of(text)) for name, text in templates.items()]
    lines = [F.struct(F.lit(n).alias("license"), F.lit(c).alias("class"), F.array(*[F.lit(x) for x in w]).alias("words")) for n, c, w in rows]
    known = spark.range(1).select(F.inline(F.array(*lines)))
    known = known.select("license", "class", F.array_distinct(_shingles(F.col("words"))).alias("own"))
    widest = {c: max(bands(len(w), c, threshold, miss) for _, d, w in rows if d == c) for c in set(size_of.values())}

    lower = F.lower(F.col("text").cast("string"))
    may = None
    for word in anchors(templates, threshold):
        may = lower.contains(word) if may is None else may | lower.contains(word)
    vocabulary = F.array(*[F.lit(x) for x in sorted({s for r in known.collect() for s in r["own"]})])  # fixed by the templates
    sizes = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(shape(c)[0]).alias("stride"), F.lit(shape(c)[1]).alias("wide"), F.lit(n).alias("bands")) for c, n in sorted(widest.items())])

    def marked(shingles: Column) -> Column:
        spots = F.filter(F.sequence(F.lit(0), F.size(shingles) - 1), lambda i: F.array_contains(vocabulary, F.get(shingles, i)))
        return F.named_struct(F.lit("shingles"), shingles, F.lit("spots"), F.when(F.size(shingles) > 0, spots).otherwise(F.array().cast("array<int>")))

    # generators, not filters, drop documents without a spot: a filter would be pushed below and compute the arrays again
    words = F.regexp_extract_all(lower, F.lit(_WORD), F.lit(0))
    texts = docs.where(may).select("doc_id", _let(_shingles(words), marked).alias("held"), F.explode(sizes).alias("size"))
    starts = F.array_distinct(F.flatten(F.transform(
        F.col("held.spots"),
        lambda p: F.transform(F.sequence(F.greatest(F.lit(0), F.ceil((p - F.col("size.wide") + 1) / F.col("size.stride")).cast("int")), F.floor(p / F.col("size.stride")).cast("int")), lambda w: w * F.col("size.stride")),
    )))
    cut = texts.select("doc_id", "held", "size", F.explode(starts).alias("at"))
    cut = cut.select("doc_id", "at", "size.class", "size.bands", F.array_distinct(F.slice("held.shingles", F.col("at") + 1, F.col("size.wide"))).alias("window"))
    probe = cut.select("doc_id", "at", "class", "window", _minima(F.col("window"), F.col("bands")).alias("keys"))
    counts = F.create_map(*[x for c, n in sorted(widest.items()) for x in (F.lit(c), F.lit(n))])
    own = known.select("license", F.col("class").alias("own_class"), "own", _minima(F.col("own"), F.element_at(counts, F.col("class"))).alias("own_keys"))
    # a window meets a template of its class once if any of their bands agree
    met = probe.join(F.broadcast(own), (F.col("class") == F.col("own_class")) & F.arrays_overlap("keys", "own_keys"))
    met = met.select("doc_id", "at", "license", (F.size(F.array_intersect("window", "own")) / F.size("own")).alias("containment"))
    best = met.groupBy("doc_id", "license").agg(F.max(F.struct("containment", (-F.col("at")).alias("at"))).alias("best"))
    best = best.where(F.col("best.containment") >= threshold)
    return best.select("doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.at")).cast("long").alias("word"))

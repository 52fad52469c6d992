"""License scans: MinHash bands over overlapping windows, then exact containment.

All of it is DataFrame expressions. A text's words (runs of a-z and 0-9 after
lower-casing) give the hashes of its ``WORDS``-word shingles. Windows of shingles come
in sizes that double, at half-size steps, so that every template lies whole in some
window of two to four times its size (or of the text's). Each window has ``BANDS``
min-hashes, one row to a band. A window is less than 4 times a template, so one that holds
0.8 of it has a Jaccard similarity of more than 0.8 / 4.2 = 0.19 with it, and the chance
that no band agrees is below 0.81 ** 64, about one in 700,000; where the window is twice
the template, it is below 10 ** -12. Windows and templates that agree in a band are
verified by exact containment.

A band can only agree on a shingle that the window and a template share, so texts and
windows without any template shingle are left out before hashing; this loses nothing.

Defined results: one row for each (doc_id, license) with its best window, ties to the
first; null and empty texts and texts shorter than a template have no match; rows
that repeat a doc_id are reported together; a null doc_id is reported as null;
other columns are ignored; no rows, no results. A text's words must fit one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
BANDS = 64
CONTAINED = 0.8

#: Notices and grants by which public licenses are declared.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Apache-2.0-grant": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: Column) -> Column:
    """Hashes of the word n-grams of a text, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")

    def hashed(w: Column) -> Column:
        at = F.when(F.size(w) >= WORDS, F.sequence(F.lit(0), F.size(w) - WORDS)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(WORDS))))

    return bound(words, hashed)


def _seeded(band: int):
    return lambda s: F.xxhash64(s, F.lit(band))


def min_hashes(window: Column) -> Column:
    def each(w: Column) -> Column:
        return F.array(*(F.array_min(F.transform(w, _seeded(b))) for b in range(BANDS)))

    return bound(window, each)


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, parts, size, window) of each template of a shingle at least."""
    rows = F.array(*(F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in templates.items()))
    made = spark.range(1).select(F.explode(rows).alias("t")).select("t.license", F.array_distinct(shingles(F.col("t.text"))).alias("parts"))
    return made.where(F.size("parts") > 0).withColumn("size", F.size("parts"))


def _steps(n: Column, size: int) -> Column:
    """(at, w) of the windows of a size over ``n`` shingles."""
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size // 2)), lambda a: F.struct(a.alias("at"), F.lit(size).alias("w")))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text", doc_id: str = "doc_id", least: float = CONTAINED) -> DataFrame:
    """(doc_id, license, containment, first_word, last_word) of every license that a document holds."""
    spark = docs.sparkSession
    known = template_table(spark, templates)
    listed = known.collect()  # the templates, a fixed list
    parts = F.array(*(F.lit(x) for x in sorted({p for r in listed for p in r.parts})))
    sizes = sorted({1 << (2 * r.size - 1).bit_length() for r in listed})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), shingles(F.col(text)).alias("s"))
    near = rows.where(F.arrays_overlap("s", parts))
    steps = F.flatten(F.array(*(_steps(F.size("s"), w) for w in sizes)))
    windows = near.select("doc_id", "s", F.explode(steps).alias("x")).select("doc_id", F.col("x.at").alias("at"), F.col("x.w").alias("w"), F.slice("s", F.col("x.at") + 1, F.col("x.w")).alias("window"))
    held = windows.where(F.arrays_overlap("window", parts)).withColumn("hashes", min_hashes(F.col("window")))

    bands = held.select("doc_id", "at", "w", "window", F.posexplode("hashes").alias("band", "h"))
    keys = known.select("license", "parts", F.posexplode(min_hashes(F.col("parts"))).alias("band", "h"))
    found = bands.join(F.broadcast(keys), ["band", "h"])  # a fixed list of templates, BANDS rows each
    shared = F.array_intersect("window", "parts")
    # The verdict on a window is the same in every band, so bands need no distinct before it.
    exact = found.select("doc_id", "license", "at", (F.size(shared) / F.size("parts")).alias("containment"), F.transform(shared, lambda p: F.array_position("window", p)).alias("where"))
    good = exact.where(F.col("containment") >= least).select(
        "doc_id", "license", "containment",
        (F.col("at") + F.array_min("where") - 1).cast("long").alias("first_word"),
        (F.col("at") + F.array_max("where") + WORDS - 2).cast("long").alias("last_word"),
    )
    best = good.groupBy("doc_id", "license").agg(F.min(F.struct((-F.col("containment")).alias("c"), "first_word", "last_word")).alias("b"))
    return best.select("doc_id", "license", (-F.col("b.c")).alias("containment"), "b.first_word", "b.last_word")


def brute_force(docs: list[tuple[int, str | None]], templates: dict[str, str] = TEMPLATES, least: float = CONTAINED) -> set[tuple[int, str]]:
    """(doc_id, license) that must be found: 0.8 of a template in some stretch of half a window, at any word; for tests."""
    import re

    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    grams = lambda w: [tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)]
    out = set()
    for name, template in templates.items():
        t = set(grams(words(template)))
        half = 1 << (2 * len(t) - 1).bit_length() >> 1
        for doc, text in docs:
            g = grams(words(text))
            if t and any(len(t & set(g[a : a + half])) >= least * len(t) for a in range(max(len(g) - half, 0) + 1)):
                out.add((doc, name))
    return out

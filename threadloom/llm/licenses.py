"""License scans: MinHash bands over overlapping text windows, verified by exact shingle containment.

Words are lower-cased runs of letters and digits; shingles are five words.  A text's shingles are cut into overlapping
windows, a template's into the windows of the same size at every place.  The MinHash of a window has one hash per
band, so two windows with Jaccard similarity s share a band with probability 1 - (1 - s)^bands: with 32 bands and a
window that holds a template of one shingle among others, or four fifths of a template window, that is
`collision_probability`.  Shared bands retrieve templates, which are then compared shingle by shingle: the share of the
template's shingles that the whole text holds, wherever they stand, must reach the threshold.

A text's shingles that some template has are kept once, at most as many as the templates have.  A text without one
cannot reach any threshold and has no windows made; this looks at every shingle and loses nothing.  All steps are expressions over the rows; texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.scratch import stage_table

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
WINDOW = 4  # shingles of a window
STRIDE = 2  # shingles from one window to the next
BANDS = 32
MOST_TEMPLATE_WORDS = 20_000  # of all templates: they are broadcast, and their shingles are a constant of the plan

#: Names and texts of licence notices; a parameter, any list of (name, text) will do.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]


def collision_probability(similarity: float, bands: int = BANDS) -> float:
    return 1 - (1 - similarity) ** bands


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: str, size: int = SHINGLE_WORDS) -> Column:
    """Hashes of `size` words at every place; of all words, where there are fewer."""
    whole = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
    )
    return F.when(F.size(words) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def _windows(shingles: str, size: int, stride: int) -> Column:
    """(start, hashes) every `stride` shingles, the last one ending with the text."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(shingles) - size + stride - 1, F.lit(0)), F.lit(stride))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice(shingles, i + 1, size).alias("hashes")))


def _bands(hashes: Column, bands: int) -> Column:
    """The least value of every band's hash function over the window's shingles, with the band's number."""
    return F.array(*[F.struct(F.lit(b).alias("band"), F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(b)))).alias("least")) for b in range(bands)])


def template_frame(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """template (number), license, words, shingles (distinct hashes) of every template with five words or more."""
    if sum(len(text.split()) for _, text in templates) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates hold more than {MOST_TEMPLATE_WORDS} words; scan with one part of them after another")
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, template_text string")
    worded = rows.select("template", "license", _words(F.col("template_text")).alias("words")).filter(F.size("words") >= SHINGLE_WORDS)
    return worded.withColumn("shingles", _shingles("words"))


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    containment: float = CONTAINMENT,
    window: int = WINDOW,
    stride: int = STRIDE,
    bands: int = BANDS,
) -> DataFrame:
    """doc_id, license, template, containment (best) and start (word number of the first window that retrieves it) of every
    match.

    Takes doc_id and text of `docs`; other columns are not read.  Texts that are NULL, empty or without a match give no
    row; of rows with the same doc_id the best counts; a NULL doc_id stays NULL.  Templates of under five words are left
    out.  Empty documents or templates give no rows.
    """
    spark = docs.sparkSession
    known = stage_table(template_frame(spark, templates), "templates")
    hashes = sorted({h for row in known.select("shingles").collect() for h in row["shingles"]})  # bounded by MOST_TEMPLATE_WORDS
    constant = F.split(F.lit(",".join(map(str, hashes))), ",") if hashes else F.array()
    constant = constant.cast("array<bigint>")
    worded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _words(F.col("text")).alias("words"))
    shingled = worded.select("doc_id", _shingles("words").alias("shingles"))
    held = shingled.select("doc_id", "shingles", F.array_sort(F.array_intersect("shingles", constant)).alias("found"))
    near = F.when(F.size("found") > 0, F.transform(_windows("shingles", window, stride), lambda w: w.withField("found", F.col("found"))))
    # explode_outer: a filter on what is exploded would work out the shingles twice
    windows = held.select("doc_id", F.explode_outer(near).alias("w")).filter("w is not null")
    banded = windows.select("doc_id", "w.start", "w.found", F.explode(_bands(F.col("w.hashes"), bands)).alias("key"))
    index = known.select("template", F.explode(_windows("shingles", window, 1)).alias("w"))
    index = index.select("template", F.explode(_bands(F.col("w.hashes"), bands)).alias("key")).distinct()
    retrieved = banded.join(F.broadcast(index), "key").groupBy("doc_id", "template", "found").agg(F.min("start").alias("start"))
    compared = retrieved.join(F.broadcast(known.select("template", "license", "shingles")), "template").withColumn(
        "containment", F.size(F.array_intersect("shingles", "found")) / F.size(F.array_distinct("shingles"))
    )
    found = compared.filter(F.col("containment") >= containment)
    return found.groupBy("doc_id", "license", "template").agg(F.max("containment").alias("containment"), F.min("start").cast("long").alias("start"))

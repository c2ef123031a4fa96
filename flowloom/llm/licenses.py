"""Licence scan with DataFrame functions only: TF-IDF cosine to templates, then nearest-ancestor inheritance.

Every line and sentence of every file is a header candidate, and every sentence that runs over several lines of a paragraph
too, with the marks of comments left out; it is compared with the templates by the cosine of TF-IDF
vectors. Inverse document frequencies of the templates' words come from all candidates of the corpus; a word that no
template has weighs as much as the rarest. A file's licence is its best candidate's; a mere notice of rights counts only where no
licence is named. A file without one takes the
licence of the nearest directory above it (or its own) that holds a licence file.

Edge cases: null and empty texts have no candidates; a null path has no directory, so nothing is inherited. Ties go to
the alphabetically first licence. Of several licence files in a directory the best cosine counts. Repeated rows are
judged alike. Empty tables give empty ones. Only the named columns are read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import narrow, quoted, saved
from flowloom.llm.text import normalized

COSINE = 0.6
#: Names of files whose licence holds for their directory.
LICENSE_FILE = r"(?i)^(licen[sc]e|copying)([.-].*)?$"
#: Opening sentences of well-known licences: fixed values.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0"],
    "GPL": ["You can redistribute it and/or modify it under the terms of the GNU General Public License", "Released under the GNU General Public License"],
    "GPL-2.0": ["You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version", "This work is licensed under the GNU General Public License, version 2"],
    "GPL-3.0": ["You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version", "This work is licensed under the GNU General Public License, version 3"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "Proprietary": ["All rights reserved"],
}
#: Notices that lose to any licence.
GENERIC = ("Proprietary",)
#: Ends of a line or sentence, and of a paragraph or sentence.
LINE, PARAGRAPH = r"\n|(?<=[.!?;|])\s+", r"\n[^\p{L}\p{N}\n]*\n|(?<=[.!?;|])\s+"


def words_in(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def candidates(files: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(id, known, words): template words and all words of every line, sentence or wrapped sentence with a word."""
    wrapped = F.filter(F.split(F.col("text"), PARAGRAPH), lambda s: F.contains(s, F.lit("\n")))
    segment = F.explode(F.concat(F.split(F.col("text"), LINE), wrapped))
    words = F.split(F.trim(normalized(F.col("segment"))), " ")
    split = files.select("id", segment.alias("segment")).filter("segment <> ''").select("id", words.alias("words"))
    return split.select("id", "words", F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary])).alias("known"))


def idf_of(found: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """Weights of the templates' words over all candidates, and the weight of a word that never occurs."""
    counts = found.select(F.explode(F.concat(F.array(F.lit("")), F.col("known"))).alias("w")).groupBy("w").count()
    rows = {r["w"]: r["count"] for r in counts.collect()}
    n = rows.get("", 0)
    weight = lambda df: math.log((1 + n) / (1 + df)) + 1
    return {w: weight(rows.get(w, 0)) for w in vocabulary}, weight(0)


def vectors_of(idf: dict[str, float], templates: dict[str, list[str]]) -> list[tuple[str, dict[str, float]]]:
    """(licence, unit vector) of every template, by name."""
    found = []
    for name, texts in sorted(templates.items()):
        for own in map(words_in, texts):
            vector = {w: own.count(w) * idf[w] for w in own}
            length = math.sqrt(sum(v * v for v in vector.values()))
            found.append((name, {w: v / length for w, v in vector.items()}))
    return found


def anchors(vectors: list[tuple[str, dict[str, float]]]) -> list[str]:
    """Words of which a candidate must hold one: with none of a template's heaviest, the cosine stays below `COSINE`."""
    needed = set()
    for _, vector in vectors:
        rest = 1.0
        for w, v in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if rest < COSINE**2 - 1e-9:
                break
            needed.add(w)
            rest -= v * v
    return sorted(needed)


def own_licenses(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(id, license, cosine) for every file of (id, text) that has a licence of its own."""
    vocabulary = sorted({w for texts in templates.values() for t in texts for w in words_in(t)})
    found = candidates(files, vocabulary)
    idf, rare = idf_of(found, vocabulary)
    vectors = vectors_of(idf, templates)
    held = saved(found.filter(F.arrays_overlap("known", F.array(*[F.lit(w) for w in anchors(vectors)]))).select("id", "words", F.monotonically_increasing_id().alias("at")), "candidates")
    terms = held.select("id", "at", F.explode("words").alias("w")).groupBy("id", "at", "w").agg(F.count(F.lit(1)).alias("tf"))
    weights = [(w, v, [vector.get(w, 0.0) for _, vector in vectors]) for w, v in idf.items()]
    known = F.broadcast(held.sparkSession.createDataFrame(weights, "w string, idf double, t array<double>"))
    weighted = terms.join(known, "w", "left").withColumn("v", F.col("tf") * F.coalesce("idf", F.lit(rare)))
    dots = [F.sum(F.col("v") * F.coalesce(F.col("t")[i], F.lit(0.0))).alias(f"d{i}") for i in range(len(vectors))]
    sums = weighted.groupBy("id", "at").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), *dots)
    cosine = [F.round(F.col(f"d{i}") / F.col("norm"), 9) for i in range(len(vectors))]
    options = [F.when(c >= COSINE, F.struct(F.lit(name in GENERIC).alias("g"), (-c).alias("c"), F.lit(name).alias("license"))) for c, (name, _) in zip(cosine, vectors, strict=True)]
    scored = sums.select("id", F.array_min(F.array(*options)).alias("b")).filter("b is not null")
    return scored.groupBy("id").agg(F.min("b").alias("b")).select("id", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(key, path, license, cosine, found, from_dir); `found` is own, directory or null."""
    named = files.select(F.col(quoted(key)).alias("id"), F.col(quoted(path)).alias("path"), F.col(quoted(text)).alias("text"))
    own = saved(own_licenses(named.select("id", "text"), templates), "licenses")
    places = named.select("id", "path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    judged = saved(places.join(narrow(own), "id", "left"), "judged")
    holders = judged.filter(F.col("name").rlike(LICENSE_FILE) & F.col("license").isNotNull())
    best = F.min(F.struct(F.col("license").isin(*GENERIC).alias("g"), (-F.col("cosine")).alias("c"), F.col("license").alias("l")))
    dirs = holders.groupBy("dir").agg(best.alias("b")).select(F.col("dir").alias("from_dir"), F.col("b.l").alias("dir_license"), (-F.col("b.c")).alias("dir_cosine"))
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(steps, 1, i), "/").alias("from_dir")))
    ancestors = judged.select("dir").filter("dir is not null").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.from_dir")
    nearest = ancestors.join(dirs, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "dir_license", "dir_cosine")).alias("n"))
    inherited = judged.join(nearest, "dir", "left")
    taken = F.col("license").isNull()
    return inherited.select(
        F.col("id").alias(key),
        "path",
        F.when(taken, F.col("n.dir_license")).otherwise(F.col("license")).alias("license"),
        F.when(taken, F.col("n.dir_cosine")).otherwise(F.col("cosine")).alias("cosine"),
        F.when(~taken, "own").when(F.col("n").isNotNull(), "directory").alias("found"),
        F.when(taken, F.col("n.from_dir")).alias("from_dir"),
    )

"""License scans (operator 1), DataFrame functions only.

1. Document counts of every word of the corpus, made by one group-by, give the
   IDF weights of the templates' words and of the lines'.
2. Of every text its lines, sentences, paragraphs (parted by lines without a
   letter or digit), blocks (parted by blank lines or ends of comments) and the
   whole text are compared with the templates by sparse TF-IDF cosine, if they
   could reach a template's threshold (they must hold one of its words chosen
   so that the rest of its weight can't reach it).  Short templates (a sentence
   or notice) have the threshold ``least``, full licence texts ``full_least``;
   a document's own licence is its best part's.
3. A document whose whole text passes, or most of whose text is its best line
   (``file_share``), is a licence file and speaks for its directory; documents
   without a licence of their own inherit from the nearest ancestor directory
   that has one, by a join of the distinct directories' ancestors with the
   licensed directories.

``templates`` and ``full`` are parameters; what is sent to tasks is bounded by
them.  The full texts lie in ``license_texts/``, named by licence.

Defined results: null or empty texts have no licence of their own but inherit;
ties go to the higher score, then the alphabetically first licence; a null path
is the root directory; rows that repeat give repeated results; other columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import materialize

#: licence and a line that grants it
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Use of this source code is governed by the BSD 2-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: notices that stand at the head of files
NOTICES = tuple((f"{short}-{version}", f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} "
                 f"as published by the Free Software Foundation, either version {version.removesuffix('.0')} of the License, or (at your option) any later version.")
                for short, thing, name, versions in (("AGPL", "program", "Affero General Public License", ("3.0",)),
                                                     ("GPL", "program", "General Public License", ("2.0", "3.0")),
                                                     ("LGPL", "library", "Lesser General Public License", ("2.1", "3.0")))
                for version in versions)
_SPLIT = "[^a-z0-9]+"
_SENTENCE = r"(?<=[.!?])\s+"
_PARAGRAPH = r"\n(?:[^A-Za-z0-9\n]*(?:\n|$))+"
_BLOCK = r"\n(?:[ \t\r\f]*\n)+|\*/|-->"


def full_texts() -> tuple[tuple[str, str], ...]:
    """Licence and its full text."""
    return tuple((p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def _words(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", templates=TEMPLATES + NOTICES,
                 least: float = 0.6, file_share: float = 0.3, full=None, full_least: float = 0.85) -> DataFrame:
    """``doc_id, path, license, origin (own, file, inherited or null), score, license_dir``, one row per document."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.xxhash64(text_col).alias("hash"),
                        F.col(text_col).alias("text"))
    compared = [(n, t, least) for n, t in templates] + [(n, t, full_least) for n, t in (full_texts() if full is None else full)]
    vocabulary = sorted({w for _, t, _ in compared for w in _words(t)})
    in_line = lambda c: F.filter(F.split(F.lower(c), _SPLIT), lambda w: w != "")
    held = given.filter("text is not null").select(F.explode(F.array_union(F.split(F.lower("text"), _SPLIT), F.array(F.lit("")))).alias("w"))
    counts = materialize(held.groupBy("w").agg(F.count("*").alias("n")), "license-words")  # "": texts
    df = {r.w: r.n for r in counts.filter(F.col("w").isin("", *vocabulary)).collect()}  # at most the vocabulary
    total = df.get("", 0)
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in vocabulary}

    postings, needed = [], set()
    for number, (name, text, enough) in enumerate(compared):
        weight = {w: n * idf[w] for w, n in Counter(_words(text)).items()}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        rest = 1.0
        for w, x in sorted(weight.items(), key=lambda i: (-i[1] * i[1] / (1 + df.get(i[0], 0)), i[0])):  # heavy and rare words first
            postings.append((w, number, name, x / norm * idf[w], (x / norm) ** 2, enough))
            if rest >= enough * enough * 0.999:
                needed.add(w)
                rest -= (x / norm) ** 2
    index = materialize(docs.sparkSession.createDataFrame(postings, "w string, template int, license string, x double, most double, enough double"), "license-index")
    weight_of = F.log(F.lit(1 + total) / (1 + F.col("n"))) + 1

    holds = "(?i)(^|[^a-z0-9])(" + "|".join(sorted(needed)) + ")([^a-z0-9]|$)"
    # parts with their share of the text: 1 for the whole, a line's own, 0 for others
    part = lambda x, share: F.struct(x.alias("x"), share.cast("double").alias("share"))
    paragraphs, each = F.split("text", _PARAGRAPH), F.split("text", "\n")
    other = F.array_except(F.concat(F.flatten(F.transform(paragraphs, lambda x: F.split(x, _SENTENCE))), paragraphs, F.split("text", _BLOCK)),
                           F.array_append(each, F.col("text")))
    parts = F.concat(F.array(part(F.col("text"), F.lit(1))),
                     F.transform(each, lambda x: part(x, F.try_divide(F.length(x), F.length("text")))),
                     F.transform(other, lambda x: part(x, F.lit(0))))
    lines = (given.filter(F.col("text").rlike(holds)).select("doc_id", "hash", F.posexplode(parts).alias("line", "part"))
             .select("doc_id", "hash", "line", "part.share", F.col("part.x").alias("x"))
             .filter(F.col("x").rlike(holds)).withColumn("words", in_line("x")))
    at = ["doc_id", "hash", "line", "share"]
    lines = materialize(lines.select(*at, "words"), "license-parts")
    # a cosine is at most the root of the template's squared weights of the words that the part holds; repeated rows scale all counts of a part alike
    could = (lines.select(*at, F.explode(F.array_distinct("words")).alias("w")).join(F.broadcast(index), "w").groupBy(*at, "template", "enough")
             .agg(F.sum("most").alias("most")).filter(F.col("most") >= F.col("enough") ** 2 * 0.999).select(*at).distinct())
    same = (F.col("p.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("p.hash") == F.col("c.hash")) & (F.col("p.line") == F.col("c.line")))
    terms = materialize(lines.alias("p").join(could.alias("c"), same, "left_semi").withColumn("w", F.explode("words"))
                        .groupBy(*at, "w").agg(F.count("*").alias("tf")), "license-terms")
    norms = terms.join(counts, "w").groupBy(*at).agg(F.sqrt(F.sum((F.col("tf") * weight_of) ** 2)).alias("norm"))
    dots = terms.join(index, "w").groupBy(*at, "template", "license", "enough").agg(F.sum(F.col("tf") * F.col("x")).alias("dot"))
    both = dots.alias("d").join(norms.alias("n"), F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("d.hash") == F.col("n.hash"))
                                & (F.col("d.line") == F.col("n.line")))
    cosine = both.select("d.*", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).filter(F.col("score") >= F.col("enough"))
    best = cosine.groupBy("doc_id", "hash").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", (-F.col("share")).alias("share"))).alias("b"),
                                                F.max("share").alias("most"))
    own = materialize(best.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), F.col("b.license").alias("own"),
                                  (-F.col("b.s")).alias("score"), ((-F.col("b.share") >= file_share) | (F.col("most") >= 1)).alias("is_file")), "license-own")

    folder = F.regexp_replace(F.coalesce("path", F.lit("")), "(^|/)[^/]*$", "")
    placed = (given.select("doc_id", "path", "hash", folder.alias("dir"))
              .join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")), "left").drop("__id", "__hash"))
    licensed = placed.filter("is_file").groupBy(F.col("dir").alias("from")).agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col("own").alias("license"))).alias("l"))
    parts = F.split("dir", "/")
    up = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    nearest = (placed.select("dir").distinct().select("dir", F.explode(F.array_distinct(up)).alias("from")).join(licensed, "from")
               .groupBy(F.col("dir").alias("__dir")).agg(F.max(F.struct(F.length("from").alias("n"), F.col("from"), F.col("l.license").alias("license"))).alias("near")))
    origin = F.when(F.col("own").isNotNull(), F.when(F.col("is_file"), "file").otherwise("own")).when(F.col("near").isNotNull(), "inherited")
    return (placed.join(nearest, F.col("dir") == F.col("__dir"), "left").select(
        "doc_id", "path", F.coalesce("own", "near.license").alias("license"), origin.alias("origin"), "score",
        F.when(F.col("own").isNull(), F.col("near.from")).alias("license_dir")))

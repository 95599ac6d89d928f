"""Licence scans: TF-IDF cosine of lines, header blocks and whole files to templates, then inheritance from directories (operator 2). DataFrame expressions only."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import discard, documents, release, settle, store

# Licences and the notices by which files name them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
)
#: Headers as files carry them, whole; and the full texts of licences.
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    *((f"GPL-{v}.0", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.") for v in (2, 3)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
TEXTS = tuple((f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))
#: Lines, blocks and files without one of these are not compared.
ANCHORS = r"(?i)licen[sc]e|spdx|copyright|permission is hereby|redistribution and use|creative commons|free software|\bcc0\b|\bcc by\b"
#: Names of licence files.
FILE_NAME = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying)(?:[.\-_][^/]*)?$"
#: Least cosine of a line, block or file to its template.
COSINE = 0.6
#: A text of at least this part of words in licence lines, or in licence paragraphs, speaks for its directory.
FILE_SHARE = 0.5


def terms(line: Column) -> Column:
    """Lower-case runs of letters, digits, dots and hyphens within; dots and hyphens at their ends fall off."""
    return F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"), 0)


def document_path() -> Column:
    """Where `documents` place a file: source, then language, then doc_id."""
    return F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def full_templates() -> tuple[tuple[str, str], ...]:
    """TEMPLATES, HEADERS, whole licences and their paragraphs that name an anchor and are no mere title."""
    paragraphs = [(name, p) for name, text in TEXTS for p in re.split(r"\n(?:[^\w\n]*\n)+", text) if re.search(ANCHORS, p) and len(p.split()) >= 25]
    once = {}
    for name, p in paragraphs:
        once.setdefault(" ".join(p.split()), set()).add(name)
    # A paragraph that several licences share names none of them.
    return (*TEMPLATES, *HEADERS, *TEXTS, *((min(names), p) for p, names in once.items() if len(names) == 1))


def match_lines(lines: DataFrame, templates: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(key, licence, score) of units (key, line, n) with a template (key, licence, line) at least `cosine` near.

    Vectors are sparse rows of (key, term, weight): term counts times smoothed inverse document frequencies over all
    units, `n` times each, and templates. Units meet templates only on terms that templates have; norms take all terms.
    """
    texts = lines.select("key", "line", "n").unionByName(templates.select("key", "line", F.lit(1).cast("long").alias("n")))
    texts = texts.groupBy("key").agg(F.first("line").alias("line"), F.sum("n").alias("n"))
    counts = settle(texts.select("key", "n", F.explode(terms(F.col("line"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"), F.first("n").alias("n")))
    whole = float((lines.agg(F.sum("n")).first()[0] or 0) + templates.count())
    idf = settle(counts.groupBy("term").agg((F.log(F.lit(whole + 1) / (F.sum("n") + 1)) + 1).alias("idf")))
    weights = settle(counts.join(idf, "term").select("key", "term", (F.col("tf") * F.col("idf")).alias("w")))
    norms = settle(weights.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")))
    own = weights.join(F.broadcast(templates.select("key").distinct()), "key").withColumnsRenamed({"key": "template", "w": "v"})
    own = own.join(norms.withColumnsRenamed({"key": "template", "norm": "own_norm"}), "template")
    # One row per term, with its templates: what a unit's terms meet is added up in one array per unit, not in rows.
    known = [r[0] for r in templates.select("key").distinct().sort("key").collect()]
    place = F.array_position(F.array(*[F.lit(k) for k in known]), F.col("template")).cast("int")
    terms_of = settle(own.groupBy("term").agg(F.collect_list(F.struct(place.alias("at"), (F.col("v") / F.col("own_norm")).alias("v"))).alias("to")))
    dots = weights.join(F.broadcast(terms_of), "term").select("key", "w", F.inline("to")).groupBy("key", "at").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    near = dots.join(norms, "key").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= cosine)
    named = near.withColumn("template", F.element_at(F.array(*[F.lit(k) for k in known]), F.col("at")))
    named = named.join(F.broadcast(templates.select(F.col("key").alias("template"), "licence").distinct()), "template")
    best = named.groupBy("key").agg(F.max_by(F.struct("licence", "score"), F.struct(F.col("score"), F.col("licence"))).alias("b"))
    return best.select("key", "b.licence", "b.score")


def scan(docs: DataFrame, path: Column | None = None, templates: tuple[tuple[str, str], ...] | None = None, cosine: float = COSINE) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, path, own_licence, score, licence, inherited_from.

    Compared are, where they hold an anchor word: all lines of the whole text, its paragraphs (comment marks count as
    blank), its blocks between blank lines, and the whole text, by their words in order. The nearest template (by default
    all of full_templates()) names the document's own licence (ties: the last by name). A document without one inherits
    that of the nearest directory, upwards from its own, with a licence file: a text with a licence of its own that has
    the name of one, is near a template as a whole, or has at least half of its words in licence lines or licence
    paragraphs (of several, the least path's licence; of one
    path, the least by name).
    Nulls: a null text has no licence of its own; null parts of a path are empty. Equal units are compared once, by a digest
    of their words; units of any length are taken whole. Repeated rows are each reported; other columns are not looked at.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    at = path if path is not None else document_path()
    rows = docs.select("doc_id", at.alias("path"), "text")
    has = F.coalesce(F.col("text").rlike(ANCHORS), F.lit(False))
    units = lambda kind, parts: F.transform(F.filter(parts, lambda x: x.rlike(ANCHORS)), lambda x: F.struct(F.lit(kind).alias("kind"), F.array_join(terms(x), " ").alias("line")))
    parts = F.concat(
        units("line", F.split("text", r"\r?\n")), units("paragraph", F.split("text", r"\n(?:[^\p{L}\p{N}\n]*+\n)++")),
        units("block", F.split("text", r"\n(?:[\s&&[^\n]]*+\n)++")), units("file", F.array("text")),
    )
    # Texts are kept once, compressed; their units' words go no further than to the distinct units.
    row = store(rows.select("doc_id", "path", F.when(has, F.col("text")).alias("text")).withColumn("row", F.monotonically_increasing_id()))
    words = F.size(terms(F.col("text"))).alias("words")
    # A text without blank lines is its own paragraph, block and file: it is sent once.
    once = F.array_distinct(F.transform(parts, lambda u: u["line"]))
    lines = row.where("text IS NOT NULL").select(F.explode(once).alias("line")).select(F.md5("line").alias("key"), "line")
    each = row.where("text IS NOT NULL").select("row", "path", words, F.explode(parts).alias("u"))
    each = settle(each.select("row", "path", "words", "u.kind", F.unhex(F.md5("u.line")).alias("key"), F.size(F.split("u.line", " ")).alias("size")))
    known = spark.createDataFrame(list(full_templates() if templates is None else templates), "licence string, template string")
    known = settle(known.withColumn("line", F.array_join(terms(F.col("template")), " ")).withColumn("key", F.md5("line")).select("key", "licence", "line"))
    counts = each.groupBy("key").agg(F.count("*").alias("n")).select(F.lower(F.hex("key")).alias("key"), "n")
    units_ = store(lines.groupBy("key").agg(F.first("line").alias("line")).join(counts, "key"))
    release(spark)
    matched = settle(match_lines(units_, known, cosine).withColumn("key", F.unhex("key")))
    hits = each.join(matched, "key")
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("size"))) / F.first("words"), F.lit(0.0))
    speaks = (F.greatest(part("line"), part("paragraph")) >= FILE_SHARE) | (F.count_if(F.col("kind") == "file") > 0) | F.first("path").rlike(FILE_NAME)
    per = settle(hits.groupBy("row").agg(F.max_by(F.struct("licence", "score"), F.struct("score", "licence")).alias("b"), speaks.alias("speaks"), F.first("path").alias("file")))
    parent = F.regexp_replace("file", r"/?[^/]*$", "")
    files = settle(per.where("speaks").groupBy(parent.alias("dir")).agg(F.min_by("b.licence", F.struct("file", "b.licence")).alias("dir_licence")))
    own = row.drop("text").join(per.select("row", F.col("b.licence").alias("own_licence"), F.col("b.score").alias("score")), "row", "left")
    own = settle(own)
    discard(row, units_)
    steps = F.split(F.regexp_replace("path", r"/?[^/]*$", ""), "/")
    up = F.transform(F.sequence(F.size(steps), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    # One row per directory and ancestor, not per document: as many as paths are deep.
    dirs = own.where("own_licence IS NULL").select(F.regexp_replace("path", r"/?[^/]*$", "").alias("of"), F.array_distinct(up).alias("up")).distinct()
    above = dirs.select("of", F.posexplode("up").alias("far", "dir")).join(files, "dir")
    nearest = settle(above.groupBy("of").agg(F.min_by(F.struct("dir", "dir_licence"), "far").alias("from")))
    joined = own.withColumn("of", F.regexp_replace("path", r"/?[^/]*$", "")).join(nearest, "of", "left")
    none = F.col("own_licence").isNull()
    return joined.select(
        "doc_id", "path", "own_licence", "score",
        F.coalesce("own_licence", "from.dir_licence").alias("licence"), F.when(none, F.col("from.dir")).alias("inherited_from"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))

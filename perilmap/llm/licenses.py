"""Licence scan: TF-IDF cosine to templates, then inheritance from the nearest ancestor.

A file's candidate units are its paragraphs (adjacent lines with words, so a header over several
lines is one), their sentences and their lines, each with a word that licences use (``ANCHOR``);
a file named like a licence (``LICENSE_FILE``) is also one unit as a whole, and only if that
matches nothing do its parts count. Units and templates, short notices and the full texts in
``licence_texts``, are sparse TF-IDF vectors (1 + ln of a word's count in the unit, times its idf);
document frequencies of all their words are counted over all files. Each distinct unit is
compared once with the templates it shares a word with, and the best at ``LEAST`` or more is
its licence.

A licence file, by its name, speaks for its directory; a notice in any other file speaks for
that file alone. A file without a licence of its own takes that of the nearest directory above it
that has one: directories (not files) are expanded to their ancestors and joined by path.

Cases: null and empty texts have no licence of their own but may inherit; null paths neither
give nor take; of several units or licence files the best score wins, then the name; repeated
rows each get a row, and texts of one file and path each their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, written

LEAST = 0.6
ANCHOR = r"(?i)licen[cs]|copyright|spdx|warrant|public domain|redistribut|permission is hereby|rights reserved"
# Java's matcher recurses for each repeat of a group, so no pattern here repeats one without bound.
SENTENCE_END = r"(?<![.;!?])[.;!?]++(?:\s++|$)"
BLANK_LINES = r"\n[^\p{L}\p{N}]*\n"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-][^/]*)?$"
# A source that is itself such a file, in a directory that is neither the top nor a URL's scheme; collections and hosts have names like "notice-texts" too.
LICENSE_SOURCE = r"(?i)[^:/]/(licen[cs]e|copying|unlicense|notice)(\.(txt|md|rst|html?))?$"

# Licence names and the usual wording of their notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Licensed under the ISC License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "Copyright. All rights reserved"),
)


def terms(text: Column) -> Column:
    """Words of a text in lower case; a dot stays inside a version number only."""
    plain = F.regexp_replace(F.lower(text), r"\.(?![0-9])|(?<![0-9])\.", " ")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}.]+"), lambda w: w != "")


def templates(spark: SparkSession) -> DataFrame:
    """(template, licence, term, tf): a fixed table of some thousand rows."""
    full = [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    every = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(name).alias("licence"), F.lit(text).alias("text")) for k, (name, text) in enumerate([*TEMPLATES, *full])])
    rows = spark.range(1).select(F.explode(every).alias("r")).select("r.*")
    return rows.select("template", "licence", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "licence", "term").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))


def frequencies(files: DataFrame, words: DataFrame) -> DataFrame:
    """(term, df) of each of ``words`` (term) over all files; counted within tasks first, so few rows are shuffled."""
    counted = files.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return words.join(counted, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def units(files: DataFrame) -> DataFrame:
    """(file, path, mark, key, unit, part, named): what could be a licence notice in each file, and its digest; part is 0 for a licence file's whole text.

    ``mark`` tells texts of one file and path apart.
    """
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE), F.lit(False))
    anchored = lambda x: x.rlike(ANCHOR)
    paragraphs = F.filter(F.split("text", BLANK_LINES), anchored)
    pieces = lambda pattern: F.filter(F.flatten(F.transform("paragraphs", lambda p: F.split(p, pattern))), anchored)
    held = files.filter(F.col("text").rlike(ANCHOR)).select("file", "path", F.xxhash64("text").alias("mark"), named.alias("named"), "text", paragraphs.alias("paragraphs"))
    parts = F.array_distinct(F.transform(F.concat("paragraphs", pieces(SENTENCE_END), pieces("\n")), lambda x: F.trim(x)))
    tagged = lambda xs, part: F.transform(xs, lambda x: F.struct(x.alias("unit"), F.lit(part).alias("part")))
    every = F.concat(F.when(F.col("named"), tagged(F.array(F.trim("text")), 0)).otherwise(F.array().cast("array<struct<unit:string,part:int>>")), tagged(parts, 1))
    found = held.select("file", "path", "mark", "named", F.explode(every).alias("u"))
    return found.select("file", "path", "mark", F.unhex(F.sha2(F.col("u.unit").cast("binary"), 256)).alias("key"), "u.unit", "u.part", "named")


def matched(distinct_units: DataFrame, weights: DataFrame, templates_: DataFrame) -> DataFrame:
    """(key, licence, score): the best template of each unit (key, unit), at ``LEAST`` or more; its text isn't carried along."""
    vectors = templates_.join(weights, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = vectors.groupBy("template", "licence").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vectors = F.broadcast(vectors.join(norms, ["template", "licence"]).select("template", "licence", "term", (F.col("w") / F.col("norm")).alias("v")))
    words = distinct_units.select("key", F.explode(terms(F.col("unit"))).alias("term")).groupBy("key", "term").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))
    words = words.join(weights, "term").withColumn("w", F.col("tf") * F.col("idf"))
    sizes = words.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dots = words.join(vectors, "term").groupBy("key", "template", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(sizes, "key").withColumn("score", F.round(F.col("dot") / F.col("size"), 6)).filter(F.col("score") >= LEAST)
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("best"))
    return best.select("key", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("score"))


def directory(path: Column) -> Column:
    """The path without its last part; the empty string for a file at the top."""
    return F.array_join(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), "/")


def inherited(directories: DataFrame, speaking: DataFrame) -> DataFrame:
    """(dir, licence, score, source_dir): for each directory the nearest one at or above it that speaks."""
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    above = directories.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("at")))).alias("a"))
    near = above.select("dir", F.col("a.depth").alias("depth"), F.col("a.at").alias("source_dir")).join(speaking, "source_dir")
    best = near.groupBy("dir").agg(F.max_by(F.struct("licence", "score", "source_dir"), "depth").alias("b"))
    return best.select("dir", "b.licence", "b.score", "b.source_dir")


def scan(files: DataFrame, out_dir: str) -> DataFrame:
    """(file, path, licence, score, origin, source_dir) of every file (file, path, text); origin is own, inherited or none."""
    spark = files.sparkSession
    known = templates(spark)
    n = files.count()
    found = written(units(files), f"{out_dir}/units")
    distinct = written(found.groupBy("key").agg(F.first("unit").alias("unit")), f"{out_dir}/distinct")
    words = distinct.select(F.explode(terms(F.col("unit"))).alias("term")).unionByName(known.select("term")).distinct()
    idf = (F.log(F.lit(float(n + 1)) / (F.col("df") + 1)) + 1).alias("idf")
    weights = written(frequencies(files, words).select("term", idf), f"{out_dir}/weights")
    best = written(matched(distinct, weights, known), f"{out_dir}/matched")
    owned = found.drop("unit").join(best, "key")
    own = owned.groupBy("file", "path", "mark").agg(F.min(F.struct("part", (-F.col("score")).alias("minus"), "licence")).alias("o")).select(F.col("file").alias("f"), F.col("path").alias("p"), F.col("mark").alias("m"), F.col("o.licence").alias("own"), (-F.col("o.minus")).alias("own_score"))
    speaking = owned.filter("named AND path IS NOT NULL").groupBy(directory(F.col("path")).alias("source_dir")).agg(F.min(F.struct("part", (-F.col("score")).alias("minus"), "licence")).alias("o")).select("source_dir", F.col("o.licence").alias("licence"), (-F.col("o.minus")).alias("score"))
    placed = files.select("file", "path", F.xxhash64("text").alias("mark"), directory(F.col("path")).alias("dir"))
    given = inherited(placed.select("dir").filter("dir IS NOT NULL").distinct(), speaking)
    out = placed.join(own, F.col("file").eqNullSafe(F.col("f")) & F.col("path").eqNullSafe(F.col("p")) & (F.col("mark") == F.col("m")), "left").join(given, "dir", "left")
    has = F.col("own").isNotNull()
    return out.select(
        "file", "path",
        F.when(has, F.col("own")).otherwise(F.col("licence")).alias("licence"),
        F.when(has, F.col("own_score")).otherwise(F.col("score")).alias("score"),
        F.when(has, "own").when(F.col("licence").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("source_dir")).alias("source_dir"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: each lies in the directory of its source and language, under its id; where the source is a licence file's path (``LICENSE_SOURCE``), the document is that file."""
    docs = table(spark, sf_dir, "documents")
    below = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    path = F.when(F.col("source").rlike(LICENSE_SOURCE), F.col("source")).otherwise(below)
    return scan(docs.select(F.col("doc_id").cast("long").alias("file"), path.alias("path"), "text"), shared_dir(spark, "licences")).withColumnRenamed("file", "doc_id")

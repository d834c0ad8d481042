"""Licence scans by sparse TF-IDF cosine and directory inheritance (operator 10, native).

DataFrame functions only. The licence lines of every file, the lines around each as far as its
paragraph goes (a wrapped header: ``BACK`` lines before and runs of up to the longest of ``RUNS``),
its SPDX identifiers, and the whole text of licence files become sparse TF-IDF vectors; equal segments are collapsed before anything is
shuffled by token, so a header that a third of all files share is one vector. The cosine to a
fixed set of templates names the licence. A directory takes the licence of its licence file; a
file without a licence of its own inherits from its nearest ancestor directory that has one,
found by joining the distinct directories' ancestor paths with the licensed directories.

A licence file is one whose name says so, or whose licence lines hold at least half of its
words. Two licence files in one directory: the better score counts, then the smaller path.

Cases: a null or empty text has no licence of its own but may inherit one; a null path neither
inherits nor gives; equal rows give equal rows; ties between templates go to the smaller licence
id; an empty table gives an empty table; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .scratch import stage

# Licence ids and the wording by which files state them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; it is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met. Licensed under the BSD 3-Clause "
                     "License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0. Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Identifiers by which SPDX lines name the licences; GNU licences also say whether later versions count.
TEMPLATES += tuple((a, f"SPDX-License-Identifier: {a}{end}") for a in dict.fromkeys(a for a, _ in TEMPLATES)
                   for end in (("", "-only", "-or-later") if "GPL" in a else ("",)))
MARKER = (r"[LlSsCcPpGgRr](?i:icen[cs]e|pdx-|opyright|reative commons|c0 |c by|ublic domain|ermission is hereby|"
          r"nu (?:lesser |affero )?general|edistribution and use)")
FILE_NAME = r"(?i)^(?:un)?(?:licen[cs]e|copying|notice)(?:[.-][a-z0-9.-]*)?$"
#: A line without words (blank, or only the signs of a comment) ends a paragraph.
PARAGRAPH = r"\n[^\p{L}\p{N}\n]*(?=\n)"
SPDX = r"(?i)SPDX-License-Identifier\s*:\s*\(?[a-z0-9][a-z0-9.-]*"
#: Lines before a marked line, and numbers of lines from there, that are compared as one header.
BACK = (0, 1, 2)
RUNS = (2, 3, 4, 5, 6, 8, 10, 12)
THRESHOLD = 0.6
FILE_SHARE = 0.5

_TOKEN = "[a-z0-9]+(?:[.-][0-9a-z]+)*"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def _words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def segments(files: DataFrame, text: str) -> tuple[DataFrame, Column, Column]:
    """``files`` that mention a licence, with their marked lines; the two columns added."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(MARKER))
    return files.filter(F.col(text).rlike(MARKER)), lines, _words(F.array_join(lines, "\n"))


def headers(text: Column) -> Column:
    """Runs of lines around each marked line, inside its paragraph, and the SPDX identifiers of a text."""
    def around(paragraph: Column) -> Column:
        lines = F.split(paragraph, "\n")
        marked = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i).rlike(MARKER))
        shapes = F.array(*(F.struct(F.lit(b).alias("back"), F.lit(n).alias("n")) for b in BACK for n in RUNS if n > b))
        return F.flatten(F.transform(marked, lambda i: F.transform(
            F.filter(shapes, lambda x: x["back"] < i),
            lambda x: F.array_join(F.slice(lines, i - x["back"], x["n"]), "\n"))))

    paragraphs = F.filter(F.split(text, PARAGRAPH), lambda x: x.rlike(MARKER))
    return F.concat(F.flatten(F.transform(paragraphs, around)), F.regexp_extract_all(text, F.lit(SPDX), F.lit(0)))


def name_segments(parts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(name, licence, score) of each distinct segment of ``parts`` (name, segment, counted) that a template matches.

    Inverse document frequencies count every occurrence of a segment and each template once;
    segments that are not ``counted`` overlap others.
    """
    spark = parts.sparkSession
    kinds = spark.range(1).select(F.inline(F.array(*(F.struct(
        F.lit(i).alias("template"), F.lit(a).alias("licence"), F.lit(b).alias("segment"), F.unhex(F.md5(F.lit(b))).alias("name"))
        for i, (a, b) in enumerate(TEMPLATES)))))
    # texts travel once; the rows of their tokens carry 16-byte names
    distinct = parts.filter("segment is not null").groupBy("name").agg(
        F.any_value("segment").alias("segment"), F.count_if("counted").alias("n"))
    both = distinct.select("name", "segment", "n", F.lit(None).cast("int").alias("template")) \
        .unionByName(kinds.select("name", "segment", F.lit(1).cast("bigint").alias("n"), "template"))
    term = both.select("name", "template", "n", F.explode(_tokens(F.col("segment"))).alias("token")) \
        .groupBy("name", "template", "n", "token").agg(F.count("*").alias("tf"))
    total = both.agg(F.sum("n").alias("total"))
    idf = term.groupBy("token").agg(F.sum("n").alias("df")) \
        .select("token", (F.log((1.0 + total.scalar()) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    weight = term.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    templates = weight.filter("template is not null").select("template", "token", F.col("w").alias("v"))
    texts = weight.filter("template is null").select("name", "token", "w")
    norm_t = templates.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("nv"))
    norm_s = texts.groupBy("name").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nw"))
    dot = texts.join(F.broadcast(templates), "token").groupBy("name", "template") \
        .agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    score = dot.join(F.broadcast(norm_t), "template").join(norm_s, "name") \
        .select("name", "template", F.round(F.col("dot") / (F.col("nv") * F.col("nw")), 6).alias("score")) \
        .join(F.broadcast(kinds.select("template", "licence")), "template") \
        .filter(F.col("score") >= threshold)
    best = F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), F.col("licence")))
    return score.groupBy("name").agg(best.alias("best")).select("name", "best.*")


def scan(files: DataFrame, path: str = "path", text: str = "text", into: str = "licence",
         threshold: float = THRESHOLD) -> DataFrame:
    """``files`` with a struct: own (licence stated in the file), score, licence_file, directory
    and inherited (the nearest ancestor directory with a licence file, and its licence)."""
    row, at, body = tb.fresh(files, "_row"), tb.fresh(files, "_path"), tb.fresh(files, "_text")
    base = files.withColumns({at: F.col(path), body: F.col(text)})
    marked, lines, marked_words = segments(base, body)
    named = F.regexp_extract(F.col(at), "[^/]*$", 0).rlike(FILE_NAME)
    whole = named | (marked_words >= FILE_SHARE * _words(F.col(body)))
    marked = marked.select(F.col(at).alias("at"), F.col(body).alias("body"), F.coalesce(whole, F.lit(False)).alias("whole"),
                           lines.alias("lines"))
    # a file is known by its path and text: equal files have equal licences
    counted = F.array_distinct(F.concat(
        "lines", F.when(F.col("whole"), F.array("body")).otherwise(F.array().cast("array<string>"))))
    also = F.array_except(headers(F.col("body")), counted)
    parts = marked.select("at", F.col("body"), "whole", F.inline(F.concat(
        F.transform(counted, lambda x: F.struct(x.alias("segment"), F.lit(True).alias("counted"))),
        F.transform(also, lambda x: F.struct(x.alias("segment"), F.lit(False).alias("counted"))))))
    parts = stage(parts.select("at", F.sha2("body", 256).alias("key"), "whole", "segment",
                               F.unhex(F.md5("segment")).alias("name"), "counted"), "licence-lines")
    best = F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), F.col("licence")))
    own = parts.drop("segment").join(name_segments(parts, threshold), "name") \
        .groupBy("at", "key").agg(best.alias("best"), F.max("whole").alias("whole")) \
        .select("at", "key", "best.*", "whole")
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    licensed = own.filter("whole").groupBy(folder(F.col("at")).alias("folder")) \
        .agg(F.min_by("licence", F.struct(-F.col("score"), F.col("licence"), F.col("at"))).alias("inherited"))
    folders = base.filter(F.col(at).isNotNull()).select(folder(F.col(at)).alias("home")).distinct()
    parts_of = F.split("home", "/")
    nearest = folders.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts_of)))) \
        .withColumn("folder", F.array_join(F.slice(parts_of, 1, F.col("depth")), "/")) \
        .join(licensed, "folder").groupBy("home") \
        .agg(F.max_by(F.struct("folder", "inherited"), "depth").alias("near")).select("home", "near.*")
    # only files that state a licence meet the table of stated licences by key
    own = own.select(F.col("at").alias("_a"), F.col("key").alias("_k"), F.col("licence").alias("_l"),
                     F.col("score").alias("_s"), F.col("whole").alias("_w"))
    nearest = nearest.select(F.col("home").alias("_h"), F.col("folder").alias("_f"), F.col("inherited").alias("_i"))
    # the others get keys that match nothing, spread over all partitions
    states = F.when(F.col(body).rlike(MARKER), F.sha2(F.col(body), 256)) \
        .otherwise(F.coalesce(F.xxhash64(F.col(at), F.col(body)), F.lit(0)).cast("string"))
    keep = [F.col(f"f.`{c}`") for c in files.columns]
    return base.withColumn(row, states).alias("f") \
        .join(own.alias("o"), (F.col(f"f.{row}") == F.col("o._k")) & F.col(f"f.{at}").eqNullSafe(F.col("o._a")), "left") \
        .join(nearest.alias("n"), folder(F.col(f"f.{at}")) == F.col("n._h"), "left") \
        .select(*keep, F.struct(
            F.col("o._l").alias("own"), F.col("o._s").alias("score"),
            F.coalesce("o._w", F.lit(False)).alias("licence_file"), F.col("n._f").alias("directory"),
            F.col("n._i").alias("inherited")).alias(into))

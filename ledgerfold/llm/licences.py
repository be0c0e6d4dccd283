"""Licence notices in files, by the Dice coefficient of word bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions.text import let
from ledgerfold.session import cut

LEAST = 0.8
BROADCAST_BIGRAMS = 200_000

# --- fixed values: wording of common notices and short licences -------------------
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("proprietary", "All rights reserved."),
)


def common_templates(spark: SparkSession) -> DataFrame:
    """Templates ``(licence, text)`` of common notices."""
    return spark.createDataFrame(list(TEMPLATES), "licence string, text string")


def plain_words(text: Column) -> Column:
    """Words of a text in lower case, without marks: runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def bigrams(text: Column) -> Column:
    """Distinct hashes of two words in a row; none for fewer than two words."""
    none = F.array().cast("array<bigint>")

    def pairs(words: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda at: F.xxhash64(F.get(words, at), F.get(words, at + 1)))
        return F.when(F.size(words) >= 2, F.array_distinct(each)).otherwise(none)

    return let(plain_words(text), pairs)


def find_licences(files: DataFrame, templates: DataFrame | None = None, key: str = "file", least: float = LEAST) -> DataFrame:
    """Licences that pieces of each file's whole text come near to.

    ``files`` is ``(file, text)``, ``templates`` ``(licence, text)``, common
    notices where none are given.  A piece is a line, a paragraph (lines between
    blank ones) or the whole text; a text of one line is one piece.  A piece is
    told by the licence whose template shares the largest Dice coefficient of
    distinct word bigrams, ``least`` at the least; ties go to the first licence
    by code point.  Returns ``(file, licences, found)``: the distinct licences,
    and an array of ``(line_no, n_lines, licence, dice)`` in the order of pieces.

    Two sets whose sizes differ by more than the factor ``(2 - least) / least``
    can't reach ``least``, so templates are pruned by size before any bigram is
    compared, and pieces of a size no template allows aren't cut up at all.  Only
    bigrams shared with a template of a fitting size are counted.

    One row per row of ``files``; rows that repeat file and text are one.  Null,
    blank and one-word texts, and such templates, match nothing.  Empty
    ``templates`` find nothing.  Further columns are left out.
    """
    spark = files.sparkSession
    given = (common_templates(spark) if templates is None else templates).select("licence", F.coalesce("text", F.lit("")).alias("text"))
    known = given.select("licence", bigrams(F.col("text")).alias("bigrams"), F.xxhash64("licence", "text").alias("template"))
    known = cut(known.withColumn("size_t", F.size("bigrams")).filter("size_t > 0").dropDuplicates(["template"]))
    bounds = known.agg(F.min("size_t"), F.max("size_t"), F.sum("size_t")).first()
    ratio = (2 - least) / least
    low, high = (bounds[0] or 0) / ratio, (bounds[1] or 0) * ratio

    whole = files.select(F.col(key).alias("file"), "text").withColumn("id", F.xxhash64("file", "text"))
    marked = whole.filter(F.length(F.trim("text")) > 0)
    as_lines = marked.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "piece")).withColumn("n_lines", F.lit(1))
    many = marked.filter(F.contains("text", F.lit("\n")))
    one = many.select("id", F.lit(0).alias("line_no"), F.col("text").alias("piece"), F.size(F.split("text", "\n")).alias("n_lines"))
    parts = F.split("text", "\n[ \\t\\r]*\n")
    ended = F.transform(parts, lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))))  # line feeds inside
    paragraphs = (
        many.filter(F.col("text").rlike("\n[ \\t\\r]*\n"))
        .select("id", parts.alias("parts"), ended.alias("feeds"))
        .select("id", F.posexplode(F.arrays_zip("parts", "feeds")).alias("at", "p"), "feeds")
        .select("id", (F.col("at") * 2 + F.aggregate(F.slice("feeds", F.lit(1), F.col("at")), F.lit(0), lambda a, x: a + x)).alias("line_no"), F.col("p.parts").alias("piece"), (F.col("p.feeds") + 1).alias("n_lines"))
        .filter("n_lines > 1")
    )
    pieces = as_lines.unionByName(one).unionByName(paragraphs)
    # a piece with n distinct bigrams has 2 n letters or digits and a mark between any two words
    sized = pieces.filter(F.length("piece") >= 2 * int(low) + 1)
    fitting = let(bigrams(F.col("piece")), lambda b: F.when((F.size(b) >= low) & (F.size(b) <= high), b))
    cut_up = sized.select("id", "line_no", "n_lines", fitting.alias("bigrams"))
    each = cut_up.select("id", "line_no", "n_lines", F.size("bigrams").alias("size_p"), F.explode("bigrams").alias("bigram"))
    wanted = known.select("template", "licence", "size_t", F.explode("bigrams").alias("bigram"))
    if (bounds[2] or 0) <= BROADCAST_BIGRAMS:
        wanted = F.broadcast(wanted)
    fits = (F.col("size_p") <= F.col("size_t") * ratio) & (F.col("size_t") <= F.col("size_p") * ratio)
    shared = each.join(wanted, "bigram").filter(fits).groupBy("id", "line_no", "n_lines", "size_p", "template", "licence", "size_t").agg(F.countDistinct("bigram").alias("n"))
    dice = 2 * F.col("n") / (F.col("size_p") + F.col("size_t"))
    near = shared.withColumn("dice", dice).filter(F.col("dice") >= least)
    best = near.groupBy("id", "line_no", "n_lines").agg(F.min(F.struct((-F.col("dice")).alias("less"), "licence")).alias("b"))
    per_file = best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line_no", "n_lines", F.col("b.licence").alias("licence"), (-F.col("b.less")).alias("dice")))).alias("found"))
    told = whole.drop("text").join(per_file, "id", "left")
    licences = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["licence"])))
    empty = F.array().cast("array<struct<line_no:int,n_lines:int,licence:string,dice:double>>")
    return told.select(F.col("file").alias(key), F.coalesce(licences, F.array().cast("array<string>")).alias("licences"), F.coalesce("found", empty).alias("found"))

"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

What holds a word of licensing is compared as a line, as a paragraph (lines up to a blank one, so a wrapped
header is one unit) and as a whole text (so a licence file is one). Weights come from all such units of the
corpus; equal units are scored once. A file without a licence of its own takes that of the nearest ancestor
directory which holds a licence file, found by joins on paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, join_by_count

#: Names of licences and statements of them as they are commonly written.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 Universal license."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Words of licensing; each template holds one.
ANCHOR = r"(?i)licen[sc]e|spdx|copyright|rights reserved|public domain|permission is hereby|redistribution and use"
#: What stands between two paragraphs.
BLANK = r"\n[ \t\r]*\n"
_TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def _terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(_TOKEN), F.lit(0))


def match_units(units: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(unit, licence, cosine, times)``: the best template for each distinct text of ``units(unit, times)``; ties go to the licence that sorts first. Units that share no word with a template are left out.

    A word's weight is its count times ln((1 + N) / (1 + n)) + 1, N counting all units and n those that hold it.
    """
    spark: SparkSession = units.sparkSession
    given = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates or TEMPLATES)], "template int, licence string, text string")
    units = cut(units.select(F.monotonically_increasing_id().alias("u"), "unit", "times"))  # words go by a number of their unit
    words = cut(units.select("u", "times", F.explode(_terms(F.col("unit"))).alias("word")).groupBy("u", "times", "word").agg(F.count("*").cast("int").alias("tf")))
    total = units.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    own = given.select("template", "licence", F.explode(_terms(F.col("text"))).alias("word")).groupBy("template", "licence", "word").agg(F.count("*").alias("tf"))
    held = cut(words.groupBy("word").agg(F.sum("times").alias("n"), F.count("*").alias("rows")))
    weight = F.log((1 + F.lit(total)) / (1 + F.coalesce("n", F.lit(0)))) + 1
    templated = cut(own.join(held, "word", "left").select("template", "licence", "word", (F.col("tf") * weight).alias("v")))
    weighted = join_by_count(words.select("u", "word", "tf"), held, ["word"], "rows").select("u", "word", (F.col("tf") * weight).alias("w"))
    length = weighted.groupBy("u").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("unit_length"))
    template_length = templated.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("template_length"))
    # a fixed list of templates, so its few thousand words are a table of known size
    own_words = words.join(F.broadcast(templated.select("word").distinct()), "word", "left_semi").select("u", "word", "tf")
    shared = own_words.join(F.broadcast(held.join(F.broadcast(templated.select("word").distinct()), "word", "left_semi")), "word").select("u", "word", (F.col("tf") * weight).alias("w"))
    dots = shared.join(F.broadcast(templated), "word").groupBy("u", "template", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(length, "u").join(F.broadcast(template_length), "template").select("u", "licence", F.round(F.col("dot") / (F.col("unit_length") * F.col("template_length")), 6).alias("cosine"))
    best = scored.groupBy("u").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
    return units.join(best, "u").select("unit", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"), "times")


def units_of(text: Column) -> Column:
    """The distinct lines, paragraphs and the whole of a text that hold a word of licensing; none of a null text."""
    said = lambda parts: F.filter(parts, lambda x: x.rlike(ANCHOR))
    return F.array_distinct(F.concat(said(F.split(text, r"\n")), said(F.split(text, BLANK)), said(F.array(text))))


def statements(docs: DataFrame, least: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, licence, cosine)``: each row's own best licence statement with a cosine of ``least`` or more, in a line, a paragraph or the whole text."""
    split = cut(docs.select(F.col(key).alias("k"), F.explode_outer(units_of(F.col(text).cast("string"))).alias("unit")).where("unit is not null"))
    units = split.groupBy("unit").agg(F.count("*").alias("times"))
    good = cut(match_units(units).where(F.col("cosine") >= least))
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "licence"))
    said = join_by_count(split, good, ["unit"], "times").groupBy("k").agg(best.alias("b"))
    return cut(said.select(F.col("k").alias(key), F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine")))


def directory_of(path: Column) -> Column:
    """All before the last ``/``; empty without one."""
    return F.regexp_extract(path, r"(?s)^(.*)/", 1)


def scan(docs: DataFrame, path: str, licence_file: Column, least: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, path, licence, origin, cosine, directory)`` for every row of ``docs``; ``key`` is unique or its rows are alike.

    ``origin`` is ``own``, ``inherited`` (from ``directory``, the nearest ancestor with a licence file, whose
    licence and cosine these are) or ``none``. ``licence_file`` is a condition over ``licence``, ``path`` and
    ``first``, the least key with a statement in the same directory. Of several licence files in a directory the
    one with the highest cosine counts, then the licence that sorts first. A null text or path has no statement
    or directory; texts are split whole, however long. Rows of one key share the best statement of all their
    texts; rows with a null key have none of their own. Other columns are left out.
    """
    paths = docs.select(F.col(key).alias("k"), F.col(path).cast("string").alias("path")).withColumn("dir", directory_of(F.col("path")))
    own = statements(docs, least, text, key).withColumnRenamed(key, "k")
    stated = paths.where("path is not null").dropDuplicates(["k"]).join(own, "k")
    stated = cut(stated)
    first = cut(stated.groupBy("dir").agg(F.min("k").alias("first"), F.count("*").alias("files")))
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "licence"))
    held = join_by_count(stated, first, ["dir"], "files").where(licence_file).groupBy("dir").agg(best.alias("b")).select(F.col("dir").alias("holder"), F.col("b.licence").alias("from_licence"), (-F.col("b.c")).alias("from_cosine"))
    parts = F.split("dir", "/")
    dirs = cut(paths.where("path is not null").groupBy("dir").agg(F.count("*").alias("files")))
    above = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("up", "holder"))
    nearest = above.join(held, "holder").groupBy("dir").agg(F.min(F.struct("up", "holder", "from_licence", "from_cosine")).alias("h")).select("dir", "h.holder", "h.from_licence", "h.from_cosine")
    near = cut(dirs.join(nearest, "dir", "left"))
    placed = join_by_count(paths.where("path is not null"), near, ["dir"], "files").select("k", "path", "holder", "from_licence", "from_cosine")
    nowhere = paths.where("path is null").select("k", "path", *[F.lit(None).cast(f.dataType).alias(f.name) for f in near.schema if f.name in ("holder", "from_licence", "from_cosine")])
    out = placed.unionByName(nowhere).join(own, "k", "left")
    has = F.col("licence").isNotNull()
    return out.select(
        F.col("k").alias(key),
        "path",
        F.coalesce("licence", "from_licence").alias("licence"),
        F.when(has, "own").when(F.col("from_licence").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(has, F.col("cosine")).otherwise(F.col("from_cosine")).alias("cosine"),
        F.when(~has, F.col("holder")).alias("directory"),
    )

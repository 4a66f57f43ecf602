"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

A document's passages (its lines with a licence word, each paragraph that holds one, and these lines with their neighbours there) and the templates
are sparse term vectors, weighted by how rare a term is among all documents' passages and the templates. A document is licensed as the nearest
template of any of its passages if the cosine is high, or as its SPDX tag says. A directory carries
the licence of its licence file, while a header speaks for its own document only; documents without a licence of their own take that of the nearest
ancestor directory which has one, by equi-joins of their ancestors' paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import keep, neighbours, whole_text

#: Cosine from which a template is a document's licence.
THRESHOLD = 0.5
#: Lines on each side of a licence line that are its neighbours.
NEAR = 2
CUES = r"(?i)licen[sc]|copyright|warrant|permission|redistribut|reserved|spdx|©"
#: Notices that are compared with, as they are commonly written. Fixed values.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU General Public License.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted.", "BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "Proprietary": ["All rights reserved.", "No part of this work may be reproduced without permission."],
}
#: Licences whose words also stand beside a named licence, which then counts.
GENERIC = ["Proprietary"]
#: Identifiers of an SPDX tag, in capitals, besides the names of the licences themselves.
SPDX = {"GPL-3.0-ONLY": "GPL-3.0", "GPL-3.0-OR-LATER": "GPL-3.0", "GPL-3.0+": "GPL-3.0"}
#: Names of licence files, in capitals, with any ending.
FILES = r"^(LICEN[SC]E|COPYING)([._-].*)?$"
TAG = r"(?i)SPDX-License-Identifier:[ \t]*([^\r\n]*)"


def terms(text: Column) -> Column:
    """Distinct lower-case terms: words and version numbers, and pairs of them."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.][0-9]+)*+"), F.lit(0))
    return F.element_at(F.transform(F.array(words), lambda own: F.concat(own, neighbours(own, lambda a, b: F.concat_ws(" ", a, b)))), 1)  # the words are bound once


def licence_lines(text: Column) -> Column:
    """Lines with a licence word, joined."""
    return F.array_join(F.filter(F.split(text, r"\R"), lambda line: line.rlike(CUES)), "\n")


def passages(text: Column) -> Column:
    """The licence lines, the paragraphs that hold one, and the licence lines of each with their neighbours there. Lines without a letter part paragraphs."""
    blocks = F.filter(F.split(text, r"\R(?:[^\p{L}\p{N}\r\n]*+\R)++"), lambda block: block.rlike(CUES))

    def near(block: Column) -> Column:
        lines = F.transform(F.split(block, r"\R"), lambda line: F.struct(line.alias("line"), line.rlike(CUES).alias("cue")))
        first = lambda i: F.greatest(F.lit(1), i + 1 - NEAR)
        some = lambda own: F.filter(own, lambda x, i: F.exists(F.slice(own, first(i), i + 2 + NEAR - first(i)), lambda y: y["cue"]))
        return F.element_at(F.transform(F.array(lines), lambda own: F.array_join(F.transform(some(own), lambda x: x["line"]), "\n")), 1)  # the lines are bound once

    return F.array_distinct(F.concat(F.array(licence_lines(text)), blocks, F.transform(blocks, near)))


def tagged(text: Column, names: list[str]) -> Column:
    """The licence of the first SPDX identifier that is known, else null."""
    known = {n.upper(): n for n in names} | {k: v for k, v in SPDX.items() if v in names}
    ids = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), lambda x: F.regexp_extract_all(F.upper(x), F.lit("[A-Z0-9.+-]++"), F.lit(0))))
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.create_map().cast("map<string,string>")
    return F.get(F.filter(F.transform(ids, lambda x: table[x]), lambda x: x.isNotNull()), F.lit(0))


def weighted(rows: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """key, term, w: term frequency by idf of the terms that a template has, from rows of (key, lines)."""
    counts = rows.select(key, F.explode(terms(F.col("lines"))).alias("term")).join(F.broadcast(idf), "term").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("idf").alias("idf"))
    return counts.select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))


def unit_vectors(vectors: DataFrame, key: str) -> DataFrame:
    norm = vectors.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return vectors.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def ancestors(path: Column) -> Column:
    """Structs (depth, dir) of the directories above a path, the root '' first."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(parts) - 1)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("dir")))


def scan(docs: DataFrame, path: str, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Return doc_id, path, licence, cosine, origin, licence_dir for every row of ``docs`` (doc_id, text and the columns of ``path``, SQL for the path).

    origin is ``own``, ``inherited`` (licence_dir is the directory it comes from) or ``none`` (licence null). Ties between templates go to the first by
    name. A null text is empty; a null path is '' (the root) and takes only the root's licence. Rows that are equal in path and text are judged
    alike; a directory's licence is that of its files named LICENSE, LICENCE or COPYING, with any ending, the first of them by path that is licensed. A
    directory without one carries nothing, whatever its documents say in their headers. No rows give no rows.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    rows = docs.select("doc_id", F.coalesce(F.expr(path).cast("string"), F.lit("")).alias("path"), whole_text("text").alias("text"))
    cue = F.col("text").rlike(CUES)
    rows = rows.select("doc_id", "path", F.when(cue, passages(F.col("text"))).alias("passages"), F.when(cue, tagged(F.col("text"), list(templates))).alias("tag"))
    rows = keep(rows.withColumn("id", F.sha2(F.array_join("passages", "\0").cast("binary"), 256)), "licence-passages")
    marked = rows.where("passages IS NOT NULL")
    parts = keep(marked.dropDuplicates(["id"]).select("id", F.explode("passages").alias("lines")).withColumn("part", F.sha2(F.col("lines").cast("binary"), 256)), "licence-parts")
    lines = keep(parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.first("lines").alias("lines")), "licence-distinct")
    known = spark.createDataFrame([(f"{k}:{i}", v) for k, own in templates.items() for i, v in enumerate(own)] or [(":0", "")], "template string, lines string")
    every = lines.select("n", F.array_distinct(terms(F.col("lines"))).alias("t")).unionByName(known.select(F.lit(1).cast("long").alias("n"), F.array_distinct(terms(F.col("lines"))).alias("t")))
    total = every.agg(F.sum("n")).first()[0]
    vocabulary = known.select(F.explode(terms(F.col("lines"))).alias("term")).distinct()
    frequency = every.select("n", F.explode("t").alias("term")).join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.sum("n").alias("df"))
    idf = keep(frequency.select("term", F.log(1 + F.lit(float(total)) / F.col("df")).alias("idf")), "licence-idf")
    shapes = unit_vectors(weighted(known, "template", idf), "template")  # a few templates of a few terms
    # Of a passage only the terms that a template has count for its own length, so that words around a notice do not hide it.
    texts = unit_vectors(keep(weighted(lines.select("part", "lines"), "part", idf), "licence-terms"), "part")
    cosine = texts.join(F.broadcast(shapes.withColumnRenamed("w", "v")), "term").groupBy("part", "template").agg(F.sum(F.col("w") * F.col("v")).alias("cosine"))
    cosine = cosine.withColumn("own", F.regexp_replace("template", ":[0-9]+$", ""))
    named = (F.col("cosine") >= threshold) & ~F.col("own").isin(GENERIC)
    order = F.struct((~named).alias("rest"), (-F.round("cosine", 9)).alias("far"), F.col("own").alias("name"))
    best = keep(cosine.groupBy("part").agg(F.min(order).alias("b")), "licence-best")
    best = keep(parts.select("id", "part").join(best, "part").groupBy("id").agg(F.min("b").alias("b")), "licence-nearest")
    best = best.select("id", F.col("b.name").alias("own"), F.round(-F.col("b.far"), 6).alias("cosine"))
    judged = marked.select("doc_id", "path", "id", "tag").join(best, "id", "left").select("doc_id", "path", F.coalesce("tag", "own").alias("own"), F.when(F.col("tag").isNotNull(), 1.0).otherwise(F.col("cosine")).alias("cosine"))
    none = {"own": F.lit(None).cast("string"), "cosine": F.lit(None).cast("double")}
    judged = judged.unionByName(rows.where("passages IS NULL").select("doc_id", "path").withColumns(none))  # most documents: they meet nothing
    judged = keep(judged.select("doc_id", "path", F.when(F.col("cosine") >= threshold, F.col("own")).alias("own"), "cosine"), "licence-own")
    parent = F.regexp_replace(F.regexp_replace("path", "[^/]*$", ""), "^/+|/+$", "")
    file = F.upper(F.substring_index("path", "/", -1)).rlike(FILES)
    carried = judged.where(F.col("own").isNotNull() & file).groupBy(parent.alias("dir")).agg(F.min_by("own", F.struct("path", "own")).alias("carried"))
    above = judged.where("own IS NULL").select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("a")).select("path", "a.*")
    inherited = above.join(carried, "dir").groupBy("path").agg(F.max(F.struct("depth", "dir", "carried")).alias("n")).select("path", F.col("n.dir").alias("dir"), F.col("n.carried").alias("carried"))
    out = judged.join(inherited, "path", "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("carried").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("own", "carried").alias("licence"), F.when(F.col("own").isNotNull(), F.col("cosine")).alias("cosine"), origin.alias("origin"), F.when(F.col("own").isNull(), F.col("dir")).alias("licence_dir"))

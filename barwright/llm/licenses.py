"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory with a licence file.

Everything is DataFrame and SQL functions. A unit is a line or a block of comment lines that holds an anchor word (a
header), or the whole text of a document with such a line (a possible licence file). Each identifier of an SPDX line is
a unit of one term, so that it matches its own licence or none; a line of several gives all of them. Units and templates
become term vectors; a term's document frequency is counted over all units and templates. A document's own licence is
the template of the best unit at or above `LEAST`. A document whose whole text reaches `LEAST_FILE` against a whole
licence text, or against any template if its name is that of a licence file, speaks for its directory; documents
without a licence of their own take that of the nearest directory above them that has one.

Defined results: null and empty texts have no licence of their own; a null path is the root. Ties go to the
template whose name comes first. A directory with several licence files takes the best match. Repeated rows give
equal rows. Other columns are left alone.
"""

from __future__ import annotations

from importlib.resources import files as package_files

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.shared import stored

LEAST = 0.6
LEAST_FILE = 0.6
ANCHORS = r"(?i)licen[sc]e|copyright|warrant|permission|spdx|redistribut|public domain|\bcc[ -]by\b|\bgpl\b"
COMMENT = r"^[ \t]*(?:#|//|/?\*|;|--|%)[^\n]*[A-Za-z]"  # a comment line that is not empty
FILE_NAME = r"(?i)(?:^|/)(?:(?:un)?licen[sc]e|copying|copyright|notice)(?:[.-][^/]*)?$"
WAYS = 8  # tasks that the directories below one licence file are spread over
SPDX = r"(?i)spdx-licen[sc]e-identifier:[ \t]*([^\n]*)"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"

# fixed values: short notices of public licences, several for one licence where it is announced in several ways
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved. No permission to copy or redistribute is granted."),
]


_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
for _name, _kind, _version in [(f"{k}GPL-{v}", n, v) for k, n, vs in (("", "General", "123"), ("L", "Lesser General", ("2.1", "3")), ("L", "Library General", "2"), ("A", "Affero General", "3")) for v in vs]:
    _name = _name if "." in _name else f"{_name}.0"
    for _what, _sign in (("program", ":"), ("library", ";")):
        TEMPLATES.append((_name, f"This {_what} is free software{_sign} " + _GNU.format(_kind, "," if _sign == ":" else ";", _version)))
    TEMPLATES.append((_name, f"This work is licensed under the GNU {_kind} Public License, version {_version}."))

# whole texts of licences, one for each file of the folder, for documents that are licence files
WHOLE = sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in (package_files("barwright.llm") / "licence_texts").iterdir() if f.name.endswith(".txt"))
TEMPLATES += WHOLE

# SPDX identifiers, with the endings that do not change the licence
IDENTIFIERS = "AFL-3.0 AGPL-3.0 Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.0 LGPL-2.1 LGPL-3.0 MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL OFL-1.1 Python-2.0 Unlicense WTFPL Zlib 0BSD".split()


def spdx_term(identifier: str) -> str:
    return "spdx" + identifier.lower().translate(str.maketrans("-.+", "xdp"))


TEMPLATES += [(i, spdx_term(i + end)) for i in IDENTIFIERS for end in (("", "-only", "-or-later", "+") if "GPL" in i else ("",))]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def directory(path: Column) -> Column:
    """The path without its last part; the root is an empty string."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def units(files: DataFrame) -> DataFrame:
    """file (id), unit (0: the whole text, from 1 the lines and comment blocks with an anchor), part (of an SPDX line),
    named (whether the path is that of a licence file), joint (what joins the parts) and the part's words."""
    one = lambda text: F.array(F.struct(text.alias("words"), F.lit("OR").alias("joint")))
    lines = F.split("text", "\n")
    hits = F.filter(lines, lambda line: line.rlike(ANCHORS))
    # a line that is no comment becomes a separator, so blocks of any length are cut without a backtracking pattern
    marked_lines = F.array_join(F.transform(lines, lambda line: F.when(line.rlike(COMMENT), line).otherwise(F.lit("\0"))), "\n")
    blocks = F.filter(F.transform(F.split(marked_lines, "\0"), lambda block: F.trim(F.lit("\n"), block)), lambda block: block.contains("\n") & block.rlike(ANCHORS))
    named = lambda line: F.regexp_extract_all(F.lower(F.regexp_extract(line, SPDX, 1)), F.lit(r"[a-z0-9][a-z0-9.+-]*"), F.lit(0))
    joint = lambda line: F.when(F.array_contains(named(line), "and"), "AND").otherwise("OR").alias("joint")
    term = lambda i: F.concat(F.lit("spdx"), F.translate(i, "-.+", "xdp")).alias("words")
    spdx = lambda line: F.transform(F.filter(named(line), lambda i: ~i.isin("and", "or", "with")), lambda i: F.struct(term(i), joint(line)))
    parts = F.transform(hits, lambda line: F.when(line.rlike(SPDX), spdx(line)).otherwise(one(line)))
    marked = files.filter(F.col("text").rlike(ANCHORS)).withColumn("named", F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)))
    each = marked.select("file", "named", F.posexplode(F.concat(F.array(one(F.col("text"))), parts, F.transform(blocks, one))).alias("unit", "parts"))
    return each.select("file", "named", "unit", F.posexplode("parts").alias("part", "p")).select("file", "named", "unit", "part", "p.joint", "p.words")


def vectors(units_: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, unit, part, term, w) and (name, nth, term, w): tf times smoothed idf over units and templates, length 1."""
    n = units_.select("file", "unit", "part").distinct().count() + templates.select("nth").distinct().count()
    both = units_.select("term").unionAll(templates.select("term"))
    idf = F.log(F.lit(float(n + 1)) / (F.count(F.lit(1)) + 1)) + 1
    weights = stored(both.groupBy("term").agg(idf.alias("idf")), "licence-idf")

    def normal(rows: DataFrame, keys: list[str]) -> DataFrame:
        raw = rows.join(weights, "term").withColumn("w", F.col("tf") * F.col("idf"))
        return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys))))

    return normal(units_, ["file", "unit", "part"]), normal(templates, ["nth"])


def own_licences(files: DataFrame) -> DataFrame:
    """file, licence, score and the same of the whole text (file_licence, file_score) where a unit is close enough."""
    spark = files.sparkSession
    counted = lambda df, keys: df.select(*keys, F.explode(terms(F.col("words"))).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    keys = ["file", "unit", "part", "named", "joint"]
    unit_terms = stored(counted(units(files), keys), "licence-units")
    whole_texts = {text for _, text in WHOLE}
    texts = spark.createDataFrame([(i, name, text in whole_texts, text) for i, (name, text) in enumerate(TEMPLATES)], "nth int, name string, whole boolean, words string")
    unit_vectors, template_vectors = vectors(unit_terms, counted(texts, ["nth", "name", "whole"]))
    known = template_vectors.select("term", "nth", "name", "whole", F.col("w").alias("tw"))  # a row for each term of the fixed templates
    near = unit_vectors.join(F.broadcast(known), "term").groupBy(*keys, "nth", "name", "whole").agg(F.sum(F.col("w") * F.col("tw")).alias("cosine"))
    best = lambda when: F.min(F.when(when, F.struct((-F.round("cosine", 9)).alias("minus"), F.col("name").alias("name"))))
    speaks = (F.col("unit") == 0) & (F.col("cosine") >= LEAST_FILE) & (F.col("whole") | F.col("named"))
    parts = near.groupBy("file", "unit", "part", "joint").agg(best(F.col("cosine") >= LEAST).alias("own"), best(speaks).alias("all")).filter("own is not null")
    names = F.array_sort(F.collect_set("own.name"))
    joined = F.when(F.max("joint") == "AND", F.array_join(names, " AND ")).otherwise(F.array_join(names, " OR "))
    lines = parts.groupBy("file", "unit").agg(F.struct(F.max("own.minus").alias("minus"), joined.alias("name")).alias("own"), F.min("all").alias("all"))
    found = lines.groupBy("file").agg(F.min("own").alias("own"), F.min("all").alias("all"))
    return found.select("file", F.col("own.name").alias("licence"), (-F.col("own.minus")).alias("score"), F.col("all.name").alias("file_licence"), (-F.col("all.minus")).alias("file_score"))


def inherited(directories: DataFrame, spoken: DataFrame) -> DataFrame:
    """dir, up, licence: for each directory the nearest one above or at it that `spoken` (dir, licence) has."""
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    spread = directories.select("dir", F.explode(F.array_distinct(above)).alias("up"))
    # a licence at the root meets every directory: they are spread over tasks
    way = F.pmod(F.xxhash64("dir"), F.lit(WAYS))
    known = spoken.select(F.col("dir").alias("up"), "licence", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1)).cast("array<long>")).alias("way"))
    met = spread.withColumn("way", way).join(known, ["up", "way"])
    nearest = met.groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), "up", "licence")).alias("m"))
    return nearest.select("dir", F.col("m.up").alias("up"), F.col("m.licence").alias("licence"))


def scan(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """file, path, `keep`, licence, score, basis (file, header, inherited or none) and the directory inherited from,
    for every row of files (file, path, text); `file` names a row."""
    found = stored(own_licences(files), "licence-own")
    placed = files.select("file", "path", *keep, directory(F.col("path")).alias("dir")).join(found, "file", "left")
    spoken = placed.filter("file_licence is not null").groupBy("dir").agg(F.min(F.struct(-F.col("file_score"), F.col("file_licence"))).alias("m"))
    spoken = spoken.select("dir", F.col("m.file_licence").alias("licence"))
    above = stored(inherited(files.select(directory(F.col("path")).alias("dir")).distinct(), spoken), "licence-dirs")
    out = placed.join(above.select("dir", "up", F.col("licence").alias("from_above")), "dir", "left")
    basis = F.when(F.col("file_licence").isNotNull(), "file").when(F.col("licence").isNotNull(), "header").when(F.col("from_above").isNotNull(), "inherited").otherwise("none")
    return out.select("file", "path", *keep, F.coalesce("file_licence", "licence", "from_above").alias("licence"), F.coalesce("file_score", "score", F.lit(0.0)).alias("score"), basis.alias("basis"), F.when(basis == "inherited", F.col("up")).alias("inherited_from"))


def op9_license_scan(spark, folder: str) -> DataFrame:
    """All documents as files of their source's and language's directory."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    part = lambda c: F.coalesce(F.regexp_replace(F.col(c), "/", "_"), F.lit("none"))
    path = F.concat_ws("/", part("source"), part("lang"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    # a row is known by its file and place there, so rows without doc_id, or of one doc_id, stay apart
    row = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), "_metadata.row_index")
    files = docs.select(row.alias("file"), "doc_id", path.alias("path"), "text")
    return scan(files, ("doc_id",)).select("doc_id", "path", "licence", F.round("score", 6).alias("score"), "basis", "inherited_from")

"""Licence scans by the Dice coefficient over word bigrams. [native]

Lines of a text, and its paragraphs of several lines, are the segments. A segment is normalised (lower case,
anything but letters and digits a space) and becomes a set of word bigrams. A template of s bigrams can only
reach the coefficient `least` with segments of s * least / (2 - least) to s * (2 - least) / least bigrams;
segments outside the bounds of all templates are dropped before their bigrams are made, and each template
is a candidate within its own bounds only. Bigrams meet the templates' in an index with a row for each bigram and
template, whose size the template list bounds (a few thousand rows), so it is broadcast; shared ones are
counted by segment and template with partial sums.

One row a document and licence found: the best coefficient and the number of segments that reach `least`.
Null and empty texts have no segments, and an empty table gives an empty result. Very long texts are scanned whole; only their
segments within the bounds become bigrams. Of templates of one licence the best coefficient counts, so ties among them don't show.
Repeated rows are documents of their own. Extra columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 0.8

# Licence statements and notices, as their publishers word them.
TEMPLATES = [
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the '
        "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing '
        "permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def templates(spark: SparkSession) -> DataFrame:
    """template (number), licence, body."""
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(TEMPLATES)], "template int, licence string, body string")


def _words(text):
    """The words of a text that may have several lines."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _bigrams(words: str):
    return F.array_distinct(F.slice(F.zip_with(words, F.slice(words, 2, 2_000_000_000), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(words) - 1, F.lit(0))))


def template_index(known: DataFrame, least: float = LEAST) -> DataFrame:
    """bigram, template, licence, t_size, lo, hi: a row for each bigram and template."""
    sized = known.withColumn("w", _words("body")).withColumn("b", _bigrams("w")).withColumn("t_size", F.size("b"))
    sized = sized.withColumn("lo", F.ceil(F.col("t_size") * (least / (2 - least)) - 1e-9)).withColumn("hi", F.floor(F.col("t_size") * ((2 - least) / least) + 1e-9))
    return sized.select("template", "licence", "t_size", "lo", "hi", F.explode("b").alias("bigram"))


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, licence, score, n_segments."""
    index = template_index(known, least)
    lo, hi = index.agg(F.min("lo"), F.max("hi")).first()
    lines = F.split(F.col("text"), "\n")
    parts = F.filter(F.split(F.col("text"), r"\n[\x20\x09-\x0D]*\n"), lambda p: p.contains("\n"))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    own = own.select("rid", "doc_id", F.posexplode(F.concat(lines, parts)).alias("seg", "body")).withColumn("w", _words("body"))
    # bounds as conditions inside expressions: filters would be pushed below and have words and bigrams made twice
    own = own.withColumn("b", F.when(F.size("w") > lo, _bigrams("w"))).withColumn("size", F.size("b"))
    own = own.select("rid", "doc_id", "seg", "size", F.explode(F.when(F.col("size") <= hi, F.col("b"))).alias("bigram"))
    met = own.join(F.broadcast(index), "bigram").where(F.col("size").between(F.col("lo"), F.col("hi")))
    met = met.groupBy("rid", "doc_id", "seg", "size", "template", "licence", "t_size").agg(F.count(F.lit(1)).alias("shared"))
    met = met.withColumn("score", F.round(2 * F.col("shared") / (F.col("size") + F.col("t_size")), 6)).where(F.col("score") >= least)
    return met.groupBy("rid", "doc_id", "licence").agg(F.max("score").alias("score"), F.countDistinct("seg").alias("n_segments")).drop("rid")


def op3_licence_scan(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), templates(spark))


def _sql() -> str:
    known = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
    words = r"list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    bigrams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
    WITH t AS (SELECT *, len(b) AS t_size FROM (SELECT *, {bigrams} AS b FROM (SELECT template, licence, {words.format("body")} AS w FROM (VALUES {known}) v(template, licence, body)))),
    i AS (SELECT template, licence, t_size, unnest(b) AS bigram FROM t),
    d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents WHERE text IS NOT NULL),
    s AS (SELECT rid, doc_id, unnest(l) AS body, unnest(range(len(l))) AS seg FROM (SELECT rid, doc_id,
        list_concat(string_split(text, chr(10)), list_filter(regexp_split_to_array(text, '\n[\x20\x09-\x0D]*\n'), lambda p: contains(p, chr(10)))) AS l FROM d)),
    b AS (SELECT *, len(b) AS size FROM (SELECT rid, doc_id, seg, {bigrams} AS b FROM (SELECT *, {words.format("body")} AS w FROM s))),
    m AS (SELECT rid, doc_id, seg, size, template, licence, t_size, count(*) AS shared FROM (SELECT rid, doc_id, seg, size, unnest(b) AS bigram FROM b) JOIN i USING (bigram) GROUP BY ALL),
    r AS (SELECT *, round(2 * shared / (size + t_size), 6) AS score FROM m)
    SELECT doc_id, licence, max(score) AS score, count(DISTINCT seg) AS n_segments FROM r WHERE score >= {LEAST} GROUP BY rid, doc_id, licence"""


ORACLE_SQL = _sql()

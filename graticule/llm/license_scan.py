"""License scans: TF-IDF cosines to templates, then inheritance from the nearest ancestor directory.

Every line of a text that has a word of the templates' vocabulary is a candidate notice.  Its words, and a template's, are
weighted by term frequency and inverse template frequency (words of no template count as rarest); the cosine of the two
sparse vectors is a join on words and a sum.  A text's own licence is that of its best line, from ``LEAST`` on.

A file without a licence takes that of the nearest ancestor directory that has a licence file; of several in a directory the
one with the best score, then the smallest path.  Directories, not files, meet their ancestors: each distinct directory is
exploded into its prefixes, joined to the licensed ones, and keeps the deepest; files then join on their directory.

Only DataFrame functions are used.  Null texts have no licence; null or empty paths have no ancestors but the root "".
Equal lines are scored once.  Rows with equal paths are all returned.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_groups, table

LEAST = 0.6
#: Documents of at most so many words that carry a notice serve as licence files: of their source, of their language.
SOURCE_WORDS, LANGUAGE_WORDS = 25, 60

#: Short notices by licence.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("lgpl-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("mpl-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
)
#: Words that make no line a candidate.
COMMON = ("a", "all", "and", "any", "are", "by", "can", "file", "in", "is", "it", "of", "or", "person", "the", "this", "to", "under", "use", "with", "you", "your", "not", "may", "work")

_TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def template_vectors() -> list[tuple[int, str, str, float, float]]:
    """(template, license, term, weight, idf): unit vectors of the fixed templates."""
    bags = [Counter(re.findall(_TERM, notice.lower())) for _, notice in TEMPLATES]
    idf = {t: math.log((len(bags) + 1) / (sum(t in b for b in bags) + 1) + 1) for b in bags for t in b}
    out = []
    for i, bag in enumerate(bags):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        out += [(i, TEMPLATES[i][0], t, n * idf[t] / norm, idf[t]) for t, n in sorted(bag.items())]
    return out


def _inline(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small fixed table as a literal of the plan."""
    values = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])
    return spark.range(1).select(F.explode(values).alias("r")).select("r.*")


def best_lines(docs: DataFrame, key: str) -> DataFrame:
    """``docs(key, text)`` -> (key, license, score) of texts with a notice."""
    spark = docs.sparkSession
    vectors = template_vectors()
    rare = math.log(len(TEMPLATES) + 2)
    vocabulary = sorted({v[2] for v in vectors} - set(COMMON))
    pattern = "(?i)(?<![a-z0-9])(?:" + "|".join(t.replace(".", "\\.") for t in vocabulary) + ")(?![a-z0-9])"
    lines = docs.select(key, F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.col("line").rlike(pattern))
    # a line is known by its digest: its words don't carry it along
    lines = cut(lines.withColumn("__line", F.md5("line")), "license-lines")
    # some hundred rows, fixed
    known = F.broadcast(_inline(spark, ["template", "license", "term", "weight"], [v[:4] for v in vectors]))
    idf = F.broadcast(_inline(spark, ["term", "idf"], sorted({(v[2], v[4]) for v in vectors})))
    each = lines.groupBy("__line").agg(F.count("*").alias("n"), F.first("line").alias("line"))
    words = each.select("__line", "n", F.explode(terms(F.col("line"))).alias("term")).groupBy("__line", "term").agg(F.count("*").alias("tf"), F.max("n").alias("n"))
    weighed = words.join(idf, "term", "left").select("__line", "term", "n", (F.col("tf") * F.coalesce("idf", F.lit(rare))).alias("w"))
    norm = weighed.groupBy("__line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.max("n").alias("n"))
    dots = weighed.join(known, "term").groupBy("__line", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norm, "__line").select("__line", "license", "n", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= LEAST)
    best = cut(scored.groupBy("__line").agg(F.max_by(F.struct("license", "score"), F.struct("score", "license")).alias("b"), F.max("n").alias("n")), "license-best")
    # a notice that is everywhere doesn't gather its lines in one task
    return join_groups(lines.select(key, "__line"), best, "__line", "n").groupBy(key).agg(F.max_by("b", F.struct("b.score", "b.license")).alias("b")).select(key, "b.license", "b.score")


def inherited(files: DataFrame) -> DataFrame:
    """``files(path, is_license_file, license, score)`` -> directory, license, origin: what each directory of a file hands down."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    files = files.select("path", folder.alias("folder"), "is_license_file", "license", "score").where("path is not null")
    given = files.where("is_license_file and license is not null").groupBy("folder").agg(F.min_by("license", F.struct((-F.col("score")).alias("s"), "path", "license")).alias("license"))
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = files.select("folder").distinct().select("folder", F.explode(F.array_distinct(above)).alias("origin"))
    met = folders.join(given.withColumnRenamed("folder", "origin"), "origin")
    return met.groupBy("folder").agg(F.max_by(F.struct("license", "origin"), F.length("origin")).alias("b")).select("folder", "b.license", "b.origin")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source/language/thousand/id.txt; short ones with a notice are licence files higher up.

    Returns doc_id, path, license, score, origin: "own", the directory that handed the licence down, or null.
    """
    docs = table(spark, sf_dir, "documents")
    n = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0))
    rows = docs.select(F.xxhash64("doc_id", "text", "source", "lang").alias("row"), "doc_id", "source", "lang", n.alias("n"), "text")
    notices = best_lines(rows.select("row", "text"), "row").withColumnRenamed("license", "own").withColumnRenamed("score", "own_score")
    small = cut(rows.drop("text"), "license-rows").join(notices, "row", "left")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    top, middle = F.coalesce("source", F.lit("null")), F.coalesce("lang", F.lit("null"))
    notice = F.col("own").isNotNull()
    path = (
        F.when(notice & (F.col("n") <= SOURCE_WORDS), F.concat(top, F.lit("/LICENSE-"), name))
        .when(notice & (F.col("n") <= LANGUAGE_WORDS), F.concat(top, F.lit("/"), middle, F.lit("/LICENSE-"), name))
        .otherwise(F.concat(top, F.lit("/"), middle, F.lit("/"), F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("null")), F.lit("/"), name, F.lit(".txt")))
    )
    files = cut(small.select("doc_id", path.alias("path"), "own", "own_score", (notice & (F.col("n") <= LANGUAGE_WORDS)).alias("is_license_file")), "license-files")
    handed = inherited(files.select("path", "is_license_file", F.col("own").alias("license"), F.col("own_score").alias("score")))
    out = files.withColumn("folder", F.regexp_replace("path", "/?[^/]*$", "")).join(handed, "folder", "left")
    origin = F.when(F.col("own").isNotNull(), F.lit("own")).otherwise(F.col("origin"))
    return out.select("doc_id", "path", F.coalesce("own", "license").alias("license"), F.col("own_score").alias("score"), origin.alias("origin"))


def _sql() -> str:
    values = ", ".join(f"({i}, '{name}', '{term}', {w!r}::DOUBLE, {idf!r}::DOUBLE)" for i, name, term, w, idf in template_vectors())
    vocabulary = ", ".join(f"'{t}'" for t in sorted({v[2] for v in template_vectors()} - set(COMMON)))
    return rf"""
WITH vec(template, license, term, weight, idf) AS (VALUES {values}),
files AS (
  SELECT row_number() OVER () AS r, doc_id, source, lang, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM documents),
lines AS (SELECT DISTINCT r, unnest(string_split(text, chr(10))) AS line FROM files),
bags AS (SELECT DISTINCT line, regexp_extract_all(lower(line), '{_TERM}') AS ts FROM lines),
words AS (SELECT line, term, count(*) AS tf FROM (SELECT line, unnest(ts) AS term FROM bags WHERE list_has_any(ts, [{vocabulary}])) GROUP BY line, term),
weighed AS (SELECT line, words.term, tf * coalesce(i.idf, {math.log(len(TEMPLATES) + 2)!r}::DOUBLE) AS w FROM words LEFT JOIN (SELECT DISTINCT term, idf FROM vec) i ON words.term = i.term),
norms AS (SELECT line, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY line),
scored AS (
  SELECT d.line, license, round(dot / norm, 6) AS score FROM (
    SELECT line, template, license, sum(w * weight) AS dot FROM weighed JOIN vec ON weighed.term = vec.term GROUP BY line, template, license) d JOIN norms ON norms.line = d.line
  WHERE round(dot / norm, 6) >= {LEAST}),
own AS (
  SELECT r, license AS own, score FROM (
    SELECT r, license, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, license DESC) AS k FROM lines JOIN scored ON lines.line = scored.line) WHERE k = 1),
placed AS (
  SELECT files.r, doc_id, own, score, n, own IS NOT NULL AND n <= {LANGUAGE_WORDS} AS is_file,
    CASE WHEN own IS NOT NULL AND n <= {SOURCE_WORDS} THEN coalesce(source, 'null') || '/LICENSE-' || coalesce(CAST(doc_id AS VARCHAR), 'null')
      WHEN own IS NOT NULL AND n <= {LANGUAGE_WORDS} THEN coalesce(source, 'null') || '/' || coalesce(lang, 'null') || '/LICENSE-' || coalesce(CAST(doc_id AS VARCHAR), 'null')
      ELSE coalesce(source, 'null') || '/' || coalesce(lang, 'null') || '/' || coalesce(CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR), 'null') || '/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '.txt' END AS path
  FROM files LEFT JOIN own ON files.r = own.r),
foldered AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS folder FROM placed),
given AS (
  SELECT folder, own AS license FROM (SELECT folder, own, row_number() OVER (PARTITION BY folder ORDER BY score DESC, path, own) AS k FROM foldered WHERE is_file) WHERE k = 1),
handed AS (
  SELECT folder, license, origin FROM (
    SELECT f.folder, given.license, given.folder AS origin, row_number() OVER (PARTITION BY f.folder ORDER BY length(given.folder) DESC) AS k
    FROM (SELECT DISTINCT folder FROM foldered) f JOIN given ON f.folder = given.folder OR starts_with(f.folder, given.folder || '/') OR given.folder = '') WHERE k = 1)
SELECT doc_id, path, coalesce(own, handed.license) AS license, score, CASE WHEN own IS NOT NULL THEN 'own' ELSE handed.origin END AS origin
FROM foldered LEFT JOIN handed ON foldered.folder = handed.folder
"""


OP3_SQL = _sql()

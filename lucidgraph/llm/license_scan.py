"""License scan in DataFrame functions alone: MinHash bands over text windows, then exact containment.

Words are runs of letters and digits in lower case; shingles are N words. Templates fall into classes by their
number of shingles, up to a power of two T; texts are cut into windows of 2 T shingles, T apart, so that any run of
T shingles lies whole in a window. A window that holds the asked-for share of a template has a Jaccard similarity
to it of at least share * (T / 2) / (2 T + (1 - share) * T / 2); bands of one MinHash each are as many as make a
collision at that similarity as likely as HIT. Bands that collide retrieve the template, and the window's own
shingles decide. A band cannot collide where no shingle of any template occurs, so texts and windows without one
are passed over first.

Defined cases: null texts and texts of fewer than N words match nothing. Rows that repeat an id, or have none, are
reported together. Templates need at least N words; a text that holds several is reported for each, and of equal
containments the largest is shown once. Texts may be of any length; an empty table gives no rows. Other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph.llm.common import table

#: Words in a shingle, share of a template's shingles that must be found, likelihood of retrieval.
N, SHARE, HIT = 5, 0.8, 0.999
_SPLIT = r"[^\p{L}\p{N}]+"

TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def shingles_of(words: Column, n: int) -> Column:
    """Each n words joined by a space."""
    at = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.concat_ws(" ", F.slice(words, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def hashes_of(words: Column, n: int) -> Column:
    at = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def class_of(n_shingles: int) -> int:
    return 1 << max(0, n_shingles - 1).bit_length()


def n_bands(share: float, hit: float) -> int:
    """Bands of one row that collide with likelihood hit at the least similarity of a matching window."""
    least = share / 2 / (2 + (1 - share) / 2)
    return math.ceil(math.log(1 - hit) / math.log(1 - least))


def _bands(hashes: Column, bands: int) -> Column:
    seeds = F.array(*[F.lit(s) for s in range(1, bands + 1)])
    return F.transform(seeds, lambda s: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, s))))


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", n: int = N, share: float = SHARE, hit: float = HIT) -> DataFrame:
    """One row for each text and template that it holds: id, license, n_windows, first_word, containment."""
    spark = docs.sparkSession
    rows = []
    for name, text in templates.items():
        words = template_words(text)
        if len(words) < n:
            raise ValueError(f"template {name} has fewer than {n} words")
        rows.append((name, words, class_of(len({tuple(words[i : i + n]) for i in range(len(words) - n + 1)}))))
    bands = n_bands(share, hit)
    known = spark.createDataFrame(rows, "license string, _words array<string>, _class int")
    known = known.select("license", "_class", F.array_distinct(shingles_of(F.col("_words"), n)).alias("_template"), hashes_of(F.col("_words"), n).alias("_hashes"))
    shingle_hashes = sorted({h for r in known.select("_hashes").collect() for h in r[0]})  # of the templates
    every = F.array(*[F.lit(h).cast("long") for h in shingle_hashes])
    table_ = known.select("license", "_class", "_template", F.posexplode(_bands(F.col("_hashes"), bands)).alias("_band", "_min"))

    # Generated columns are computed once; projected ones would be computed again wherever a lambda names them.
    words = F.array_remove(F.split(F.lower(F.col(text_col)), _SPLIT), "")
    texts = docs.select(F.col(id_col).alias("_id"), F.explode(F.array(words)).alias("_words"))
    texts = texts.select("_id", "_words", F.explode(F.array(hashes_of(F.col("_words"), n))).alias("_hashes"))
    texts = texts.filter(F.arrays_overlap("_hashes", every))
    sizes = F.array(*[F.lit(c) for c in sorted({r[2] for r in rows})])
    spread = texts.select("*", F.explode(sizes).alias("_class"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(1), F.size("_hashes"), F.col("_class"))).alias("_at"))
    cut = F.struct(F.slice("_words", F.col("_at"), 2 * F.col("_class") + (n - 1)).alias("words"), F.slice("_hashes", F.col("_at"), 2 * F.col("_class")).alias("hashes"))
    windows = spread.select("_id", "_class", "_at", F.explode(F.array(cut)).alias("_cut")).filter(F.arrays_overlap("_cut.hashes", every))
    windows = windows.select("_id", "_class", "_at", F.col("_cut.words").alias("_words"), F.col("_cut.hashes").alias("_hashes"))
    probes = windows.select("_id", "_class", "_at", "_words", F.posexplode(_bands(F.col("_hashes"), bands)).alias("_band", "_min"))
    found = probes.join(F.broadcast(table_), ["_class", "_band", "_min"])  # as small as the templates
    held = F.size(F.array_intersect(shingles_of(F.col("_words"), n), F.col("_template"))) / F.size("_template")
    found = found.withColumn("_held", held).filter(F.col("_held") >= share)
    windows = found.groupBy("_id", "license", "_at").agg(F.max("_held").alias("_held"))
    out = windows.groupBy("_id", "license").agg(F.count("*").alias("n_windows"), F.min("_at").cast("long").alias("first_word"), F.round(F.max("_held"), 6).alias("containment"))
    return out.withColumnRenamed("_id", id_col)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP9_SQL = rf"""
WITH t AS (
  SELECT license, list_distinct(list_transform(generate_series(1, len(w) - {N - 1}), lambda i: array_to_string(w[i:(i + {N - 1})], ' '))) AS shingles
  FROM (VALUES {", ".join(f"({_quoted(k)}, string_split({_quoted(' '.join(template_words(v)))}, ' '))" for k, v in TEMPLATES.items())}) AS v(license, w)
), classed AS (SELECT *, (2 ** ceil(log2(len(shingles))))::BIGINT AS size FROM t),
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
), grams AS (
  SELECT doc_id, list_transform(generate_series(1, len(w) - {N - 1}), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) AS g FROM words WHERE len(w) >= {N}
), hits AS (
  SELECT doc_id, license, size, len(shingles) AS n, g, shingles FROM grams JOIN classed ON list_has_any(g, shingles)
), windows AS (
  SELECT doc_id, license, n, pos, len(list_intersect(g[pos:(pos + 2 * size - 1)], shingles)) AS held
  FROM hits, unnest(generate_series(1, len(g), size)) AS s(pos)
)
SELECT doc_id, license, count(*) AS n_windows, min(pos) AS first_word, round(max(held / n), 6) AS containment
FROM windows WHERE held / n >= {SHARE} GROUP BY doc_id, license
"""

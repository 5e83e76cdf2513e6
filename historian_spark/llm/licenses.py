"""License scans with DataFrame functions only.

The text is cut into windows of six words that start at every second word, each the set of its
two runs of five words, so that every run lies in one window. ``BANDS`` seeded hash functions
give a window as many minimum hashes, each a band of one row. A window that holds a template's
shingle meets it in a band if there the shingle's hash is the smaller of two, so in one band at
least with a probability of 1 - 2^-BANDS, whatever stands beside it. A broadcast table of the
templates' band values, whose size is that of the list of templates, retrieves the shingle; the
words at the window's place then verify it exactly. Distinct verified shingles are counted for
each row and template, and the share of a template's shingles decides (0.8 or more). All of this
is one pass over the texts; only verified shingles move.

Cases: words are runs of letters a-z and digits after lower-casing; a text with fewer than five
words, a null or an empty one has no license; a license is one row a document row, however
often it occurs; a text of any length is one row of arrays of its words and their hashes, some
50 bytes a word; repeated rows and null ids give rows of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
SHARE = 0.8
BANDS = 20

#: Notices of public licenses.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_shingles(text: str) -> list[str]:
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    return list(dict.fromkeys(" ".join(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _run_hash(words: Column, k: Column) -> Column:
    """Hash of the five word hashes from place k (from 0); get() reads one element, slice() would copy the array."""
    return F.xxhash64(*[F.get(words, k + j) for j in range(SHINGLE)])


def _in_band(shingle: Column, band: int) -> Column:
    """The hash function of a band, on the hash of a shingle; null for a null."""
    return F.when(shingle.isNotNull(), F.xxhash64(shingle, F.lit(band)))


def _index(spark, templates: dict[str, str], bands: int) -> DataFrame:
    """value, license, shingle, number and total: a row for each band of each shingle of each template."""
    rows = [(name, k, s, len(found)) for name, found in ((n, template_shingles(t)) for n, t in templates.items()) for k, s in enumerate(found)]
    df = spark.createDataFrame(rows, "license string, number int, shingle string, total int")
    hashed = df.withColumn("h", _run_hash(F.transform(F.split("shingle", " "), lambda w: F.xxhash64(w)), F.lit(0)))
    return hashed.select(F.explode(F.array(*[_in_band(F.col("h"), k) for k in range(bands)])).alias("value"), "license", "shingle", "number", "total")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, bands: int = BANDS, share: float = SHARE) -> DataFrame:
    """doc_id, license, matched and total shingles of the template, containment; a row for each license of each row of docs."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a row's number; it is made and used in one job, and never joined with another's
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", _words(F.col("text")).alias("words"))
    rows = rows.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("w"))
    firsts = F.when(F.size("w") >= SHINGLE, F.sequence(F.lit(0), F.size("w") - SHINGLE, F.lit(2))).otherwise(F.array().cast("array<int>"))
    windows = rows.select("row_id", "doc_id", "words", "w", F.explode(firsts).alias("at"))
    second = F.when(F.col("at") + SHINGLE < F.size("w"), _run_hash(F.col("w"), F.col("at") + 1))
    windows = windows.select("row_id", "doc_id", "words", "at", _run_hash(F.col("w"), F.col("at")).alias("a"), second.alias("b"))
    # least() skips a null
    signature = F.array(*[F.least(_in_band(F.col("a"), k), _in_band(F.col("b"), k)) for k in range(bands)])
    met = windows.select("row_id", "doc_id", "words", "at", F.explode(signature).alias("value")).join(F.broadcast(_index(docs.sparkSession, templates, bands)), "value")
    run = lambda k: F.array_join(F.slice("words", k + 1, SHINGLE), " ")
    verified = met.where((run(F.col("at")) == F.col("shingle")) | (run(F.col("at") + 1) == F.col("shingle")))
    counted = verified.groupBy("row_id", "doc_id", "license", "total").agg(F.count_distinct("number").cast("int").alias("matched"))
    found = counted.where(F.col("matched") >= share * F.col("total") - 1e-9)
    return found.select("doc_id", "license", "matched", "total", (F.col("matched") / F.col("total")).alias("containment"))


def containment_sql(templates: dict[str, str] = TEMPLATES, share: float = SHARE) -> str:
    """The same rows in SQL: every shingle of every text against every template's."""
    listed = ",".join(f"('{name}','{s}',{len(shingles)})" for name, shingles in ((n, template_shingles(t)) for n, t in templates.items()) for s in shingles)
    return f"""
    WITH templates(license, shingle, total) AS (VALUES {listed}),
    words AS (SELECT row_number() OVER () AS row_id, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
    starts AS (SELECT row_id, doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM words WHERE len(w) >= 5),
    shingles AS (SELECT DISTINCT row_id, doc_id, array_to_string(w[k:k+4], ' ') AS shingle FROM starts)
    SELECT doc_id, license, CAST(count(*) AS INTEGER) AS matched, CAST(any_value(total) AS INTEGER) AS total, count(*) / any_value(total) AS containment
    FROM shingles JOIN templates USING (shingle) GROUP BY row_id, doc_id, license HAVING count(*) >= {share} * any_value(total) - 1e-9
    """

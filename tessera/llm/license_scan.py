"""License scans: MinHash bands over overlapping text windows, in DataFrame functions only.

Templates and texts are lower-cased words in five-word shingles; templates of fewer
words are one shingle of their own length, for which only texts with the template's
longest word are looked through. Texts are cut into words once for all. Templates of
alike lengths form a class; a class of size c cuts texts into windows of 2c
shingles, c apart, so any c shingles in a row lie in some window whole. Every band
is one MinHash value. A window that holds four fifths of a template has a Jaccard
similarity of at least 0.19 with it, so one of 48 bands agrees with probability
0.99996 or more. A band can only agree where the shingle with the template's least
hash stands, so texts and windows without any such shingle are passed over before
anything is hashed again; that loses nothing. Windows whose band agrees are
verified by exact containment of the template's shingles. Every input row has a
number of its own on the way, so rows that share an id, or have none, never mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 48
CONTAINMENT = 0.8

#: Notices of common licenses, and the lines by which files name theirs.
TEMPLATES: dict[str, str] = {
    "AGPL-notice": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "Artistic-2.0": "This package is distributed under the terms of the Artistic License 2.0.",
    "BSD-2-Clause": "Use of this source code is governed by a BSD-2-Clause license.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-disclaimer": "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    "BSD-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "GFDL-notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT-warranty": "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "all-rights-reserved": "All rights reserved.",
    "public-domain": "This work is in the public domain.",
    "spdx-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "spdx-BSD-2-Clause": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-GPL-2.0": "SPDX-License-Identifier: GPL-2.0",
    "spdx-GPL-3.0": "SPDX-License-Identifier: GPL-3.0",
    "spdx-ISC": "SPDX-License-Identifier: ISC",
    "spdx-MIT": "SPDX-License-Identifier: MIT",
    "spdx-MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: str, q: int = SHINGLE) -> Column:
    """Hashes of the ``q``-word shingles of a column of words, in order; a shorter text is one shingle, a text without words none."""
    return F.expr(
        f"CASE WHEN size({words}) >= {q} THEN transform(sequence(1, size({words}) - {q - 1}), i -> xxhash64(slice({words}, i, {q}))) "
        f"WHEN size({words}) > 0 THEN array(xxhash64({words})) ELSE cast(array() AS array<bigint>) END"
    )


def once(df: DataFrame, *keep: str, **made: Column) -> DataFrame:
    """Add columns that are evaluated once a row: a generator of one row keeps the optimizer from copying them into every use."""
    for name, column in made.items():
        df = df.select(*keep, F.explode(F.array(column)).alias(name))
    return df


def band(values: str, number: str) -> str:
    return f"array_min(transform({values}, x -> xxhash64(x, {number})))"


def template_rows(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """Shingles, their length in words, class size and, per band, the shingle of least hash with that hash. At most one block of templates comes to the driver."""
    rows = spark.createDataFrame(sorted(templates.items()), "template_id string, t string").select("template_id", words_of(F.col("t")).alias("words"))
    lengths = F.array(*(shingles_of("words", q) for q in range(1, SHINGLE + 1)))
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    rows = rows.where(F.size("words") > 0).withColumn("q", F.least(F.size("words"), F.lit(SHINGLE))).withColumn("shingles", F.array_distinct(lengths[F.col("q") - 1]))
    least = F.expr(f"transform(sequence(0, {BANDS - 1}), b -> array_min(transform(shingles, x -> struct(xxhash64(x, b) as h, x as s))))")
    out = []
    for r in rows.select("template_id", "shingles", "q", least.alias("least"), longest.alias("longest")).orderBy("template_id").collect():
        size = 1
        while size < len(r.shingles):
            size *= 2
        out.append({"template_id": r.template_id, "shingles": list(r.shingles), "q": r.q, "size": size, "longest": r.longest, "bands": [(x.h, x.s) for x in r.least]})
    return out


def _longs(values) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, block_templates: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document id and template it holds: ``id_col, template_id, containment, first_word``.

    ``containment`` is the greatest share of the template's shingles in one window
    and ``first_word`` the place of the first such window. Whole texts are scanned,
    however long. Null and empty texts hold no template, and neither do texts of fewer
    words than a template's shingles have. Rows of one id are scanned each and give
    one row with the best of them, as do null ids. A template without words is held
    by nothing. No template or no text gives no rows. Other columns are not read. More
    than ``block_templates`` templates take further passes, so plans and broadcasts
    stay bounded.
    """
    chosen = sorted((TEMPLATES if templates is None else templates).items())
    slim = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.monotonically_increasing_id().alias("row"))
    words = once(slim, "k", "row", words=words_of(F.col("t")))
    found = None
    for start in range(0, len(chosen), block_templates):
        rows = template_rows(docs.sparkSession, dict(chosen[start : start + block_templates]))
        if rows:
            part = _scan_block(words, rows, docs.sparkSession)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = slim.where(F.lit(False)).select("k", F.lit("").alias("template_id"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word"))
    return found.withColumnRenamed("k", id_col)


def _scan_block(words: DataFrame, rows: list[dict], spark: SparkSession) -> DataFrame:
    lengths = sorted({r["q"] for r in rows})
    of = {q: [r for r in rows if r["q"] == q] for q in lengths}

    def by_length(value) -> Column:
        out = F.when(F.col("q") == lengths[0], value(lengths[0]))
        for q in lengths[1:]:
            out = out.when(F.col("q") == q, value(q))
        return out

    # A short template is one shingle, so a text without its longest word cannot hold it.
    fits = [F.when((F.size("words") >= q) & (F.lit(True) if q == SHINGLE else F.arrays_overlap("words", F.array(*(F.lit(w) for w in sorted({r["longest"] for r in of[q]}))))), F.lit(q)) for q in lengths]
    each = words.select("k", "row", "words", F.explode(F.filter(F.array(*fits), lambda q: q.isNotNull())).alias("q"))
    hashed = once(each, "k", "row", "q", shingles=by_length(lambda q: shingles_of("words", q)))
    telling = {q: _longs(sorted({s for r in of[q] for _, s in r["bands"]})) for q in lengths}
    held = hashed.where(by_length(lambda q: F.arrays_overlap("shingles", telling[q])))
    each_size = F.explode(by_length(lambda q: F.array(*(F.lit(s) for s in sorted({r["size"] for r in of[q]}))))).alias("size")
    starts = held.select("k", "row", "q", "shingles", each_size).select("k", "row", "q", "shingles", "size", F.explode(F.expr("sequence(0, greatest(size(shingles) - 1, 0), size)")).alias("at"))
    windows = starts.select("k", "row", "q", "size", "at", F.expr("array_distinct(slice(shingles, at + 1, 2 * size))").alias("window")).where(by_length(lambda q: F.arrays_overlap("window", telling[q])))
    numbered = windows.select("*", F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> {band('window', 'b')})")).alias("band", "h"))
    # Both tables hold at most block_templates rows per band.
    bands = spark.createDataFrame([(r["q"], r["size"], b, h, r["template_id"]) for r in rows for b, (h, _) in enumerate(r["bands"])], "q int, size int, band int, h long, template_id string")
    texts = spark.createDataFrame([(r["template_id"], r["shingles"]) for r in rows], "template_id string, wanted array<long>")
    # A row's window that several bands retrieve is one window, and is verified once.
    retrieved = numbered.join(F.broadcast(bands), ["q", "size", "band", "h"]).groupBy("row", "template_id", "at").agg(F.first("k").alias("k"), F.first("window").alias("window"))
    shared = F.size(F.array_intersect("window", "wanted"))
    verified = retrieved.join(F.broadcast(texts), "template_id").select("k", "template_id", "at", (shared / F.size("wanted")).alias("containment")).where(F.col("containment") >= CONTAINMENT)
    best = F.max(F.struct("containment", (-F.col("at")).alias("before"))).alias("best")
    return verified.groupBy("k", "template_id").agg(best).select("k", "template_id", F.col("best.containment").alias("containment"), (-F.col("best.before")).cast("long").alias("first_word"))


def oracle_sql() -> str:
    """The same result in DuckDB's SQL: every window against every template, without bands."""
    values = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in sorted(TEMPLATES.items()))
    cut = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"""
WITH t AS (SELECT template_id, {cut.format('txt')} AS w FROM (VALUES {values}) v(template_id, txt)),
tq AS (SELECT template_id, w, least(len(w), {SHINGLE}) AS q FROM t),
ts AS (SELECT DISTINCT template_id, q, array_to_string(list_slice(w, i, i + q - 1), ' ') AS s FROM tq, unnest(generate_series(1, len(w) - q + 1)) g(i)),
tn AS (SELECT template_id, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS c FROM ts GROUP BY 1),
d AS (SELECT doc_id, {cut.format('text')} AS w FROM documents),
ds AS (SELECT doc_id, q, i - 1 AS p, array_to_string(list_slice(w, i, i + q - 1), ' ') AS s FROM (SELECT d.*, q FROM d, (SELECT DISTINCT q FROM tq) l WHERE len(w) >= q) x, unnest(generate_series(1, len(w) - q + 1)) g(i)),
hits AS (SELECT doc_id, template_id, s, p, n, c FROM ds JOIN ts USING (q, s) JOIN tn USING (template_id)),
inside AS (SELECT doc_id, template_id, n, s, (p // c - b) * c AS win FROM hits, (VALUES (0), (1)) v(b) WHERE p // c - b >= 0),
per AS (SELECT doc_id, template_id, win, count(DISTINCT s) / max(n) AS containment FROM inside GROUP BY ALL HAVING count(DISTINCT s) / max(n) >= {CONTAINMENT})
SELECT doc_id, template_id, max(containment) AS containment, CAST(arg_max(win, containment - win * 1e-12) AS BIGINT) AS first_word FROM per GROUP BY ALL"""

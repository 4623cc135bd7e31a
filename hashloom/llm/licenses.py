"""License scans: MinHash bands over overlapping windows of words, then exact containment.

Templates are short notices and the opening paragraphs of common licenses.  For each size
class of templates, a text has a window of that many words at every word.  A window
and a template whose MinHash agrees in one of ``BANDS`` bands (of one row each) are a
candidate; the template's shingles of five words that the window holds are then counted
exactly, and at least ``THRESHOLD`` of them must be there.  A window that passes is at
least ``floor_similarity`` alike to the template, so a match is missed with probability at
most (1 - s) ** BANDS; :func:`miss_bound` computes it for the worst template.

Only windows that hold an anchor word get hashed.  The anchors of a template are words
found in more than 1 - THRESHOLD of its shingles, so no window without them can pass, and
this loses nothing.

All of it is DataFrame operations; the templates are literals of fixed size.

Defined cases: null texts, and texts of fewer words than a shingle, match nothing and
have no row; an empty table gives none; very long texts are scanned whole; rows that repeat
in id and text count once, and rows of one id (null ids too) are one document; extra columns are ignored.  Of licenses whose
windows overlap, one that is held to a greater share stands; equals stand together.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, THRESHOLD, BANDS = 5, 0.8, 24

# License notices as they are published.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: Words that may be anchors.
ANCHORS = ["license", "licensed", "permission", "redistribution", "redistribute", "permitted", "software", "copyright", "warranty", "notice"]


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def sizes() -> list[int]:
    """Window lengths: the lengths of templates, those within a fifth of a longer one dropped."""
    out: list[int] = []
    for n in sorted({len(words_of(t)) for _, t in TEMPLATES}, reverse=True):
        if not out or n < 0.8 * out[-1]:
            out.append(n)
    return sorted(out)


def class_of(n: int) -> int:
    return min(s for s in sizes() if s >= n)


def stride(window: int) -> int:
    """Every position: a window is no longer than its longest template, so one that is off
    by a word has lost a shingle of it."""
    return 1


def shingles(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)]


def anchors() -> list[str]:
    """A few words such that each template has them in more than 1 - THRESHOLD of its shingles."""
    chosen: list[str] = []
    for _, t in TEMPLATES:
        sh = shingles(words_of(t))
        hit = lambda ws: sum(any(w in s.split() for w in ws) for s in sh)
        for w in sorted(ANCHORS, key=lambda w: (-hit([w]), w)):
            if hit(chosen) > (1 - THRESHOLD) * len(sh) + 1e-9:
                break
            chosen.append(w)
        if hit(chosen) <= (1 - THRESHOLD) * len(sh) + 1e-9:
            raise ValueError(f"no anchors for {t!r}")
    return sorted(set(chosen))


def miss_bound() -> float:
    """The greatest probability with which a window that holds a template's least share
    of shingles isn't retrieved."""
    worst = 0.0
    for _, t in TEMPLATES:
        n = len(words_of(t))
        have, window = n - WORDS + 1, class_of(n) - WORDS + 1
        least = -(-have * 4 // 5)
        worst = max(worst, (1 - least / (window + have - least)) ** BANDS)
    return worst


def _minhash(hashes: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda k: F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, k))))


def _templates(spark) -> DataFrame:
    rows = [(i, name, class_of(len(words_of(t))), shingles(words_of(t))) for i, (name, t) in enumerate(TEMPLATES)]
    df = spark.createDataFrame(rows, "template int, license string, window int, sh array<string>").coalesce(1)
    return df.withColumn("hashes", F.array_distinct(F.transform("sh", lambda s: F.xxhash64(s)))).drop("sh")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, containment, n_windows, first_word): the licenses found in each text,
    with the best containment and the first word of the earliest window."""
    spark = docs.sparkSession
    found = anchors()
    clean = F.trim(F.regexp_replace(F.lower(F.col(text_col)), "[^a-z0-9]+", " "))
    may = docs.filter(F.lower(F.col(text_col)).rlike("|".join(found)))
    cut = may.select(F.col(id_col).alias("id"), F.split(clean, " ").alias("words")).filter(F.size("words") >= WORDS)
    sh = F.transform(F.sequence(F.lit(0), F.size("words") - WORDS), lambda i: F.xxhash64(F.array_join(F.slice("words", i + 1, WORDS), " ")))
    cut = cut.withColumns({"sh": sh, "n": F.size("words")})
    wanted = F.array(*map(F.lit, found))

    def windows(size: int) -> Column:
        last = F.greatest(F.col("n") - size, F.lit(0))
        starts = F.array_union(F.sequence(F.lit(0), last, F.lit(stride(size))), F.array(last))
        near = F.filter(starts, lambda p: F.arrays_overlap(F.slice("words", p + 1, size), wanted))
        return F.transform(near, lambda p: F.struct(F.lit(size).alias("window"), p.alias("at")))

    all_windows = F.concat(*[windows(s) for s in sizes()])
    each = cut.select("id", "sh", F.explode(all_windows).alias("w")).select("id", "w.window", "w.at", F.slice("sh", F.col("w.at") + 1, F.col("w.window") - WORDS + 1).alias("held"))
    bands = each.select("id", "window", "at", "held", F.posexplode(_minhash(F.col("held"))).alias("band", "value"))
    t = _templates(spark)
    # A few hundred rows, whatever the input: the number of templates times bands.
    keys = t.select("template", "license", "window", "hashes", F.posexplode(_minhash(F.col("hashes"))).alias("band", "value"))
    candidates = bands.join(F.broadcast(keys), ["window", "band", "value"]).dropDuplicates(["id", "window", "at", "template"])
    exact = candidates.withColumn("containment", F.size(F.array_intersect("held", "hashes")) / F.size("hashes")).filter(F.col("containment") >= THRESHOLD)
    # Licenses share phrases: where windows overlap, one that is held better stands.
    hit = F.struct("license", "window", "at", "containment")
    per_doc = exact.groupBy("id", "license", "window", "at").agg(F.max("containment").alias("containment")).groupBy("id").agg(F.collect_list(hit).alias("hits"))
    beaten = lambda h: F.exists("hits", lambda o: (o["license"] != h["license"]) & (o["containment"] > h["containment"]) & (o["at"] < h["at"] + h["window"]) & (h["at"] < o["at"] + o["window"]))
    stands = per_doc.select("id", F.explode(F.filter("hits", lambda h: ~beaten(h))).alias("h")).select("id", "h.*")
    best = stands.groupBy("id", "license").agg(F.max("containment").alias("containment"), F.count(F.lit(1)).alias("n_windows"), F.min("at").cast("long").alias("first_word"))
    return best.withColumnRenamed("id", id_col)


def oracle() -> str:
    """The same windows and containments in SQL, by joining shingles, without bands or anchors."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    held = [(i, name, class_of(len(words_of(t))), sh, len(set(shingles(words_of(t))))) for i, (name, t) in enumerate(TEMPLATES) for sh in sorted(set(shingles(words_of(t))))]
    rows = ", ".join(f"({i}, {quoted(n)}, {c}, {quoted(sh)}, {k})" for i, n, c, sh, k in held)
    classes = ", ".join(f"({s}, {stride(s)})" for s in sizes())
    return f"""
WITH t(template, license, size, sh, n_sh) AS (VALUES {rows}),
classes(size, stride) AS (VALUES {classes}),
w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM documents),
s AS (SELECT doc_id, words, len(words) AS n, unnest(range(1, len(words) - {WORDS - 2})) AS i FROM w WHERE len(words) >= {WORDS}),
h AS (SELECT DISTINCT x.doc_id, x.n, x.i - 1 AS i, t.template, t.license, t.size, t.sh, t.n_sh
      FROM (SELECT doc_id, n, i, array_to_string(list_slice(words, i, i + {WORDS - 1}), ' ') AS sh FROM s) x JOIN t ON x.sh = t.sh),
d AS (SELECT DISTINCT doc_id, n, h.size, stride FROM h JOIN classes c ON h.size = c.size),
p AS (SELECT doc_id, size, unnest(list_distinct(list_concat(range(0, greatest(n - size, 0) + 1, stride), [greatest(n - size, 0)]))) AS pos FROM d),
c AS (SELECT h.doc_id, h.size, p.pos, h.template, h.license, count(DISTINCT h.sh) / any_value(h.n_sh) AS containment
      FROM h JOIN p ON h.doc_id = p.doc_id AND h.size = p.size AND h.i >= p.pos AND h.i <= p.pos + h.size - {WORDS}
      GROUP BY ALL),
m AS (SELECT doc_id, license, size, pos, max(containment) AS containment FROM c WHERE containment >= {THRESHOLD} GROUP BY ALL)
SELECT doc_id, license, max(containment) AS containment, count(*) AS n_windows, CAST(min(pos) AS BIGINT) AS first_word
FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = m.doc_id AND o.license <> m.license AND o.containment > m.containment AND o.pos < m.pos + m.size AND m.pos < o.pos + o.size)
GROUP BY doc_id, license
"""

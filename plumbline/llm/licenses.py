"""License scans: TF-IDF cosine of notices to templates, then inheritance along paths.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import whole_text
from plumbline.plans.groups import beside
from plumbline.session import stage

# Notices and permission texts by which licences announce themselves.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
TERM = "[\\p{L}\\p{N}]+(?:[.-][\\p{L}\\p{N}]+)*"
PARAGRAPHS = "\\n[ \\t\\r]*\\n"
LEAST_COSINE = 0.7
COPIES = 32
FILE_SHARE = 0.3  # from this share of a file's terms on, its notice makes it a licence file
LICENSE_NAME = "(?i)(^|/)(licen[cs]e|copying|notice)([.][^/]*)?$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _template_terms(spark, templates: list[tuple[str, str]]) -> DataFrame:
    quote = lambda x: x.replace("'", "\\'")
    listed = ", ".join(f"({i}, '{quote(a)}', '{quote(b)}')" for i, (a, b) in enumerate(templates))
    rows = spark.sql(f"SELECT * FROM VALUES {listed} AS t(template, license, notice)")
    rows = rows.select("template", "license", F.explode(terms(F.col("notice"))).alias("term"))
    return rows.groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))


def units(text: Column) -> Column:
    """What is compared with templates: lines, neighbouring lines joined, paragraphs, the whole text."""
    lines = F.split(text, "\n")
    pairs = F.when(
        F.size(lines) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(lines) - 1),
            lambda i: F.concat_ws("\n", F.element_at(lines, i), F.element_at(lines, i + 1)),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(lines, pairs, F.split(text, PARAGRAPHS), F.array(text))


def could_reach(found: Column, idf: dict[str, float], shares: list[dict[str, float]], least: float) -> Column:
    """Whether the terms of a unit could have the cosine ``least`` with one of the templates.

    ``shares`` are the templates' vectors of norm 1. The weights of their terms are known,
    and with them every product with a template; all other terms weigh at least 1, so m of
    them add at least m to the squared norm.
    """
    square = F.create_map(*[x for t, w in idf.items() for x in (F.lit(t), F.lit(w * w))])
    parts = F.create_map(
        *[x for t, w in idf.items() for x in (F.lit(t), F.array(*[F.lit(w * v.get(t, 0.0)) for v in shares]))]
    )

    def able(known: Column) -> Column:
        times = lambda x: F.size(F.filter(known, lambda y: y == x))
        distinct = F.array_distinct(known)
        held = F.aggregate(distinct, F.lit(0.0), lambda total, x: total + times(x) * times(x) * F.element_at(square, x))
        dots = F.aggregate(
            distinct,
            F.array(*[F.lit(0.0)] * len(shares)),
            lambda total, x: F.zip_with(total, F.transform(F.element_at(parts, x), lambda p: p * times(x)), lambda a, b: a + b),
        )
        return F.array_max(dots) >= least * F.sqrt(held + F.size(found) - F.size(known))

    # The array of one makes the terms of templates once, not for each of them.
    return F.transform(F.array(F.filter(found, lambda x: x.isin(list(idf)))), able)[0]


def anchors(weights: dict, least: float, idf: dict[str, float] | None = None) -> list[str]:
    """Terms of which a text needs one to reach the cosine ``least`` with any template.

    The cosine is at most the norm of the shared terms over the norm of the template, so
    without some terms, up to which the rest stays below ``least``, it cannot reach that.
    Terms are taken from the rarest on, by ``idf``, or else from the heaviest on.
    """
    needed = set()
    for vector in weights.values():
        norm = sum(w * w for w in vector.values())
        rest = norm
        for term, w in sorted(vector.items(), key=lambda x: (-(idf[x[0]] if idf else x[1]), x[0])):
            if rest < (least * least - 1e-9) * norm:
                break
            needed.add(term)
            rest -= w * w
    return sorted(needed)


def notices(files: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST_COSINE) -> DataFrame:
    """The best notice of every file that has one: ``path, own_license, own_score, n_terms, n_notice``.

    Every line of every whole text, every two neighbouring lines, every paragraph and the
    whole text is compared with the templates. Terms are weighted by tf * idf, where
    idf = 1 + ln((n + 1) / (df + 1)) over all files. What has equal terms is scored once.
    """
    spark = files.sparkSession
    templates = templates or TEMPLATES
    listed = _template_terms(spark, templates).collect()  # bounded by the templates
    known = sorted({r["term"] for r in listed})
    text = whole_text()
    n = files.count()
    each = files.select(F.explode(F.array_distinct(terms(text))).alias("term"))
    seen = stage(each.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    df = {r["term"]: r["df"] for r in seen.filter(F.col("term").isin(known)).collect()}
    idf = {t: 1 + math.log((n + 1) / (df.get(t, 0) + 1)) for t in known}
    weights: dict[int, dict[str, float]] = {}
    for r in listed:
        weights.setdefault(r["template"], {})[r["term"]] = r["tf"] * idf[r["term"]]
    least_before_rounding = least - 1e-6
    needed = F.array(*[F.lit(t) for t in anchors(weights, least_before_rounding, idf)])
    norm_of = {i: math.sqrt(sum(w * w for w in v.values())) for i, v in weights.items()}
    shares = {i: {t: w / norm_of[i] for t, w in sorted(v.items())} for i, v in sorted(weights.items())}

    lines = (
        files.select("path", text.alias("text"))
        .filter(F.arrays_overlap(terms(F.col("text")), needed))
        .select("path", F.size(terms(F.col("text"))).alias("n_terms"), F.explode(units(F.col("text"))).alias("unit"))
        .withColumn("terms", terms(F.col("unit")))
        .filter(F.arrays_overlap("terms", needed))
        .filter(could_reach(F.col("terms"), idf, list(shares.values()), least_before_rounding))
        .withColumn("line_key", F.sha2(F.array_join("terms", " "), 256))
    )
    lines = stage(lines.select("path", "n_terms", "terms", "line_key"))
    single = lines.groupBy("line_key").agg(F.first("terms").alias("terms"))
    tf = stage(
        single.select("line_key", F.explode("terms").alias("term"))
        .groupBy("line_key", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    used = tf.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(seen, "term", "left")
    weighed = 1 + F.log(F.lit(n + 1) / (F.coalesce("df", F.lit(0)) + 1))
    tf = beside(tf, ["term"], stage(used.select("term", "n", weighed.alias("idf"))))
    tf = stage(tf.select("line_key", "term", "tf", (F.col("tf") * F.col("idf")).alias("w")))
    norms = tf.groupBy("line_key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("n_notice"))
    vectors = [f"({i}, '{templates[i][0]}', '{t}', {w!r}D)" for i, v in shares.items() for t, w in v.items()]
    # Bounded by the templates.
    unit = spark.sql(f"SELECT * FROM VALUES {', '.join(vectors)} AS t(template, license, term, share)")
    best = (
        tf.join(F.broadcast(unit), "term")
        .groupBy("line_key", "template", "license")
        .agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
        .join(norms, "line_key")
        .withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
        .filter(F.col("score") >= least)
        .groupBy("line_key")
        .agg(F.min(F.struct((-F.col("score")).alias("low"), "license", "n_notice")).alias("best"))
        .select("line_key", "best.license", (-F.col("best.low")).alias("score"), "best.n_notice")
    )
    # A notice that many files share is a hot key: its rows are dealt over COPIES copies of its score.
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    lines = lines.withColumn("copy", F.pmod(F.xxhash64("path"), F.lit(COPIES)).cast("int"))
    return (
        lines.join(best, ["line_key", "copy"])
        .groupBy("path")
        .agg(
            F.min(F.struct((-F.col("score")).alias("low"), "license", "n_notice")).alias("best"),
            F.max("n_terms").alias("n_terms"),
        )
        .select(
            "path", F.col("best.license").alias("own_license"), (-F.col("best.low")).alias("own_score"),
            "n_terms", F.col("best.n_notice").alias("n_notice"),
        )
    )


def folder(path: str) -> Column:
    """The folder of a path; the root is empty."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan(files: DataFrame, least: float = LEAST_COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """One row per row of ``files`` (``doc_id, path, text``): ``doc_id, path, own_license,
    own_score, license, via, license_path``.

    A file with a notice has its best licence (``via`` = header); ties go to the first
    name. A file is a licence file when it is named like one or its notice makes up
    ``file_share`` of its terms. A file without a notice inherits the licence of the
    nearest folder above it that holds a licence file (``inherited``; of several, the
    best score, then the first path); else it has none (``none``). Rows with one path are
    one file: the best notice of their texts counts. A null text is empty, a null path is
    the file "" in the root. Other columns are not read.
    """
    files = files.select("doc_id", F.coalesce("path", F.lit("")).alias("path"), "text")
    own = stage(notices(files, least=least))
    named = F.col("path").rlike(LICENSE_NAME) | (F.col("n_notice") >= file_share * F.col("n_terms"))
    holders = (
        own.filter(named)
        .groupBy(folder("path").alias("above"))
        .agg(F.min(F.struct((-F.col("own_score")).alias("low"), "path", "own_license")).alias("h"))
        .select("above", F.col("h.path").alias("license_path"), F.col("h.own_license").alias("license"))
    )
    listed = files.select("doc_id", "path").withColumn("folder", folder("path"))
    parts = F.split("folder", "/")
    ups = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(
        F.concat(
            F.array(F.lit("")),
            F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")),
        )
    )
    nearest = (
        listed.select("folder")
        .distinct()
        .select("folder", F.posexplode(ups).alias("depth", "above"))
        .join(holders, "above")
        .groupBy("folder")
        .agg(F.max(F.struct("depth", "license", "license_path")).alias("near"))
        .select("folder", F.col("near.license").alias("from_license"), F.col("near.license_path").alias("from_path"))
    )
    found = listed.join(own.select("path", "own_license", "own_score"), "path", "left").join(nearest, "folder", "left")
    has_own = F.col("own_license").isNotNull()
    return found.select(
        "doc_id",
        "path",
        "own_license",
        "own_score",
        F.coalesce("own_license", "from_license").alias("license"),
        F.when(has_own, "header").when(F.col("from_license").isNotNull(), "inherited").otherwise("none").alias("via"),
        F.when(~has_own, F.col("from_path")).alias("license_path"),
    )


def laid_out(docs: DataFrame) -> DataFrame:
    """Documents as files: the table has no paths, so a source is a folder, with folders for
    a thousand and for fifty neighbouring ids in it."""
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    level = lambda n: F.coalesce(F.expr(f"CAST(doc_id DIV {n} AS STRING)"), F.lit("none"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), level(1000), level(50), F.concat(number, F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")


def scan_sql() -> str:
    quote = lambda x: x.replace("'", "''")
    listed = ", ".join(f"({i}, '{quote(a)}', '{quote(b)}')" for i, (a, b) in enumerate(TEMPLATES))
    term = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+(?:[.-][\\p{{L}}\\p{{N}}]+)*')".format
    return f"""
WITH t(template, license, notice) AS (VALUES {listed}),
f AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', coalesce(source, 'unknown'),
        coalesce((doc_id // 1000)::VARCHAR, 'none'), coalesce((doc_id // 50)::VARCHAR, 'none'),
        coalesce(doc_id::VARCHAR, 'none') || '.txt') AS path FROM documents),
v AS (SELECT template, license, term, count(*) AS tf
      FROM (SELECT template, license, unnest({term("notice")}) AS term FROM t) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM f),
c AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({term("text")})) AS term FROM f) GROUP BY term),
ls AS (SELECT path, text, len({term("text")}) AS n_terms, string_split(text, chr(10)) AS ls FROM f),
l AS (SELECT path, n_terms, unnest(list_concat(ls, [ls[i] || chr(10) || ls[i + 1] for i in range(1, len(ls))],
        string_split_regex(text, '{PARAGRAPHS}'), [text])) AS line FROM ls),
e AS (SELECT line, term, count(*) AS tf FROM (SELECT line, unnest({term("line")}) AS term FROM (SELECT DISTINCT line FROM l))
      GROUP BY ALL),
w AS (SELECT line, term, tf, tf * (1 + ln((n + 1) / (coalesce(df, 0) + 1))) AS w FROM e LEFT JOIN c USING (term), n),
m AS (SELECT line, sqrt(sum(w * w)) AS norm, sum(tf)::BIGINT AS n_notice FROM w GROUP BY line),
y AS (SELECT template, license, term, tf * (1 + ln((n + 1) / (coalesce(df, 0) + 1))) AS w FROM v LEFT JOIN c USING (term), n),
yn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM y GROUP BY template),
s AS (SELECT w.line, y.template, y.license, round(sum(w.w * y.w) / any_value(m.norm * yn.norm), 6) AS score,
        any_value(m.n_notice) AS n_notice
      FROM w JOIN y USING (term) JOIN m ON m.line = w.line JOIN yn ON yn.template = y.template GROUP BY ALL),
b AS (SELECT * FROM s WHERE score >= {LEAST_COSINE}
      QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, license) = 1),
o AS (SELECT l.path, b.license, b.score, b.n_notice, max(l.n_terms) OVER (PARTITION BY l.path) AS n_terms
      FROM l JOIN b USING (line) QUALIFY row_number() OVER (PARTITION BY l.path ORDER BY score DESC, license, n_notice) = 1),
h AS (SELECT regexp_replace(path, '/[^/]*$', '') AS above, path, license, score FROM o
      WHERE n_notice >= {FILE_SHARE} * n_terms
      QUALIFY row_number() OVER (PARTITION BY above ORDER BY score DESC, path) = 1),
g AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM f),
u AS (SELECT folder, array_to_string(string_split(folder, '/')[1:i], '/') AS above, i
      FROM g, range(0, 20) r(i) WHERE i <= len(string_split(folder, '/'))),
near AS (SELECT u.folder, h.license, h.path FROM u JOIN h USING (above)
         QUALIFY row_number() OVER (PARTITION BY folder ORDER BY i DESC) = 1)
SELECT f.doc_id, f.path, o.license AS own_license, o.score AS own_score, coalesce(o.license, near.license) AS license,
       CASE WHEN o.license IS NOT NULL THEN 'header' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS via,
       CASE WHEN o.license IS NULL THEN near.path END AS license_path
FROM f LEFT JOIN o ON o.path = f.path LEFT JOIN near ON near.folder = regexp_replace(f.path, '/[^/]*$', '')"""

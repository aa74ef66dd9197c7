"""Licence scan: TF-IDF cosine of notice lines to templates, and inheritance from the nearest directory with a licence file."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, inline
from .decontam import tokens

# SPDX identifiers and the usual wording of their notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
)
#: Cosine from which a line counts as a notice.
THRESHOLD = 0.75
#: Names of files whose licence holds for their directory and all below it.
LICENCE_FILE = r"(?i)^(?:licen[cs]e|copying|copyright|unlicense|notice)(?:[-_.].*)?$"

_TERMS = [Counter(re.findall(r"[^\W_]+", text.lower())) for _, text in TEMPLATES]
VOCABULARY = sorted(set().union(*_TERMS))


def idf(texts: DataFrame) -> dict[str, float]:
    """ln((n+1)/(df+1))+1 of every template term, over all rows of ``texts`` (column ``words``); under 200 numbers."""
    vocabulary = F.array(*[F.lit(t) for t in VOCABULARY])
    there = texts.select(F.explode(F.concat(F.array_intersect("words", vocabulary), F.array(F.lit("")))).alias("term"))
    seen = {r[0]: r[1] for r in there.groupBy("term").count().collect()}
    n = seen.get("", 0)
    return {t: math.log((n + 1) / (seen.get(t, 0) + 1)) + 1 for t in VOCABULARY}


def template_weights(weight: dict[str, float]) -> list[dict[str, float]]:
    """Each template's terms at unit length."""
    out = []
    for terms in _TERMS:
        v = {t: n * weight[t] for t, n in terms.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()})
    return out


def anchors(templates: list[dict[str, float]], threshold: float = THRESHOLD) -> list[str]:
    """Terms of which any line that reaches the threshold holds one.

    A line that shares only terms of total weight w with a template of unit length has a cosine of at most w, so a
    template's heaviest terms, until the others weigh less than the threshold, are enough.
    """
    out: set[str] = set()
    for v in templates:
        order = sorted(v, key=lambda t: (-v[t], t))
        k = next(k for k in range(len(order) + 1) if math.sqrt(sum(v[t] ** 2 for t in order[k:])) < threshold)
        out |= set(order[:k])
    return sorted(out)


def notices(files: DataFrame, key_cols: list[str], text: Column, threshold: float = THRESHOLD) -> DataFrame:
    """``key_cols, license, similarity, n_notices``: the notice line most like a template, of every row that has one.

    The vector space is that of the template terms, weighed by their document frequency over all rows.  Only texts with an
    anchor term are cut into lines, equal lines are scored once, and a line meets a template only through a shared term.
    """
    spark = files.sparkSession
    rows = files.select(*key_cols, text.alias("text"), tokens(text).alias("words"))
    weight = idf(rows)
    vectors = template_weights(weight)
    anchor = F.array(*[F.lit(t) for t in anchors(vectors, threshold)])
    entries = [(k, name, t, float(w), weight[t]) for k, ((name, _), v) in enumerate(zip(TEMPLATES, vectors, strict=True)) for t, w in v.items()]
    table = inline(spark, "template, name, term, w, idf", entries)  # some 300 rows, whatever the input
    terms = inline(spark, "term, idf", [(t, weight[t]) for t in VOCABULARY])
    lines = rows.where(F.arrays_overlap("words", anchor)).select(*key_cols, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select(*key_cols, "pos", tokens(F.col("line")).alias("words")).where(F.arrays_overlap("words", anchor)).select(*key_cols, "pos", F.array_join("words", " ").alias("line"))
    lines = cut(lines.distinct())  # a row that is stored twice has each of its lines once
    tf = lines.select("line").distinct().select("line", F.explode(F.split("line", " ")).alias("term")).groupBy("line", "term").agg(F.count("*").alias("tf"))
    norm = tf.join(F.broadcast(terms), "term").groupBy("line").agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("norm"))
    dot = tf.join(F.broadcast(table), "term").groupBy("line", "template", "name").agg(F.sum(F.col("tf") * F.col("idf") * F.col("w")).alias("dot"))
    scored = dot.join(norm, "line").select("line", "name", F.round(F.col("dot") / F.col("norm"), 6).alias("similarity")).where(F.col("similarity") >= threshold)
    best = scored.groupBy("line").agg(F.max(F.struct("similarity", F.col("name"))).alias("b")).select("line", F.col("b.name").alias("license"), F.col("b.similarity").alias("similarity"))
    found = lines.join(best, "line").groupBy(*key_cols).agg(F.max(F.struct("similarity", "license")).alias("b"), F.count("*").alias("n_notices"))
    return found.select(*key_cols, F.col("b.license").alias("license"), F.col("b.similarity").alias("similarity"), "n_notices")


def directory(path: Column) -> Column:
    """What stands before the last slash; the empty string for a name alone."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherited(dirs: DataFrame, licensed: DataFrame) -> DataFrame:
    """``dir, license`` of each of the distinct ``dirs`` whose nearest ancestor (itself first) in ``licensed`` has one."""
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).select("dir", "depth", F.array_join(F.slice(F.split("dir", "/"), 1, F.col("depth")), "/").alias("above"))
    met = up.join(licensed.select(F.col("dir").alias("above"), "license"), "above")
    return met.groupBy("dir").agg(F.max(F.struct("depth", "license")).alias("b")).select("dir", F.col("b.license").alias("license"))


def scan(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, path, license, similarity, n_notices, origin`` of every row.

    ``origin`` is ``notice`` where a line of the text is like a template (of the lines, the most alike; ties by the later
    name), ``inherited`` where the text has none but the nearest directory above holds a licence file with one, else
    ``none`` with null license.  A null path lies in no directory and inherits nothing.

    A null or empty text has no line.  Rows of one id, path and text are one row of the notice table but come back as often as they
    come.  An empty table gives an empty result; other columns are ignored.
    """
    path = F.lit(None).cast("string") if path is None else path
    rows = files.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    own = cut(notices(rows, ["doc_id", "path", "row"], F.col("text"), threshold))
    at = own.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE))
    licensed = at.groupBy(directory(F.col("path")).alias("dir")).agg(F.max(F.struct("similarity", "license")).alias("b")).select("dir", F.col("b.license").alias("license"))
    light = rows.select("doc_id", "path", "row")
    mine = own.select(F.col("doc_id").alias("i"), F.col("path").alias("p"), F.col("row").alias("h"), "license", "similarity", "n_notices").distinct()
    out = light.join(mine, F.col("doc_id").eqNullSafe(F.col("i")) & F.col("path").eqNullSafe(F.col("p")) & (F.col("row") == F.col("h")), "left").withColumn("dir", directory(F.col("path")))
    dirs = out.where("license is null and dir is not null").select("dir").distinct()
    passed = cut(inherited(dirs, licensed).select(F.col("dir").alias("d"), F.col("license").alias("above")))  # an exchange of its own, so that a crowded directory can be split
    out = out.join(passed, F.col("dir") == F.col("d"), "left")
    origin = F.when(F.col("license").isNotNull(), "notice").when(F.col("above").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("license", "above").alias("license"), "similarity", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), origin.alias("origin"))


def _values() -> str:
    return ", ".join(f"({k}, '{name}', '{t}', {n})" for k, ((name, _), terms) in enumerate(zip(TEMPLATES, _TERMS, strict=True)) for t, n in sorted(terms.items()))


def query_path() -> Column:
    """Paths for ``documents``, which has none: folders by source and id; every seventh file is a licence file of one of three levels."""
    top, mid, low = F.col("source"), (F.col("doc_id") % 4).cast("string"), (F.col("doc_id") % 16).cast("string")
    folder = F.when(F.col("doc_id") % 3 == 0, top).when(F.col("doc_id") % 3 == 1, F.concat_ws("/", top, mid)).otherwise(F.concat_ws("/", top, mid, low))
    plain = F.concat_ws("/", top, mid, low, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return F.when(F.col("doc_id") % 7 == 0, F.concat(folder, F.lit("/LICENSE."), F.col("doc_id").cast("string"))).otherwise(plain)


#: The same scores in DuckDB over every line of ``documents``, without anchors, and the nearest folder above of the three levels.
ORACLE_SQL = rf"""
with tpl(k, name, term, n) as (values {_values()}),
docs as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') w from documents),
df as (select term, count(*) df from (select unnest(list_distinct(w)) term from docs) where term in (select term from tpl) group by 1),
idf as (select distinct tpl.term, ln(((select count(*) from docs) + 1) / (coalesce(df.df, 0) + 1)) + 1 idf from tpl left join df using (term)),
tv as (select k, name, term, n * idf v from tpl join idf using (term)),
tn as (select k, sqrt(sum(v * v)) norm from tv group by 1),
ln as (select doc_id, row_number() over () i, line from (select doc_id, unnest(string_split(text, chr(10))) line from documents)),
tf as (select doc_id, i, term, count(*) tf from (select doc_id, i, unnest(regexp_split_to_array(lower(line), '[^\p{{L}}\p{{N}}]+')) term from ln) where term in (select term from tpl) group by all),
nv as (select i, sqrt(sum((tf * idf) ** 2)) norm from tf join idf using (term) group by 1),
dot as (select doc_id, i, k, name, sum(tf * idf * v) d from tf join idf using (term) join tv using (term) group by all),
sc as (select doc_id, i, name, round(d / nv.norm / tn.norm, 6) s from dot join nv using (i) join tn using (k)),
line as (select doc_id, i, max({{'s': s, 'name': name}}) b from sc where s >= {THRESHOLD} group by all),
best as (select doc_id, max(b) b, count(*) n from line group by 1),
files as (select doc_id, best.b, best.n, source || '' top, source || '/' || (doc_id % 4) mid, source || '/' || (doc_id % 4) || '/' || (doc_id % 16) low, doc_id % 7 = 0 lic, doc_id % 3 lev from documents left join best using (doc_id)),
own as (select case when lic and lev = 0 then top when lic and lev = 1 then mid else low end dir, * from files),
held as (select dir, max(b).name name from own where lic and b is not null group by 1),
up as (select own.*, coalesce(case when own.dir = own.low then l.name end, case when own.dir <> own.top then m.name end, t.name) above from own left join held l on l.dir = own.low left join held m on m.dir = own.mid left join held t on t.dir = own.top)
select doc_id, coalesce(b.name, above) as license, b.s as similarity, coalesce(n, 0) as n_notices, case when n is not null then 'notice' when above is not null then 'inherited' else 'none' end as origin from up
"""

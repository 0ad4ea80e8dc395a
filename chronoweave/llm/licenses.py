"""License scans, DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance
from the nearest ancestor directory by path joins.

A file's header is the set of its lines that hold a word starting with a cue (licen,
copyright, spdx and the like); whole texts are looked through.  Header words and
template words become sparse TF-IDF vectors, with document frequencies over all files;
the cosine to each template is the sum over shared words.  The best template from
``least`` on is the file's own license; ties go to the template first by name.

Whole license texts are compared as well, where a file holds a cue of them (``TEXT_CUE``,
which each of the texts has): the words of its leading comment, or of the whole file if it
does not begin with a comment, become TF-IDF vectors of word pairs, and so do the texts in
``licence_texts``; the files that hold a cue are the corpus of these vectors, and every pair
of theirs, a template's or not, has its own document frequency in it.  A match from ``least`` on comes before a match of notices.  CC-BY texts
are not among them.  A file without a license takes the license of the license file in its
nearest ancestor directory.

Defined cases: null or empty texts have no header; null paths lie in no directory and
inherit nothing; rows are told apart, so repeated rows and keys each get a row; several
license files of one directory give the best score, ties to the first license by name; an
empty table gives an empty result; other columns are ignored.

Scale: files are read once; what is kept of each is its header words and, with a cue of whole
texts, the hashes of its word pairs.  Frequencies are pre-aggregated; templates and their
weights (about 18,000 pairs) are fixed in size and broadcast.  A directory has one row for its
license, and a path joins its ancestors, one row for each level, so no group holds all files
of a directory.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import kept
from .textops import read

#: notices and licence texts' openings; variants of one licence carry a number
TEMPLATES = {
    "Apache-2.0#1": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0#2": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "BSD-3-Clause#1": "Licensed under the BSD 3-Clause License.",
    "BSD-3-Clause#2": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0#1": "Licensed under CC BY 4.0.",
    "CC-BY-4.0#2": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0#1": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0#2": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "GPL-3.0#1": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0#2": "This program is free software: you can redistribute it under the terms of the GNU General Public License.",
    "LGPL-3.0#1": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT#1": "Released under the MIT License.",
    "MIT#2": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. MIT License.",
    "MPL-2.0#1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
CUE = "licen|copyright|spdx|redistribut|copyleft"
#: whole license texts hold one of these
TEXT_CUE = "hereby granted|warrant|redistribut|combined work"
LEAST = 0.5
WORDS = "[^a-z0-9.]+"


def clean_words(text):
    return F.filter(F.transform(F.split(text, WORDS), lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")


def header_words(low):
    """Words of the lines with a cue, end points stripped; low: a lower-cased text."""
    ls = F.filter(F.split(low, "\n", -1), lambda x: x.rlike(CUE))
    return F.when(low.rlike(CUE), clean_words(F.array_join(ls, " "))).otherwise(F.array().cast("array<string>"))


def word_pairs(low):
    """Hashes of neighbouring words of the leading comment, or of the whole text if there is none, where a text holds a cue; low: a lower-cased text."""
    ls = F.split(low, "\n", -1)
    code = F.array_position(F.transform(ls, lambda x: ~x.rlike(r"^\s*(#|//|/?[*]|--|;|%|$)")), True)
    lead = F.when(code > 0, F.slice(ls, 1, (code - 1).cast("int"))).otherwise(ls)
    block = F.regexp_extract(low, r"(?s)^\s*/[*](.*?)[*]/", 1)
    body = F.when(F.trim(block) != "", block).when(F.exists(lead, lambda x: x.rlike("[a-z]")), F.array_join(lead, " ")).otherwise(low)
    ws = F.when(low.rlike(TEXT_CUE), clean_words(body)).otherwise(F.array().cast("array<string>"))
    n = F.greatest(F.size(ws) - 1, F.lit(0))
    return F.zip_with(F.slice(ws, 1, n), F.slice(ws, 2, n), lambda a, b: F.xxhash64(a, b))


def text_templates(spark: SparkSession) -> dict[str, dict[int, int]]:
    """Counts of word pairs of each license text."""
    texts = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    t = spark.createDataFrame(texts, "license string, text string").select("license", F.explode(word_pairs(F.lower("text"))).alias("w")).groupBy("license", "w").count()
    out: dict[str, dict[int, int]] = {}
    for license, w, n in t.collect():  # fixed size
        out.setdefault(license, {})[w] = n
    return out


def prepared(files: DataFrame) -> DataFrame:
    """id, key, path, head (words) and pairs (hashes) of every file, kept."""
    d = files.select("key", "path", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    return kept(d.select(F.monotonically_increasing_id().alias("id"), "key", "path", header_words(F.col("low")).alias("head"), word_pairs(F.col("low")).alias("pairs")))


def best_of(cos: DataFrame, least: float) -> DataFrame:
    best = cos.where(F.col("score") >= least).groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("id", F.substring_index("b.license", "#", 1).alias("license"), (-F.col("b.s")).alias("score"))


def cosines(terms: DataFrame, t: DataFrame, n: int, least: float) -> DataFrame:
    """id, license, score of the best template by TF-IDF cosine; terms: id, w of n files, t: license, w, tf of the templates."""
    tf = terms.groupBy("id", "w").agg(F.count("*").alias("tf"))
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(float(n)) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0
    tw = t.join(df, "w", "left").select("license", "w", (F.col("tf") * idf).alias("tx"))
    tn = tw.groupBy("license").agg(F.sqrt(F.sum(F.col("tx") * F.col("tx"))).alias("tn"))
    fw = tf.join(df, "w").select("id", "w", (F.col("tf") * idf).alias("fx"))
    fn = fw.groupBy("id").agg(F.sqrt(F.sum(F.col("fx") * F.col("fx"))).alias("fn"))
    dots = fw.join(F.broadcast(tw), "w").groupBy("id", "license").agg(F.sum(F.col("fx") * F.col("tx")).alias("dot"))  # the words of the templates
    return best_of(dots.join(F.broadcast(tn), "license").join(fn, "id").select("id", "license", F.round(F.col("dot") / (F.col("fn") * F.col("tn")), 6).alias("score")), least)


def whole_texts(base: DataFrame, texts: dict[str, dict[int, int]], n: int, least: float = LEAST) -> DataFrame:
    """id, license, score of the files, of n with a cue, that hold a whole license text."""
    t = base.sparkSession.createDataFrame([(license, w, c) for license, own in texts.items() for w, c in own.items()], "license string, w long, tf long")  # fixed size
    return cosines(base.select("id", F.explode("pairs").alias("w")), t, n, least)


def by_notices(base: DataFrame, n: int, least: float = LEAST) -> DataFrame:
    """id, license, score of the files with a notice."""
    t = base.sparkSession.createDataFrame(sorted(TEMPLATES.items()), "license string, text string")  # fixed size
    t = t.select("license", F.explode(clean_words(F.lower("text"))).alias("w")).groupBy("license", "w").agg(F.count("*").alias("tf"))
    return cosines(base.where(F.size("head") > 0).select("id", F.explode("head").alias("w")), t, n, least)


def own_licenses(base: DataFrame, texts: dict[str, dict[int, int]], least: float = LEAST) -> DataFrame:
    """id, license, score of the files with a license of their own, by whole texts first, then by notices."""
    n, with_cue = base.agg(F.count("*"), F.count_if(F.size("pairs") > 0)).first()
    both = whole_texts(base, texts, with_cue, least).withColumn("o", F.lit(0)).unionByName(by_notices(base, n, least).withColumn("o", F.lit(1)))
    return both.groupBy("id").agg(F.min(F.struct("o", "license", "score")).alias("b")).select("id", "b.license", "b.score")


def scan(files: DataFrame, least: float = LEAST, license_file: str = "(?i)(^|/)(licen[sc]e|copying)([.][^/]*)?$") -> DataFrame:
    """key, path, license, score, via ('own', 'inherited', 'none'), from_dir; files: key, path, text."""
    texts = text_templates(files.sparkSession)
    base = prepared(files)
    known = kept(base.select("id", "key", "path").join(kept(own_licenses(base, texts, least)), "id", "left"))
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    dirs = (
        known.where(F.col("path").rlike(license_file) & F.col("license").isNotNull()).select(parent.alias("dir"), "license", "score")
        .groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
        .select("dir", F.col("b.license").alias("dir_license"), (-F.col("b.s")).alias("dir_score"))
    )
    # the distinct directories of files without a license, each with its ancestors
    need = known.where(F.col("license").isNull() & F.col("path").isNotNull()).select(parent.alias("home")).distinct()
    parts = F.when(F.col("home") == "", F.array().cast("array<string>")).otherwise(F.split("home", "/"))
    levels = need.select("home", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("depth", "dir"))
    near = kept(levels.join(dirs, "dir").groupBy("home").agg(F.max(F.struct("depth", "dir", "dir_license", "dir_score")).alias("m")))
    out = known.withColumn("home", F.when(F.col("license").isNull(), parent)).join(near, "home", "left")
    via = F.when(F.col("license").isNotNull(), "own").when(F.col("m").isNotNull(), "inherited").otherwise("none")
    return out.select("key", "path", F.coalesce("license", "m.dir_license").alias("license"), F.coalesce("score", "m.dir_score").alias("score"), via.alias("via"), F.when(F.col("license").isNull(), F.col("m.dir")).alias("from_dir"))


def tree_path(doc_id, source):
    """A directory tree for documents, which have none: source/shard/part, where each 64th document
    is its directory's license file, that of each 1024th lying one level higher."""
    top = F.concat_ws("/", F.coalesce(source, F.lit("none")), F.concat(F.lit("s"), F.floor(doc_id / 1024).cast("long").cast("string")))
    low = F.concat(top, F.lit("/p"), F.floor(doc_id / 64).cast("long").cast("string"))
    return (
        F.when(doc_id % 1024 < 64, F.concat(top, F.lit("/LICENSE."), doc_id.cast("string")))
        .when(doc_id % 64 < 16, F.concat(low, F.lit("/LICENSE."), doc_id.cast("string")))
        .otherwise(F.concat(low, F.lit("/f"), doc_id.cast("string"), F.lit(".txt")))
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = scan(docs.select(F.col("doc_id").alias("key"), tree_path(F.col("doc_id"), F.col("source")).alias("path"), "text"))
    return out.withColumnRenamed("key", "doc_id")


def _oracle() -> str:
    values = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in sorted(TEMPLATES.items()))
    words = "list_filter(list_transform(regexp_split_to_array({}, '[^a-z0-9.]+'), lambda w: trim(w, '.')), lambda w: w <> '')"
    header = words.format("array_to_string(list_filter(string_split(lower(text), chr(10)), lambda x: regexp_matches(x, '" + CUE + "')), ' ')")
    return f"""
with f as (select doc_id as key, text,
    case when doc_id % 1024 < 64 then top || '/LICENSE.' || doc_id when doc_id % 64 < 16 then low || '/LICENSE.' || doc_id else low || '/f' || doc_id || '.txt' end as path
  from (select *, top || '/p' || (doc_id // 64) as low from (select *, coalesce(source, 'none') || '/s' || (doc_id // 1024) as top from documents))),
tf as (select key, w, count(*) as tf from (select key, unnest({header}) as w from f where regexp_matches(lower(text), '{CUE}')) group by all),
df as (select w, count(*) as df from tf group by w),
n as (select count(*) as n from f),
t as (select license, w, count(*) as tf from (select license, unnest({words.format('lower(text)')}) as w from (values {values}) v(license, text)) group by all),
tw as (select license, w, tf * (ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0) as tx from t left join df using (w), n),
tn as (select license, sqrt(sum(tx * tx)) as tn from tw group by license),
fw as (select key, w, tf * (ln((n + 1.0) / (df + 1.0)) + 1.0) as fx from tf join df using (w), n),
fn as (select key, sqrt(sum(fx * fx)) as fn from fw group by key),
c as (select key, license, round(sum(fx * tx) / (any_value(fn) * any_value(tn)), 6) as score from fw join tw using (w) join tn using (license) join fn using (key) group by all),
own as (select key, split_part(license, '#', 1) as license, score from c where score >= {LEAST} qualify row_number() over (partition by key order by score desc, c.license) = 1),
k as (select f.key, f.path, regexp_replace(f.path, '/[^/]*$', '') as home, own.license, own.score from f left join own using (key)),
d as (select home as dir, license, score from k where license is not null and regexp_matches(path, '(?i)(^|/)(licen[sc]e|copying)([.][^/]*)?$')
  qualify row_number() over (partition by home order by score desc, license) = 1),
a as (select k.key, d.dir, d.license as dl, d.score as ds from k join d on k.license is null and (k.home = d.dir or starts_with(k.home, d.dir || '/'))
  qualify row_number() over (partition by k.key order by length(d.dir) desc) = 1)
select k.key as doc_id, k.path, coalesce(k.license, a.dl) as license, coalesce(k.score, a.ds) as score,
  case when k.license is not null then 'own' when a.dl is not null then 'inherited' else 'none' end as via, a.dir as from_dir
from k left join a using (key)
"""


ORACLE = _oracle()

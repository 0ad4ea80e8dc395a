"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.  All but the
last return the columns of documents.  Stages are written in the shared folder that
``spark.checkpoint.dir`` names (only a local master may do without), and a stage's folder
goes when its successor is written.

All stages pass columns beyond (doc_id, text, lang, source, n_chars) on untouched, whatever
their names, keep rows with nulls in any column, and turn an empty table into an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import decontaminate, linededup, mixing, ordermh, toxicity
from chronoweave.llm.textops import crc_mod, quoted, read, unused
from chronoweave.storage import kept, remove, shared_dir

#: the pipeline is judged by SQL nowhere: training, alignment and raking are iterative
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts get the score of a text without words; repeated rows share one
    score; without labels of both classes nothing goes.
    """
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), rows=lambda i: crc_mod(i, 5) != 0)
    score, predicted = unused(docs, 2)
    return toxicity.score(docs, model, docs.columns, (score, predicted)).where(F.col(predicted) == 0).drop(score, predicted)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go; n_chars follows the text.

    Null texts stay null; rows that repeat a doc_id are one document for the count; a text
    that loses all its lines stays as an empty one.
    """
    n_lines, n_dropped, text = unused(docs, 3)
    out = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs, min_docs=10, min_chars=1), n_lines, n_dropped, text)
    changed = F.col(n_dropped) > 0
    new = {"text": F.when(changed, F.col(text)).otherwise(F.col("text")), "n_chars": F.when(changed, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[new[c].alias(c) if c in new else quoted(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays: that of least doc_id (null ids last), then of least text hash, then of least row hash.

    Rows are told apart by id and text, so versions of a doc_id are rows of their own; equal
    rows leave one; null and empty texts are near to nothing, but equal rows of them leave one.
    """
    key, row, n, cls, at = unused(docs, 5)
    null_safe = [x for c in docs.columns for x in (quoted(c).isNull(), quoted(c))]
    keyed = docs.withColumns({key: F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"), row: F.xxhash64(*null_safe)})
    classes = ordermh.near_classes(keyed.select(F.col(key).alias("doc_id"), "text")).toDF(key, cls)
    rows = keyed.groupBy(key, row).agg(F.count("*").alias(n), F.min("doc_id").alias(at)).join(classes, key)
    rows = kept(rows.withColumn(at, F.struct(F.col(at).isNull(), at, key, row)))
    best = rows.groupBy(cls).agg(F.min(at).alias(at)).select(F.col(f"{at}.{key}").alias(key), F.col(f"{at}.{row}").alias(row))
    # what goes is a short list beside the texts that stay
    gone = rows.select(key, row).join(best, [key, row], "left_anti")
    equal = rows.where(F.col(n) > 1).select(key, row).join(best, [key, row], "left_semi")
    out = keyed.join(kept(gone.unionByName(equal)), [key, row], "left_anti")
    return out.unionByName(keyed.join(kept(equal), [key, row], "left_semi").dropDuplicates([key, row])).select(*[quoted(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (all of a shorter one) go.

    Null and empty texts hold nothing; repeated rows go or stay together.
    """
    names = unused(docs, 6)
    out = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), keep=docs.columns, names=tuple(names))
    return out.where(~F.col(names[-1])).drop(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by calibrated probabilities, with topic, tokens, weight and keep_prob (``mix_`` before those that documents already have).

    Null source and lang are values of their own; repeated rows share one draw.
    """
    have = {c.lower() for c in docs.columns}
    out = []
    for c in mixing.OUT:
        while c in have:
            c = f"mix_{c}"
        out.append(c)
    return mixing.mix(docs, out=tuple(out)).where(F.col(out[-1])).drop(out[-1])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs

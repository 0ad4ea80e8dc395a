"""Scans and sinks: Parquet by match partitions, CSV with a schema, gated and resumable output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import remove


def read_matches(spark: SparkSession, path: str, match_ids: list[str] | None = None) -> DataFrame:
    """A table laid out by ``match_id``; only the named matches' files are read."""
    df = spark.read.parquet(path)
    return df if match_ids is None else df.where(F.col("match_id").isin(match_ids))


def read_csv(spark: SparkSession, path: str, schema: str, pattern: str | None = None) -> DataFrame:
    r = spark.read.schema(schema).option("header", True)
    return (r.option("pathGlobFilter", pattern) if pattern else r).csv(path)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and time of files, without their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def file_of(spark: SparkSession, path: str, keyword: str, match_id: str) -> str:
    """The first file, by path, whose name holds the keyword and the match id; an error if there is none."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    got = listing(spark, path).where(name.contains(keyword) & name.contains(match_id)).agg(F.min("path")).first()[0]
    if got is None:
        raise FileNotFoundError(f"no file of {path} holds {keyword!r} and {match_id!r}")
    return got


def accepted(synced: DataFrame, limit: int = 50) -> DataFrame:
    """match_id, unsynced, ok: a match is written when at most ``limit`` of its events lack a frame."""
    return synced.groupBy("match_id").agg(F.count_if(F.col("frame_id").isNull()).alias("unsynced")).withColumn("ok", F.col("unsynced") <= limit)


def pending(matches: DataFrame, written: DataFrame) -> DataFrame:
    """Matches without output yet."""
    return matches.select("match_id").distinct().join(written.select("match_id").distinct(), "match_id", "left_anti")


def trim_tail(synced: DataFrame, frames: DataFrame) -> DataFrame:
    """Without events after the last synced event, where that lies in the last two episodes of its match."""
    last_ep = frames.groupBy("match_id").agg(F.max("episode_id").alias("__last"))
    lf = synced.groupBy("match_id").agg(F.max(F.when(F.col("frame_id").isNotNull(), F.struct("event_idx", "frame_id"))).alias("__m"))
    at = lf.join(frames.select("match_id", F.col("frame_id").alias("__f"), "episode_id"), (lf["match_id"] == frames["match_id"]) & (F.col("__m.frame_id") == F.col("__f"))).select(lf["match_id"], F.col("__m.event_idx").alias("__cut"), F.col("episode_id").alias("__ep"))
    j = synced.join(F.broadcast(at.join(last_ep, "match_id")), "match_id", "left")  # one row a match
    return j.where(F.col("__cut").isNull() | (F.col("__ep") < F.col("__last") - 1) | (F.col("event_idx") <= F.col("__cut"))).select(*synced.columns)


def write_synced(synced: DataFrame, path: str, limit: int = 50, fmt: str = "csv") -> DataFrame:
    """Write accepted matches, a folder each, replacing only theirs; returns the status of every match."""
    status = accepted(synced, limit)
    good = synced.join(status.where("ok").select("match_id"), "match_id", "left_semi")
    w = good.repartition("match_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("match_id")
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)
    return status


def drop_output(matches: DataFrame, path: str) -> int:
    """Remove the written folders of ``matches`` (match_id); their number.  The list goes match by match through the driver."""
    spark = matches.sparkSession
    return sum(remove(spark, f"{path}/match_id={r[0]}") for r in matches.select("match_id").toLocalIterator())

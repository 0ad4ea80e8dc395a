"""Where intermediate results are kept: always storage that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


#: files of an intermediate result, for each core
FILES = 8


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and stage tables: ``spark.checkpoint.dir``, or the context's own.

    Only a local master may do without, and gets a temporary folder; on a cluster executors
    and driver share no local folder, so a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp())
        own = sc._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


def kept(df: DataFrame, files: int | None = None) -> DataFrame:
    """The same rows, computed once and read again from shared storage; plans above start from there.

    They lie in ``files`` files, or ``FILES`` a core, at most, all read by the next step: each costs a local file
    system three processes or more for its permissions, and a large number of them slows small steps.
    """
    spark = df.sparkSession
    shared_dir(spark)
    return df.coalesce(files or FILES * max(4, spark.sparkContext.defaultParallelism)).checkpoint()


def released(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more.

    Spark deletes them when the driver collects its garbage, which it may not do for long.
    """
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder of any file system that Spark reads; False if there was none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

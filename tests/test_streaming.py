from pyspark.sql import functions as F

from chronoweave import queries as q
from chronoweave.operators import temporal as tmp
from chronoweave.streaming.sync import stream_episodes, stream_forward_only

SF = "/root/testdata/sf0.001"


def run(df, name, mode="append"):
    s = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    s.processAllAvailable()
    s.stop()
    return df.sparkSession.sql(f"select * from {name}")


def test_forward_only_equals_batch(spark, tmp_path):
    ev = q.matched(spark, SF).withColumn("lo", F.col("event_frame") - 4).withColumn("hi", F.col("event_frame") + 4)
    f = q.frames(spark, SF).select("user_id", "frame_id", F.col("value").alias("fvalue"))
    c = tmp.range_join(ev, f, ["user_id"], "lo", "hi", "frame_id", width=8)
    arr = c.groupBy("user_id", "event_id").agg(F.array_sort(F.collect_list(F.struct("frame_id", "fvalue"))).alias("cands"))
    arr.coalesce(1).write.parquet(str(tmp_path / "c"))
    from chronoweave.plans.fold import forward_only

    want = sorted(map(tuple, forward_only(arr, "user_id", ["event_id"], "event_id").collect()))
    got = run(stream_forward_only(spark.readStream.schema(arr.schema).parquet(str(tmp_path / "c"))), "fwd")
    assert sorted(map(tuple, got.collect())) == want


def test_sessions_close(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    got = run(stream_episodes(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))), "ses")
    assert got.count() > 0

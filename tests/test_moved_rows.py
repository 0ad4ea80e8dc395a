"""Frames of a match are many times its events: steps by match leave them where they are."""

import pytest

from chronoweave import registry

SF = "/root/testdata/sf0.01"


def moved(spark, df) -> int:
    """Records that the stages of a run write to shuffle files."""
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    df().write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    got = stages()
    return sum(s.shuffleWriteRecords() for s in (got.apply(i) for i in range(got.size())) if s.stageId() not in before)


@pytest.mark.parametrize("name, most", [("frame_features", 10), ("receive_features", 15), ("sync_full", 40)])
def test_frames_are_not_moved(spark, name, most):
    """At most so many records for each row of events; five tracking rows of ten frames are made of 0.6 of these."""
    rows = spark.read.parquet(f"{SF}/events.parquet").count()
    assert moved(spark, lambda: registry.queries()[name](spark, SF)) <= most * rows


def test_wanted_frames_and_ranges(spark):
    from pyspark.sql import functions as F

    from chronoweave.operators import temporal as tmp

    frames = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 3), (None, 3)], "m string, f long")
    events = spark.createDataFrame([("a", 1, 3, 12), ("a", 2, 12, 3), ("b", 3, 0, 3), ("c", 4, 0, 9), (None, 5, 0, 9), ("a", 6, None, 4)], "m string, i long, lo long, hi long")
    got = {tuple(r) for r in tmp.wanted(frames, events, ["m"], "f", "lo").collect()}
    assert got == {("a", 3), ("a", 12)}
    got = sorted(tuple(r) for r in tmp.in_ranges(frames, events, ["m"], "lo", "hi", "f", 4).select("m", "f", F.col("event.i")).collect())
    assert got == [("a", f, 1) for f in range(3, 13)] + [("b", 3, 3)]

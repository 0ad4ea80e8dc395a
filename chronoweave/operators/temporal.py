"""Sessions, nearest-time joins, range joins and window operators over ordered frames.

All take the key columns that make one series (match, period, object); a series is never
collected, and every exchange is on its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def series(keys: list[str], *order) -> object:
    return Window.partitionBy(*keys).orderBy(*order)


def episodes(frames: DataFrame, keys: list[str], frame: str = "frame_id", gap: float = 5, period: str | None = None, out: str = "episode_id") -> DataFrame:
    """A new episode where the frame gap reaches ``gap`` or a period begins; numbered from 1 over the keys."""
    inner = series([*keys, *([period] if period else [])], frame)
    step = F.col(frame) - F.lag(frame).over(inner)
    flag = F.when(step.isNull() | (step >= gap), 1).otherwise(0)
    outer = series(keys, *([period] if period else []), frame).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("__new", flag).withColumn(out, F.sum("__new").over(outer)).drop("__new")


def nearest(events: DataFrame, frames: DataFrame, keys: list[str], event_time: str, frame_time: str, frame: str = "frame_id", tolerance: float | None = None, out: str = "event_frame", carry: dict[str, str] | None = None) -> DataFrame:
    """As-of join: for each event the frame nearest in time; ties go to the earlier frame.

    One union sorted by time in each key; the last frame before and the first after come
    from two null-skipping windows, so the cost is that of one sort.  Frames of equal time
    count as their least.  ``carry`` names columns of the frame that come along.
    """
    carry = carry or {}
    f = frames.groupBy(*keys, F.col(frame_time).alias("__t")).agg(F.min(F.struct(F.col(frame).alias("__f"), *[F.col(c).alias(n) for c, n in carry.items()])).alias("__f"))
    e = events.withColumn("__t", F.col(event_time))
    both = f.withColumn("__side", F.lit(0)).unionByName(e.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("__m", F.when(F.col("__side") == 0, F.struct("__t", "__f")))
    back = series(keys, "__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = series(keys, "__t", F.desc("__side")).rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumn("__a", F.last("__m", True).over(back)).withColumn("__b", F.first("__m", True).over(ahead))
    da, db = F.col("__t") - F.col("__a.__t"), F.col("__b.__t") - F.col("__t")
    pick = F.when(F.col("__b").isNull() | (da <= db), F.col("__a")).otherwise(F.col("__b"))
    got = both.where("__side = 1").withColumn("__p", F.coalesce(pick, "__b"))
    found = F.col("__p.__f")
    if tolerance is not None:
        found = F.when(F.abs(F.col("__p.__t") - F.col("__t")) <= tolerance, found)
    return got.withColumn("__p", found).select(*[F.col(c) for c in events.columns], F.col("__p.__f").alias(out), *[F.col(f"__p.{n}").alias(n) for n in carry.values()])


def merge_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join with a table of frames, which is never broadcast.

    Spark takes a generated table (exploded frames, objects of a frame) to be as small as the
    file it comes from and would send it whole through the driver.
    """
    return left.join(right.hint("merge"), keys, how)


def range_join(left: DataFrame, right: DataFrame, keys: list[str], lo: str, hi: str, at: str, width: int, how: str = "inner") -> DataFrame:
    """Rows of ``right`` whose ``at`` lies in [lo, hi] of a left row with equal keys.

    Both sides are cut into buckets of ``width``: a left row goes to each bucket that its
    range touches, so the join is an equi-join on (keys, bucket) with a residual filter.
    Pick ``width`` near the usual range length.  It is always a merge join, see ``merge_join``.
    """
    b = F.explode_outer(F.when(F.col(lo) <= F.col(hi), F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    l = left.withColumn("__b", b)
    renamed = {k: f"__r_{k}" for k in keys}
    r = right.withColumnsRenamed(renamed).withColumn("__b2", F.floor(F.col(at) / width))
    on = (F.col("__b") == F.col("__b2")) & F.col(at).between(F.col(lo), F.col(hi))
    for k in keys:
        on = on & (l[k] == r[f"__r_{k}"])
    return l.join(r.hint("merge"), on, how).drop("__b", "__b2", *renamed.values())


def by_key(frames: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join with a table of one row a key, which is dealt out as the frames are, if they lie by these keys.

    Of two sides that lie by the keys Spark moves the one of fewer partitions, be it the larger.  Keys that
    are computed anew hide how ``one`` lies, so it is the side that moves.
    """
    hidden = {k: F.when(F.col(k).isNotNull(), F.col(k)) for k in keys}
    return frames.join(one.withColumns(hidden).hint("shuffle_hash"), keys)


def wanted(frames: DataFrame, events: DataFrame, keys: list[str], at: str = "frame_id", event_at: str = "frame_id") -> DataFrame:
    """Rows of ``frames`` that some event of the same keys names, so that a join with events moves no others.

    The wanted frames of a key go to its frames as one array; frames that lie by these keys already stay there.
    """
    w = events.where(F.col(event_at).isNotNull()).groupBy(*keys).agg(F.collect_set(event_at).alias("__want"))
    return by_key(frames, w, keys).where(F.array_contains("__want", F.col(at))).drop("__want")


def in_ranges(frames: DataFrame, events: DataFrame, keys: list[str], lo: str, hi: str, at: str, width: int, out: str = "event") -> DataFrame:
    """``range_join`` for rows that become many more: each row of ``frames`` once for every event with equal keys whose [lo, hi] holds ``at``, as the struct ``out``.

    The events of a key go to its frames as one map from buckets of ``width`` to events, so frames that lie by
    these keys already stay there, and so do the joined rows.  A key's events are held in memory.
    """
    e = events.withColumn("__b", F.explode(F.when(F.col(lo) <= F.col(hi), F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))))
    e = e.groupBy(*keys, "__b").agg(F.collect_list(F.struct(*events.columns)).alias("__e"))
    e = e.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__b", "__e"))).alias("__m"))
    j = by_key(frames, e, keys)
    held = F.filter(F.try_element_at("__m", F.floor(F.col(at) / width)), lambda v: F.col(at).between(v[lo], v[hi]))
    return j.select(*frames.columns, F.explode(held).alias(out))


def first_run(frames: DataFrame, keys: list[str], frame: str = "frame_id") -> DataFrame:
    """The first stretch of consecutive frames of each series."""
    w = series(keys, frame)
    step = F.when(F.col(frame) - F.lag(frame).over(w) > 1, 1).otherwise(0)
    run = F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return frames.withColumn("__s", step).withColumn("__r", run).where("__r < 1").drop("__s", "__r")


def first_gap(frames: DataFrame, keys: list[str], frame: str = "frame_id", out: str = "gap_frame") -> DataFrame:
    """The frame before the first gap, or the last frame."""
    w = series(keys, frame)
    gap = F.when(F.lead(frame).over(w) - F.col(frame) > 1, F.col(frame))
    return frames.withColumn("__g", gap).groupBy(*keys).agg(F.coalesce(F.min("__g"), F.max(frame)).alias(out))


def ends(frames: DataFrame, keys: list[str], n: int, frame: str = "frame_id", tail: bool = False) -> DataFrame:
    """The first (or last) n frames of each series."""
    w = series(keys, F.desc(frame) if tail else F.asc(frame))
    return frames.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def near_extreme(value: Column, keys: list[str], frame: str, fn=F.min, before: int = 3, after: int = 3) -> Column:
    """Minimum or maximum over frames in [frame - before, frame + after], by frame value."""
    return fn(value).over(Window.partitionBy(*keys).orderBy(frame).rangeBetween(-before, after))


def between_candidates(cands: DataFrame, signal: DataFrame, keys: list[str], value: str, frame: str = "frame_id", width: int = 64, out: str = "kick_dist", backward: bool = False) -> DataFrame:
    """For each candidate the maximum of ``value`` up to the next candidate (or from the one before), both ends included."""
    w = series(keys, frame)
    own = F.col(frame)
    if backward:
        c = cands.withColumn("__lo", F.lag(frame).over(w)).withColumn("__hi", own)
        edge = signal.groupBy(*keys).agg(F.min(frame).alias("__end"))
        c = c.join(edge, keys, "left").withColumn("__lo", F.coalesce("__lo", "__end")).drop("__end")
    else:
        c = cands.withColumn("__lo", own).withColumn("__hi", F.lead(frame).over(w))
        edge = signal.groupBy(*keys).agg(F.max(frame).alias("__end"))
        c = c.join(edge, keys, "left").withColumn("__hi", F.coalesce("__hi", "__end")).drop("__end")
    s = signal.select(*keys, F.col(frame).alias("__at"), F.col(value).alias("__v"))
    got = range_join(c.select(*keys, frame, "__lo", "__hi"), s, keys, "__lo", "__hi", "__at", width)
    top = got.groupBy(*keys, frame).agg(F.max("__v").alias(out))
    return c.drop("__lo", "__hi").join(top, [*keys, frame], "left")


def top1(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def forward_fill(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, True).over(w) for c in columns})


def back_fill(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.first(c, True).over(w) for c in columns})


def nearest_object(a: DataFrame, b: DataFrame, keys: list[str], ax: str, ay: str, bx: str, by: str, tie: str, eligible: Column | None = None, penalty: float | None = None) -> DataFrame:
    """For each row of ``a`` the nearest row of ``b`` with equal keys; rows that are not eligible count as ``penalty`` away, or drop out."""
    j = a.join(b, keys)
    d = F.sqrt((F.col(ax) - F.col(bx)) ** 2 + (F.col(ay) - F.col(by)) ** 2)
    if eligible is not None:
        if penalty is None:
            j = j.where(eligible)
        else:
            d = F.when(eligible, d).otherwise(penalty)
    return top1(j.withColumn("dist", d), a.columns, "dist", tie)

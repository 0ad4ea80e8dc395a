"""What is made of synced events: merges with tracking, receive rows, frame tables, and accuracy against annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import vocab
from ..functions import times
from ..operators.relational import drop_null_columns, segments, strided, valid_range

LIMITS = (5, 25, 50)
CATEGORY = {t: c for c, ts in (("pass_like", vocab.PASS_LIKE_OPEN), ("set_piece", vocab.SET_PIECE), ("incoming", vocab.INCOMING), ("minor", vocab.MINOR)) for t in ts}


def category_of(event_type):
    """The accuracy category of an event type; null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv]), event_type)


def merge_synced(events: DataFrame, wide: DataFrame, fps: int = 25, fill: bool = False) -> DataFrame:
    """Wide frames with the synced events of their time (player_id, event_type, event_x and event_y at the ball) and the annotated places (annot_x, annot_y) of theirs.

    Joined on match, period and seconds in hundredths; several events of a frame repeat it;
    ``fill`` carries the last event on within its match.
    """
    hundredths = lambda s: F.rint(s * 100).cast("long")
    keys = ["match_id", "period_id", "__t"]
    synced = events.where("synced_ts is not null").select("match_id", "period_id", hundredths(times.parse_clock(F.col("synced_ts"))).alias("__t"), "player_id", F.col("spadl_type").alias("event_type"))
    first = Window.partitionBy("match_id", "period_id")
    since = (times.micros(F.col("utc_timestamp")) - F.min(times.micros(F.col("utc_timestamp"))).over(first)) / 1e6
    annot = events.select("match_id", "period_id", hundredths(F.rint(since * fps) / fps).alias("__t"), F.col("start_x").alias("annot_x"), F.col("start_y").alias("annot_y"))
    m = wide.withColumn("__t", hundredths(F.col("timestamp"))).join(synced, keys, "left").join(annot, keys, "left").drop("__t")
    m = m.withColumn("event_x", F.when(F.col("player_id").isNotNull(), F.col("ball_x"))).withColumn("event_y", F.when(F.col("player_id").isNotNull(), F.col("ball_y")))
    if fill:
        w = Window.partitionBy("match_id").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, 0)
        m = m.withColumns({c: F.last(c, True).over(w) for c in ("player_id", "event_type", "event_x", "event_y", "annot_x", "annot_y")})
    return m


def with_receives(synced: DataFrame) -> DataFrame:
    """match_id, period_id, frame_id, player_id, event_type: synced events and, where it comes before the next event's frame, a 'receive' of each; one row a frame, events first."""
    w = Window.partitionBy("match_id").orderBy("event_idx")
    e = synced.withColumn("__next", F.lead("frame_id").over(w)).withColumn("__last", F.lead("event_idx").over(w).isNull())
    # an unsynced next event bounds nothing, so its receive is left out; the last event has no bound
    more = e.where(F.col("receive_frame_id").isNotNull() & (F.col("__last") | (F.col("receive_frame_id") < F.col("__next"))))
    cols = ["match_id", "period_id", "frame_id", "player_id", "event_type", "__o"]
    rows = e.where("frame_id is not null").select("match_id", "period_id", "frame_id", "player_id", F.col("spadl_type").alias("event_type"), F.col("event_idx").cast("double").alias("__o")).select(*cols)
    extra = more.select("match_id", "period_id", F.col("receive_frame_id").alias("frame_id"), F.col("receiver_id").alias("player_id"), F.lit("receive").alias("event_type"), F.lit(1e18).alias("__o"))
    k = Window.partitionBy("match_id", "frame_id").orderBy("__o", "player_id")
    return rows.unionByName(extra).withColumn("__k", F.row_number().over(k)).where("__k = 1").drop("__k", "__o")


def frame_table(merged: DataFrame, step: int = 1, start: int = 0, segment: int = 7500, rotate: bool = False) -> DataFrame:
    """The data of an animation: every ``step``-th frame with its segment and clock, without columns that are never known; ``rotate`` turns the pitch."""
    t = drop_null_columns(segments(strided(merged, ["match_id"], ["frame_id"], step), "frame_id", start, segment))
    for end, size in (("_x", vocab.PITCH_X), ("_y", vocab.PITCH_Y)) if rotate else ():
        t = t.withColumns({c: F.lit(size) - F.col(c) for c in t.columns if c.endswith(end)})
    return t.withColumn("clock", times.display_clock(F.col("timestamp")))


def in_play(table: DataFrame) -> DataFrame:
    """match_id, object, first, last: the frames between which each object has a place."""
    xs = [c for c in table.columns if c.endswith("_x") and c not in ("event_x", "annot_x")]
    return valid_range(table, ["match_id"], "frame_id", xs).withColumn("object", F.regexp_replace("column", "_x$", "")).select("match_id", "object", "first", "last")


def player_numbers(players: DataFrame) -> DataFrame:
    """match_id, object, number: dense numbers by team, for anonymous labels."""
    w = Window.partitionBy("match_id", F.split_part("object", F.lit("_"), F.lit(1))).orderBy(F.split_part("object", F.lit("_"), F.lit(2)).try_cast("int"))
    return players.where(F.col("object").rlike("^(home|away)_")).select("match_id", "object", F.dense_rank().over(w).alias("number"))


def clean_annotations(annotated: DataFrame) -> DataFrame:
    """First periods, without shielding the ball, touches under their usual name; frames from the clocks."""
    # fixed values: names of the annotation
    a = annotated.where((F.col("period_id") == 1) & (F.col("spadl_type") != "shield_ball_oop"))
    return a.withColumns({"spadl_type": F.when(F.col("spadl_type") == "ball_touch", "bad_touch").otherwise(F.col("spadl_type")), "frame": times.clock_to_frame(F.col("synced_ts")), "receive_frame": times.clock_to_frame(F.col("receive_ts"))})


def align_annotations(annotated: DataFrame, events: DataFrame, ball: DataFrame, start, fps: int = 25) -> DataFrame:
    """Annotations with time and place: those of the recorded event that has the same rank (missing ones have none), else of their frame and the ball there.

    annotated: match_id, row, error_type, frame ...; events: match_id, event_idx, utc_timestamp,
    start_x, start_y; ball: match_id, frame_id, x, y; ``start``: Column of the period's start.
    """
    known = F.coalesce(F.col("error_type") != "missing", F.lit(True))
    w = Window.partitionBy("match_id", known).orderBy("row")
    rank = F.when(known, F.row_number().over(w) - 1)
    e = events.select("match_id", (F.row_number().over(Window.partitionBy("match_id").orderBy("event_idx")) - 1).alias("__k"), F.col("utc_timestamp").alias("__u"), F.col("start_x").alias("__x"), F.col("start_y").alias("__y"))
    b = ball.select("match_id", F.col("frame_id").alias("frame"), F.col("x").alias("__bx"), F.col("y").alias("__by"))
    j = annotated.withColumn("__k", rank).join(e, ["match_id", "__k"], "left").join(b, ["match_id", "frame"], "left")
    pick = lambda own, other: F.when(known, own).otherwise(other)
    j = j.withColumns({"utc_timestamp": pick(F.col("__u"), times.utc_of_frame(F.col("frame"), start, fps)), "start_x": pick(F.col("__x"), F.col("__bx")), "start_y": pick(F.col("__y"), F.col("__by"))})
    return j.drop("__k", "__u", "__x", "__y", "__bx", "__by")


def accuracy_report(synced: DataFrame, methods: bool = False) -> DataFrame:
    """Counts and rates of frame differences: by category, over all starts ('event_start'), ends ('event_end') and both ('total').

    synced: spadl_type, frame_id, true_frame, receive_frame_id, true_receive and, with
    ``methods``, method, by which the report is grouped.  One pass, by grouping sets.
    """
    by = ["method"] if methods else []
    passes = F.col("spadl_type").isin([*vocab.PASS_LIKE_OPEN, *vocab.SET_PIECE])
    ends = F.array(
        F.struct(F.lit("event_start").alias("side"), category_of(F.col("spadl_type")).alias("category"), F.lit(True).alias("counts"), (F.col("frame_id") - F.col("true_frame")).alias("diff"), F.col("frame_id").alias("got")),
        F.struct(F.lit("event_end").alias("side"), F.lit("event_end").alias("category"), passes.alias("counts"), (F.col("receive_frame_id") - F.col("true_receive")).alias("diff"), F.col("receive_frame_id").alias("got")),
    )
    rows = synced.select(*by, F.inline(ends))
    d = F.abs("diff")
    sets = [[*by, "side", "category"], [*by, "side"], by]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*by, "side", "category"]]).agg(
        F.grouping_id().alias("__g"), F.count_if("counts").alias("total"), F.sum(d).alias("__sum"), F.count("diff").alias("__n"), F.count_if(d == 0).alias("exact"), *[F.count_if(d <= k).alias(f"within_{k}") for k in LIMITS], F.count("got").alias("valid")
    )
    # of event_end the category rows repeat the side's row; an unknown type has no row of its own
    out = out.where(~((F.col("__g") == 0) & ((F.col("side") == "event_end") | F.col("category").isNull())))
    name = F.when(F.col("__g") == 0, F.col("category")).when(F.col("__g") == 1, F.col("side")).otherwise("total")
    mean = F.when(F.col("__g") == 3, F.try_divide("__sum", "total")).otherwise(F.try_divide("__sum", "__n"))
    rate = lambda c: F.round(F.try_divide(F.col(c), F.col("total")), 6).alias(f"{c}_rate")
    counts = ["exact", *[f"within_{k}" for k in LIMITS], "valid"]
    return out.select(*by, name.alias("category"), "total", F.round(mean, 6).alias("mean_diff"), *counts, *[rate(c) for c in counts])


def accuracy_by_method(methods: dict[str, DataFrame]) -> DataFrame:
    """The report of several synchronisers over the same annotations."""
    both = None
    for name, df in methods.items():
        part = df.select(F.lit(name).alias("method"), "spadl_type", "frame_id", "true_frame", "receive_frame_id", "true_receive")
        both = part if both is None else both.unionByName(part)
    return accuracy_report(both, methods=True)

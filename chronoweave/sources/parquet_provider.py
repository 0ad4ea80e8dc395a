"""Provider that delivers Parquet: action events of many matches, lineups, and wide tracking."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .typing_rules import rules
from .. import vocab
from ..functions import times
from ..operators.relational import first_valid, single_valued, unpivot_objects
from ..operators.signal import kinematics

# fixed values: the provider's columns of a match and of an event's time
MATCH, TIME = "stats_perform_match_id", "time_stamp"
SHOTS = ["shot", "shot_freekick", "shot_penalty"]


def prepare(events: DataFrame, lineups: DataFrame, match: str = MATCH) -> DataFrame:
    """Raw events with utc_timestamp and the players' positions; only matches on one date, and players of the lineup."""
    e = events.withColumn("utc_timestamp", F.col(TIME).cast("timestamp_ntz")) if "utc_timestamp" not in events.columns else events
    at = lineups.select(match, "player_id", "advanced_position").dropDuplicates([match, "player_id"])
    return one_date(e, match).join(at, [match, "player_id"])


def drop_failed_tackles(events: DataFrame) -> DataFrame:
    return events.where(~((F.col("spadl_type") == "tackle") & ~F.coalesce("success", F.lit(False))))


def object_ids(wide: DataFrame, match: str = MATCH) -> DataFrame:
    """match, player_id, object_id from columns ``home_<n>_id`` and ``away_<n>_id``: the first known id of each; a player of two columns has the last."""
    names = [c for c in wide.columns if re.fullmatch(r"(home|away)_[0-9]+_id", c)]
    first = first_valid(wide.withColumn("__at", F.struct("period_id", "timestamp")), [match], "__at", names)
    return first.groupBy(match, F.col("value").alias("player_id")).agg(F.max(F.struct(F.length("column"), F.regexp_replace("column", "_id$", "").alias("object_id")))["object_id"].alias("object_id"))


def scale(wide: DataFrame) -> DataFrame:
    """Timestamps in hundredths; the ball's height from centimetres to metres."""
    return wide.withColumns({"timestamp": F.rint(F.col("timestamp") * 100) / 100, "ball_z": F.rint(F.col("ball_z").cast("double")) / 100})


def refine_events(events: DataFrame, wide: DataFrame, match: str = MATCH) -> DataFrame:
    """Typed events with seconds and object ids, turned to the tracking's orientation, without failed tackles and self-passes."""
    e = drop_failed_tackles(events.where("player_id is not null and spadl_type is not null"))
    e = event_seconds(e, match).join(object_ids(wide, match), [match, "player_id"], "left")
    xs = [c for c in wide.columns if re.fullmatch(r"(home|away)_[0-9]+_x", c)]
    t = wide.select(match, "period_id", *xs)
    return drop_self_passes(orient(e, unpivot_objects(t, [match, "period_id"], "", ["x"]), match), match)


def contract_events(refined: DataFrame, match: str = MATCH) -> DataFrame:
    """Events of the synchroniser's contract, numbered in time; player_id is the object id."""
    w = Window.partitionBy(match).orderBy("period_id", "utc_timestamp")
    return refined.where("object_id is not null").select(
        F.col(match).cast("string").alias("match_id"), (F.row_number().over(w) - 1).cast("long").alias("event_idx"), F.col("period_id").cast("long").alias("period_id"), "utc_timestamp",
        F.col("object_id").alias("player_id"), "spadl_type", "success", "start_x", "start_y",
    )


def contract_tracking(wide: DataFrame, events: DataFrame, match: str = MATCH, fps: int = 25) -> DataFrame:
    """Tracking of the synchroniser's contract from raw wide frames; ``events`` give each period's first time."""
    t = scale(wide)
    if "frame_id" not in t.columns or "utc_timestamp" not in t.columns:
        t = tracking_clock(t, events, match, fps)
    t = t.withColumnRenamed(match, "match_id") if match != "match_id" else t
    return long_tracking(t.withColumn("match_id", F.col("match_id").cast("string")).withColumn("period_id", F.col("period_id").cast("long")), "match_id", fps)


def one_date(events: DataFrame, match: str = MATCH) -> DataFrame:
    """Events of matches that lie on exactly one date."""
    e = events.withColumn("date", F.to_date("utc_timestamp"))
    return single_valued(e, match, "date")


def type_events(events: DataFrame, match: str = MATCH, order: tuple = ("utc_timestamp",)) -> DataFrame:
    """spadl_type, success, offside and aerial; neighbours never cross a match."""
    w = Window.partitionBy(match).orderBy(*order)
    a, c = F.col("action_type"), F.col
    cross, penalty = F.coalesce(c("cross").cast("boolean"), F.lit(False)), F.coalesce(c("penalty").cast("boolean"), F.lit(False))
    free = a == "free_kick"
    kick = free & c("free_kick_type").isNotNull()
    keeper = F.coalesce(c("advanced_position") == "goal_keeper", F.lit(False))
    next_keeper = F.coalesce(F.lead("advanced_position").over(w) == "goal_keeper", F.lit(False))
    # fixed values: action names and the types they become
    as_is = ["throw_in", "take_on", "tackle", "interception", "clearance", "bad_touch", "ball_recovery", "dispossessed", "foul"]
    ordered = [
        (a.contains("pass"), F.when(cross, "cross").otherwise("pass")),
        (free & (c("free_kick_type").isNull() | penalty), "foul"),
        (kick & c("expected_goal").isNull(), F.when(cross, "freekick_crossed").otherwise("freekick_short")),
        (a == "corner", F.when(cross, "corner_crossed").otherwise("corner_short")),
        (a == "goal_kick", "goalkick"),
        (a == "goal_attempt", F.when(penalty, "shot_penalty").otherwise("shot")),
        (kick & c("expected_goal").isNotNull(), "shot_freekick"),
        (a == "attempted_tackle", "tackle"),
        (a == "ball_touch", "bad_touch"),
        (a == "save", F.when(keeper, "keeper_save").otherwise("shot_block")),
        (a == "claim", "keeper_claim"),
        (a == "punch", "keeper_punch"),
        (a == "keeper_pick-up", "keeper_pick_up"),
        (a == "keeper_sweeper", F.when(next_keeper, "keeper_sweeper").otherwise("clearance")),
        (a.isin(as_is), a),
    ]
    e = events.withColumn("spadl_type", rules(ordered))
    box = c("start_x").between(vocab.PITCH_X / 2 - 3, vocab.PITCH_X / 2 + 3) & c("start_y").between(vocab.PITCH_Y / 2 - 3, vocab.PITCH_Y / 2 + 3)
    e = e.withColumn("__box", F.coalesce(box, F.lit(False)))
    restart = lambda k: F.coalesce((F.lead("period_id", k).over(w) == c("period_id")) & F.lead("__box", k).over(w), F.lit(False))
    goal = restart(1) | (c("spadl_type").isin("shot", "shot_freekick") & F.coalesce(F.lead("action_type").over(w) == "attempted_tackle", F.lit(False)) & restart(2))
    e = e.withColumn("success", F.when(c("spadl_type").isin(SHOTS), goal).when((a == "attempted_tackle") | a.contains("_pass"), False).otherwise(F.coalesce(c("outcome"), F.lit(False))))
    aerial = (F.lag("action_type").over(w) == "aerial") & (F.lag("player_id").over(w) == c("player_id"))
    return e.withColumn("offside", a == "offside_pass").withColumn("aerial", F.coalesce(aerial, F.lit(False))).drop("__box")


def event_seconds(events: DataFrame, match: str = MATCH) -> DataFrame:
    """timestamp: seconds since the first event of the period."""
    w = Window.partitionBy(match, "period_id").orderBy("utc_timestamp").rowsBetween(Window.unboundedPreceding, 0)
    us = times.micros(F.col("utc_timestamp"))
    return events.withColumn("__us", us).withColumn("timestamp", (F.col("__us") - F.first("__us").over(w)) / 1e6).drop("__us")


def orient(events: DataFrame, tracking: DataFrame, match: str = MATCH) -> DataFrame:
    """In each period rotate the events of the team that attacks leftwards: the one whose objects' mean x, averaged over objects, is larger."""
    per = tracking.groupBy(match, "period_id", "object_id").agg(F.avg("x").alias("mx"))
    side = per.groupBy(match, "period_id").agg(F.avg(F.when(F.col("object_id").startswith("home"), F.col("mx"))).alias("h"), F.avg(F.when(F.col("object_id").startswith("away"), F.col("mx"))).alias("a"))
    side = side.select(match, "period_id", F.when(F.col("h") < F.col("a"), "away").otherwise("home").alias("__turn"))
    j = events.join(F.broadcast(side), [match, "period_id"], "left")  # one row a period
    turn = F.coalesce(F.col("object_id").startswith(F.col("__turn")), F.lit(False))
    flip = lambda c, n: F.when(turn, F.rint((n - F.col(c)) * 100) / 100).otherwise(F.col(c))
    return j.withColumns({"start_x": flip("start_x", vocab.PITCH_X), "start_y": flip("start_y", vocab.PITCH_Y)}).drop("__turn")


def drop_self_passes(events: DataFrame, match: str = MATCH) -> DataFrame:
    """Without passes that the same player follows up within five seconds in the same period."""
    w = Window.partitionBy(match).orderBy("utc_timestamp")
    passes = ["pass", "cross", "freekick_short", "freekick_crossed", *vocab.SET_PIECE_OOP]
    gap = times.micros(F.lead("utc_timestamp").over(w)) - times.micros(F.col("utc_timestamp"))
    bad = F.col("spadl_type").isin(passes) & (gap < 5_000_000) & (F.lead("player_id").over(w) == F.col("player_id")) & (F.lead("period_id").over(w) == F.col("period_id"))
    return events.withColumn("__bad", F.coalesce(bad, F.lit(False))).where(~F.col("__bad")).drop("__bad")


def long_tracking(wide: DataFrame, match: str = "match_id", fps: int = 25, ball_cm: bool = False) -> DataFrame:
    """Wide frames into the long contract: unpivot, kinematics by object and period, then live frames only."""
    ids = [match, "period_id", "frame_id", "timestamp", "utc_timestamp", "ball_state"]
    t = unpivot_objects(wide, ids, "", ["x", "y", "z"]).where(F.col("object_id").rlike("^(home|away)_[0-9]+$|^ball$"))
    if ball_cm:
        t = t.withColumn("z", F.rint(F.col("z")) / 100)
    t = kinematics(t, [match, "period_id", "object_id"], "frame_id", fps).where("ball_state = 'alive'")
    ball = F.col("object_id") == "ball"
    return t.select(match, "frame_id", "period_id", "timestamp", "utc_timestamp", F.when(~ball, F.col("object_id")).alias("player_id"), ball.alias("ball"), "x", "y", F.when(ball, F.col("z")).alias("z"), "speed", "accel_s", "accel_v")


def tracking_clock(tracking: DataFrame, events: DataFrame, match: str = "match_id", fps: int = 25) -> DataFrame:
    """frame_id (the second period follows the first) and utc_timestamp from the seconds of each period and its first event."""
    t = tracking.withColumn("__f", times.frame_of(F.col("timestamp"), fps))
    end1 = t.where("period_id = 1").groupBy(match).agg((F.max("__f") + 1).alias("__e"))
    start = events.groupBy(match, "period_id").agg(F.min("utc_timestamp").alias("__s"))
    t = t.join(F.broadcast(end1), match, "left").join(F.broadcast(start), [match, "period_id"], "left")  # one row a period
    us = F.rint(F.col("timestamp") * 1e6).cast("long")
    return t.withColumn("frame_id", F.col("__f") + F.when(F.col("period_id") == 2, F.coalesce("__e", F.lit(0))).otherwise(0)).withColumn("utc_timestamp", times.shift(F.col("__s"), us)).drop("__f", "__e", "__s")

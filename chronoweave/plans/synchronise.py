"""The full synchroniser over any number of matches.

Windows, as-of joins, features, opponents and receivers are relational and parallel over
all events; only the forward-only choice of frames is a fold, over candidate arrays.
Inputs follow the contracts EVENTS and TRACKING.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import vocab
from ..deploy import ship
from ..functions import times
from ..functions.scoring import distance
from ..operators import temporal as tmp
from ..storage import kept
from .detectors import best_frame, kind_of

KEYS = ["match_id", "period_id"]
FEATURES = ["frame", "player_dist", "ball_height", "ball_accel", "player_speed", "player_accel", "frame_delay", "oppo_dist", "oppo_rel_x", "oppo_rel_y"]
#: features travel as one array each, so a fold gets NumPy arrays and no row objects
PACKED = [*FEATURES, "oppo_id"]
PASSES = [*vocab.PASS_LIKE_OPEN, *vocab.SET_PIECE]


def frame_dimension(tracking: DataFrame, gap: int = vocab.EPISODE_GAP) -> DataFrame:
    f = tracking.select(*KEYS, "frame_id", "utc_timestamp").distinct().withColumn("us", times.micros(F.col("utc_timestamp"))).drop("utc_timestamp")
    return tmp.episodes(f, ["match_id"], "frame_id", gap, period="period_id")


def with_neighbours(events: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEYS).orderBy("event_idx")
    m = Window.partitionBy("match_id").orderBy("event_idx")
    e = events.withColumn("us", times.micros(F.col("utc_timestamp")))
    return e.withColumns({"next_player_id": F.lead("player_id").over(w), "next_type": F.lead("spadl_type").over(w), "prev_player_id": F.lag("player_id").over(m), "prev_type": F.lag("spadl_type").over(m)})


def kickoffs(events: DataFrame, tracking: DataFrame, frames: DataFrame, fps: int = 25) -> DataFrame:
    """match_id, period_id, event_idx, kick_frame, offset, ok: the frame of each period's first event, the clock offset and whether it was found (else the first frame and 0)."""
    x0, y0 = vocab.PITCH_X / 2, vocab.PITCH_Y / 2
    first = tmp.top1(events, KEYS, "event_idx").select(*KEYS, "event_idx", "player_id", "us", "spadl_type")
    start = frames.groupBy(*KEYS).agg(F.min("frame_id").alias("f0"))
    one = tmp.merge_join(start, first.select(*KEYS, F.col("player_id").alias("kicker")), KEYS)
    t = tracking.join(F.broadcast(one), KEYS).where(F.col("frame_id") < F.col("f0") + vocab.WINDOW_S["kickoff"] * fps)  # one row a period
    centre = F.col("ball") & F.col("x").between(x0 - 3, x0 + 3) & F.col("y").between(y0 - 3, y0 + 3)
    kicks = ~F.col("ball") & (F.col("player_id") == F.col("kicker"))
    # ball and kicker of a frame meet in an aggregate, which leaves the rows of a match where they are
    both = t.where(centre | kicks).groupBy(*KEYS, "frame_id").agg(F.max(F.when(F.col("ball"), F.struct("x", "y", "accel_v"))).alias("b"), F.max(F.when(~F.col("ball"), F.struct("x", "y"))).alias("p"))
    near = tmp.first_run(both.where("b is not null"), KEYS).where("p is not null").select(*KEYS, "frame_id", "b.accel_v", distance(F.col("p.x"), F.col("p.y"), F.col("b.x"), F.col("b.y")).alias("d"))
    close = F.col("d") < 2
    pick = tmp.top1(near, KEYS, F.desc(close), F.desc(F.when(close, F.coalesce("accel_v", F.lit(0.0)))), "d", "frame_id").select(*KEYS, F.col("frame_id").alias("found"))
    at_start = t.where((F.col("frame_id") == F.col("f0")) & ~F.col("ball") & F.col("x").between(x0 - 5, x0 + 5) & F.col("y").between(y0 - 5, y0 + 5))
    crowd = at_start.where(F.left("player_id", F.lit(4)) == F.left("kicker", F.lit(4))).groupBy(*KEYS).agg(F.count("*").alias("crowd"))
    k = tmp.merge_join(tmp.merge_join(tmp.merge_join(first, start, KEYS), pick, KEYS, "left"), crowd, KEYS, "left")
    ok = F.col("found").isNotNull() & (F.coalesce("crowd", F.lit(0)) <= 1) & (F.col("spadl_type") == "pass")
    k = k.select(*KEYS, "event_idx", "us", F.when(ok, F.col("found")).otherwise(F.col("f0")).alias("kick_frame"), ok.alias("ok"))
    at = tmp.wanted(frames, k, ["match_id"], event_at="kick_frame").select(*KEYS, F.col("frame_id").alias("kick_frame"), F.col("us").alias("fus"))
    k = tmp.merge_join(k, at, [*KEYS, "kick_frame"])
    return k.select(*KEYS, "event_idx", "kick_frame", F.when(F.col("ok"), F.col("us") - F.col("fus")).otherwise(F.lit(0).cast("long")).alias("offset"), "ok")


def window_bounds(events: DataFrame, frames: DataFrame, fps: int = 25) -> DataFrame:
    """events with event_frame, lo and hi: the frames that may hold each event, by its type."""
    secs = F.create_map(*[x for t in vocab.TYPES for x in (F.lit(t), F.lit(kind_of(t)[0]))])[F.col("spadl_type")]
    w = Window.partitionBy("match_id").orderBy("event_idx")
    foul, piece = F.col("spadl_type") == "foul", F.col("spadl_type").isin(vocab.SET_PIECE)
    e = events.withColumn("s", secs).withColumn("probe", F.when(foul, F.lag("us").over(w)).otherwise(F.col("us")))
    e = tmp.nearest(e.where("probe is not null"), frames.select("match_id", "us", "frame_id", "episode_id"), ["match_id"], "probe", "us", carry={"episode_id": "episode_id", "us": "ef_us"})
    up, down = Window.partitionBy("match_id", "episode_id").orderBy("frame_id"), Window.partitionBy("match_id", "episode_id").orderBy(F.desc("frame_id"))
    ranked = frames.withColumn("i", F.row_number().over(up)).withColumn("j", F.row_number().over(down))
    ep = ranked.groupBy("match_id", "episode_id").agg(
        F.min("frame_id").alias("ep_first"), F.max("frame_id").alias("ep_last"), F.max(F.when(F.col("i") <= fps, F.col("frame_id"))).alias("ep_head"), F.min(F.when(F.col("j") <= fps, F.col("frame_id"))).alias("ep_tail")
    )
    e = tmp.merge_join(e, ep, ["match_id", "episode_id"], "left")
    far = F.abs(F.col("ef_us") - F.col("probe")) > F.col("s") * 1_000_000
    reach = F.col("s") * fps - 1
    early = F.col("event_frame") - F.col("ep_first") < F.col("s") * fps
    none = F.lit(None).cast("long")
    lo = F.when(foul, F.when(far, none).otherwise(F.col("ep_tail"))).when(piece, F.when(far, none).when(early, F.col("ep_first")).when(F.col("spadl_type") == "throw_in", F.col("event_frame") - reach)).when(F.col("s") > 0, F.col("event_frame") - reach)
    hi = F.when(foul, F.when(far, none).otherwise(F.col("ep_last"))).when(piece, F.when(far, none).when(early, F.col("ep_head")).when(F.col("spadl_type") == "throw_in", F.col("event_frame") + reach)).when(F.col("s") > 0, F.col("event_frame") + reach)
    return e.withColumn("lo", lo).withColumn("hi", hi).withColumn("event_frame", F.when(foul, F.col("ep_last")).otherwise(F.col("event_frame"))).drop("episode_id", "ef_us", "ep_first", "ep_last", "ep_head", "ep_tail", "probe")


def wide_frames(tracking: DataFrame, names: list[str], ball: dict) -> DataFrame:
    """One row a frame (and ball): match_id, period_id, frame, the ball's columns, and its ``players``, an array of player_id and ``names``."""
    row = F.when(F.col("ball"), F.struct(*[v.alias(k) for k, v in ball.items()]))
    t = tracking.groupBy("match_id", "period_id", F.col("frame_id").alias("frame")).agg(F.collect_list(row).alias("balls"), F.collect_list(F.when(~F.col("ball"), F.struct("player_id", *names))).alias("players"))
    return t.select("match_id", "period_id", "frame", "players", F.inline("balls"))


def window_rows(events: DataFrame, tracking: DataFrame, fps: int = 25) -> DataFrame:
    """match_id, event_idx and one array for each feature (``f_`` columns), in frame order, of the events whose window holds frames of their player.

    Objects of a frame are one row; events meet them by a bucketed range join by match, and all that
    follows stays there: nothing is moved by event or frame, as these rows are many times the tracking's.
    """
    w = wide_frames(tracking, ["x", "y", "speed", "accel_v"], {"bx": F.col("x"), "by": F.col("y"), "ball_height": F.coalesce("z", F.lit(0.0)), "ball_accel": F.coalesce("accel_v", F.lit(0.0))})
    team = F.left("player_id", F.lit(4))
    named = F.when((F.col("spadl_type") == "tackle") & (F.left("prev_player_id", F.lit(4)) != team), F.col("prev_player_id")).when(
        (F.col("spadl_type") == "take_on") & ~F.col("success") & (F.col("next_type") == "tackle") & (F.left("next_player_id", F.lit(4)) != team), F.col("next_player_id")
    )
    e = events.where("lo is not null").select("match_id", "period_id", "event_idx", "player_id", "event_frame", "lo", "hi", team.alias("team"), named.alias("named"), F.col("spadl_type").isin("tackle", "take_on", "second_take_on").alias("duel"), (F.col("spadl_type") == "tackle").alias("tackle"))
    e = e.withColumn("duel", F.col("duel") & (F.col("named").isNotNull() | ~F.col("tackle"))).drop("tackle")
    j = tmp.in_ranges(w.withColumnRenamed("period_id", "p_id"), e, ["match_id"], "lo", "hi", "frame", 10 * fps, "e").where("e.period_id = p_id")
    own = j.withColumn("own", F.explode(F.filter("players", lambda p: p["player_id"] == F.col("e.player_id"))))
    gx = F.when(F.col("e.team") == "home", F.lit(vocab.PITCH_X)).otherwise(F.lit(0.0))
    goal = lambda o: distance(o["x"], o["y"], gx, F.lit(vocab.PITCH_Y / 2))
    masked = lambda o: F.when(F.col("e.named").isNotNull() | (goal(o) <= goal(F.col("own")) + 1), distance(F.col("own.x"), F.col("own.y"), o["x"], o["y"])).otherwise(vocab.PITCH_X)
    others = F.filter("players", lambda o: (F.left(o["player_id"], F.lit(4)) != F.col("e.team")) & (F.col("e.named").isNull() | (o["player_id"] == F.col("e.named"))))
    nearest = F.array_min(F.transform(others, lambda o: F.struct(masked(o).alias("d"), o["player_id"].alias("id"), o["x"].alias("x"), o["y"].alias("y"))))
    full = own.withColumn("o", F.when(F.col("e.duel"), nearest))
    row = F.struct(
        F.col("frame").cast("double").alias("frame"), distance(F.col("own.x"), F.col("own.y"), F.col("bx"), F.col("by")).alias("player_dist"), "ball_height", "ball_accel", F.coalesce("own.speed", F.lit(0.0)).alias("player_speed"),
        F.coalesce("own.accel_v", F.lit(0.0)).alias("player_accel"), F.greatest(F.lit(0), F.col("frame") - F.col("e.event_frame")).cast("double").alias("frame_delay"),
        distance(F.col("o.x"), F.col("o.y"), F.col("bx"), F.col("by")).alias("oppo_dist"), (F.col("o.x") - F.col("own.x")).alias("oppo_rel_x"), (F.col("o.y") - F.col("own.y")).alias("oppo_rel_y"), F.col("o.id").alias("oppo_id"),
    )
    rows = full.groupBy("match_id", F.col("e.event_idx").alias("event_idx")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select("match_id", "event_idx", *[F.col(f"rows.{c}").alias(f"f_{c}") for c in PACKED])


def features(events: DataFrame, tracking: DataFrame, fps: int = 25) -> DataFrame:
    """All events, each with the arrays of ``window_rows``."""
    return tmp.merge_join(events, window_rows(events, tracking, fps), ["match_id", "event_idx"], "left")


def _arrays(row, lo: float, hi: float) -> dict:
    """The packed features of one event between two frames; null values are NaN."""
    frame = getattr(row, "f_frame")
    if frame is None:
        return {k: np.zeros(0) for k in PACKED}
    frame = np.asarray(frame, float)
    s = slice(int(np.searchsorted(frame, lo)), int(np.searchsorted(frame, hi, "right")))
    f = {k: np.asarray(getattr(row, f"f_{k}"), float)[s] for k in FEATURES}
    f["oppo_id"] = np.asarray(row.f_oppo_id, object)[s]
    return f


def with_rows(events: DataFrame, rows: DataFrame, fold, schema: str) -> DataFrame:
    """``fold`` of each match's events, with the arrays of ``window_rows``, which stay where they are."""

    def run(own: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return own[["match_id", "event_idx"]].assign(frame_id=pd.array([], dtype="Int64"))
        at = dict(zip(arrays["event_idx"], range(len(arrays)), strict=True))
        place = [at.get(i) for i in own["event_idx"]]
        packed = {c: arrays[c].tolist() for c in arrays.columns if c.startswith("f_")}
        return fold(own.assign(**{c: pd.Series([None if i is None else v[i] for i in place], index=own.index, dtype=object) for c, v in packed.items()}))

    return events.groupBy("match_id").cogroup(rows.groupBy("match_id")).applyInPandas(run, schema)


def major_fold(events: DataFrame, rows: DataFrame, kick: DataFrame, fps: int, compat: bool) -> DataFrame:
    """frame_id of kickoffs and major events; each window begins at the last match of its period."""
    e = events.join(kick.select(*KEYS, F.col("event_idx").alias("kick_idx"), "kick_frame"), KEYS)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["period_id", "event_idx"])
        at, out, period = None, [], None
        for r in pdf.itertuples(index=False):
            if r.period_id != period:
                at, period = int(r.kick_frame), r.period_id
            best = int(r.kick_frame) if r.event_idx == r.kick_idx else None
            if best is None and r.major:
                best = best_frame(kind_of(r.spadl_type)[1], _arrays(r, at, np.inf), fps, compat)
                at = at if best is None else best
            out.append(best)
        return pd.DataFrame({"match_id": pdf["match_id"], "event_idx": pdf["event_idx"], "frame_id": pd.array(out, dtype="Int64")})

    return with_rows(e.select(*KEYS, "event_idx", "spadl_type", "major", "kick_idx", "kick_frame"), rows, fold, "match_id string, event_idx long, frame_id long")


RECEIVE = ["frame", "next_player_dist", "closest_dist", "ball_height", "ball_accel"]


def receive_cases(events: DataFrame, frames: DataFrame, fps: int = 25, seconds: int = 10) -> DataFrame:
    """Synced passes with max_frame, ep_last, next_frame and case: 1 no next event, 2 out, 3 goal, 4 taken by the next event, 5 no frame left, 0 to be searched."""
    w = Window.partitionBy("match_id").orderBy("event_idx").rowsBetween(1, Window.unboundedFollowing)
    ep = Window.partitionBy("match_id", "episode_id")
    dim = frames.withColumn("ep_last", F.max("frame_id").over(ep)).select("match_id", "frame_id", "episode_id", "ep_last")
    e = events.withColumn("next_frame", F.min("frame_id").over(w)).where(F.col("spadl_type").isin(PASSES) & F.col("frame_id").isNotNull())
    after = tmp.wanted(dim, e, ["match_id"], event_at="next_frame").select("match_id", F.col("frame_id").alias("next_frame"), F.col("episode_id").alias("next_ep"))
    e = tmp.merge_join(e, tmp.wanted(dim, e, ["match_id"]), ["match_id", "frame_id"])
    e = tmp.merge_join(e, after, ["match_id", "next_frame"], "left")
    e = e.withColumn("max_frame", F.least(F.col("frame_id") + fps * seconds, "ep_last", "next_frame"))
    shot = F.col("spadl_type").isin("shot", "shot_freekick", "shot_penalty")
    same = (F.col("next_ep") == F.col("episode_id")) & F.col("next_type").isin([*vocab.INCOMING, "shot_block", "keeper_punch"])
    case = F.when(F.col("next_type").isNull(), 1).when(F.col("next_type").isin(vocab.SET_PIECE_OOP), 2).when(shot & F.col("success"), 3).when(same, 4).when(F.col("frame_id") == F.col("max_frame"), 5).otherwise(0)
    e = e.withColumn("case", case).select("match_id", "period_id", "event_idx", "spadl_type", "success", "player_id", "next_player_id", "next_type", "next_frame", "frame_id", "max_frame", "ep_last", "case")
    return e


def quick_receives(cases: DataFrame) -> DataFrame:
    """match_id, event_idx, receiver_id, receive_frame_id of the passes whose case decides."""
    return cases.where("case > 0").select(
        "match_id", "event_idx", F.when(F.col("case") == 2, F.lit("out")).when(F.col("case") == 3, F.lit("goal")).when(F.col("case") > 3, F.col("next_player_id")).alias("receiver_id"),
        F.when(F.col("case") <= 3, F.col("ep_last")).when(F.col("case") == 4, F.col("next_frame")).otherwise(F.col("max_frame")).alias("receive_frame_id"),
    )


def receive_features(cases: DataFrame, tracking: DataFrame, fps: int = 25) -> DataFrame:
    """match_id, event_idx and one array for each of ``RECEIVE``, and closest_id, of the passes to be searched."""
    w = wide_frames(tracking, ["x", "y"], {"bx": F.col("x"), "by": F.col("y"), "ball_height": F.coalesce("z", F.lit(0.0)), "ball_accel": F.coalesce("accel_v", F.lit(0.0))})
    passing = F.col("spadl_type").isin("pass", "cross", "freekick_crossed", "freekick_short", *vocab.SET_PIECE_OOP)
    only = (F.col("spadl_type") == "clearance") | (F.col("next_type") == "shot_block")
    e = cases.where("case = 0").select("match_id", "period_id", "event_idx", "player_id", "next_player_id", "success", F.col("frame_id").alias("lo"), F.col("max_frame").alias("hi"), passing.alias("passing"), only.alias("only"))
    s = tmp.in_ranges(w.withColumnRenamed("period_id", "p_id"), e, ["match_id"], "lo", "hi", "frame", 10 * fps, "e").where("e.period_id = p_id")
    s = s.withColumn("near", F.transform("players", lambda p: F.struct(distance(p["x"], p["y"], F.col("bx"), F.col("by")).alias("dist"), F.when(p["player_id"].startswith("home"), 0).otherwise(1).alias("away"), p["player_id"].alias("obj"))))

    def cand(p):
        mate = F.left(p["obj"], F.lit(4)) == F.left("e.player_id", F.lit(4))
        okay = F.when(F.col("e.passing"), F.when(F.col("e.success"), mate & (p["obj"] != F.col("e.player_id"))).otherwise(~mate)).otherwise(F.lit(True))
        return F.when(F.col("e.only"), p["obj"] == F.col("e.next_player_id")).otherwise(okay)

    nxt = F.transform(F.filter("near", lambda p: p["obj"] == F.col("e.next_player_id")), lambda p: F.when(F.col("e.next_player_id") == F.col("e.player_id"), 0.0).otherwise(p["dist"]))
    s = s.withColumn("can", F.filter("near", cand))
    per = s.select("match_id", F.col("e.event_idx").alias("event_idx"), "frame", F.array_min(nxt).alias("next_player_dist"), F.array_min(F.col("can.dist")).alias("closest_dist"), F.array_min("can")["obj"].alias("closest_id"), "ball_height", "ball_accel")
    per = per.where("next_player_dist is not null and closest_dist is not null")
    arr = per.groupBy("match_id", "event_idx").agg(F.array_sort(F.collect_list(F.struct(*RECEIVE, "closest_id"))).alias("rows"))
    return arr.select("match_id", "event_idx", *[F.col(f"rows.{c}").cast("array<double>").alias(c) for c in RECEIVE], F.col("rows.closest_id").alias("closest_id"))


def receives(events: DataFrame, tracking: DataFrame, frames: DataFrame, fps: int = 25, seconds: int = 10) -> DataFrame:
    """match_id, event_idx, receiver_id, receive_frame_id of each synced pass; passes are independent of each other."""
    ship(events.sparkSession)
    cases = receive_cases(events, frames, fps, seconds)
    arr = receive_features(cases, tracking, fps)

    def pick(batches):
        for pdf in batches:
            who, when = [], []
            for r in pdf.itertuples(index=False):
                f = {k: np.asarray(getattr(r, k), float) for k in RECEIVE}
                best = best_frame("receive", f, fps)
                when.append(best)
                who.append(None if best is None else r.closest_id[int(np.searchsorted(f["frame"], best))])
            yield pd.DataFrame({"match_id": pdf["match_id"], "event_idx": pdf["event_idx"], "receiver_id": who, "receive_frame_id": pd.array(when, dtype="Int64")})

    found = arr.mapInPandas(pick, "match_id string, event_idx long, receiver_id string, receive_frame_id long")
    return quick_receives(cases).unionByName(found)


def minor_fold(events: DataFrame, fps: int, post: list[str], compat: bool, rows: DataFrame | None = None) -> DataFrame:
    """Frames of the minor events, between the matches around them; rows: of ``window_rows``, if events do not hold the arrays."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_idx").reset_index(drop=True)
        n = len(pdf)
        minor = pdf["spadl_type"].isin(post).to_numpy()
        frame = pdf["frame_id"].astype("Float64").to_numpy(float, na_value=np.nan)
        got = pdf["receive_frame_id"].astype("Float64").to_numpy(float, na_value=np.nan)
        frame[minor] = np.nan
        types, players = pdf["spadl_type"].tolist(), pdf["player_id"].tolist()
        period, held = pdf["period_id"].tolist(), list(pdf.itertuples(index=False))
        last = float(pdf["last_frame"].iloc[0])
        for i in np.flatnonzero(minor):
            kind = types[i]
            if kind == "bad_touch" and i and players[i] == pdf["receiver_id"][i - 1] and not np.isnan(got[i - 1]):
                frame[i] = got[i - 1]
                continue
            if kind == "dispossessed" and i + 1 < n and types[i + 1] == "tackle" and period[i + 1] == period[i]:
                if "tackle" in post:
                    continue
                if not np.isnan(frame[i + 1]):
                    frame[i] = frame[i + 1]
                    continue
            if kind == "foul" and i and types[i - 1] == "foul" and not np.isnan(frame[i - 1]):
                frame[i] = frame[i - 1]
                continue
            second = kind == "take_on" and i > 0 and types[i - 1] == "take_on"
            before = np.concatenate([frame[:i], got[:i] - fps // 5, [0.0]])
            after = np.concatenate([frame[i:], [np.nan]])
            lo, hi = np.nanmax(before), np.inf if np.isnan(after).all() else min(np.nanmin(after), last)
            best = best_frame("second_take_on" if second else kind_of(kind)[1], _arrays(held[i], lo, hi), fps, compat)
            if best is not None:
                frame[i] = best
                if kind == "tackle" and i and types[i - 1] == "dispossessed":
                    frame[i - 1] = best
        return pd.DataFrame({"match_id": pdf["match_id"], "event_idx": pdf["event_idx"], "frame_id": pd.array([None if np.isnan(x) else int(x) for x in frame], dtype="Int64")})

    schema = "match_id string, event_idx long, frame_id long"
    return events.groupBy("match_id").applyInPandas(fold, schema) if rows is None else with_rows(events, rows, fold, schema)


def synchronise(events: DataFrame, tracking: DataFrame, fps: int = 25, post_sync_types: list[str] | None = None, compat: bool = False) -> DataFrame:
    """Events with frame_id, synced_ts, next_player_id, next_type, receiver_id, receive_frame_id, receive_ts.

    ``post_sync_types`` (minor types by default) are matched after the receives.
    """
    ship(events.sparkSession)
    post = list(vocab.MINOR if post_sync_types is None else post_sync_types)
    # small intermediates that several steps read are computed once and kept in shared storage; frames and the
    # arrays of windows are many times the events, so they are computed where they are used, by match, and not kept
    frames = frame_dimension(tracking)
    e = with_neighbours(events)
    kick = kept(kickoffs(e, tracking, frames, fps))
    e = kept(e.join(F.broadcast(kick.select(*KEYS, "offset")), KEYS, "left").withColumn("us", F.col("us") - F.coalesce("offset", F.lit(0))).drop("offset"))  # one row a period
    bounds = window_bounds(e, frames, fps).select("match_id", "event_idx", "event_frame", "lo", "hi")
    b = kept(e.join(bounds, ["match_id", "event_idx"], "left").withColumn("major", ~F.col("spadl_type").isin(post)))
    major = kept(major_fold(b, window_rows(b.where("major"), tracking, fps), kick, fps, compat))
    rec = kept(receives(e.join(major, ["match_id", "event_idx"], "left"), tracking, frames, fps))
    last = frames.groupBy("match_id").agg(F.max("frame_id").alias("last_frame"))
    m = b.select("match_id", "period_id", "event_idx", "spadl_type", "player_id")
    m = m.join(major, ["match_id", "event_idx"], "left").join(rec, ["match_id", "event_idx"], "left").join(last, "match_id")
    final = kept(minor_fold(m, fps, post, compat, window_rows(b.where("not major"), tracking, fps)))
    clock = tracking.select("match_id", "frame_id", "timestamp")
    out = e.drop("us", "prev_player_id", "prev_type").join(final, ["match_id", "event_idx"], "left").join(rec, ["match_id", "event_idx"], "left")
    synced, received = (tmp.wanted(clock, d, ["match_id"], event_at=c).distinct() for d, c in ((final, "frame_id"), (rec, "receive_frame_id")))
    out = tmp.merge_join(out, synced.withColumnRenamed("timestamp", "__a"), ["match_id", "frame_id"], "left")
    out = tmp.merge_join(out, received.withColumnsRenamed({"timestamp": "__b", "frame_id": "receive_frame_id"}), ["match_id", "receive_frame_id"], "left")
    return out.withColumn("synced_ts", times.format_clock(F.col("__a"))).withColumn("receive_ts", times.format_clock(F.col("__b"))).drop("__a", "__b")


# fixed values: types, window seconds and gates (distance, height, least and largest acceleration) of the located baseline
GATES = [([*vocab.PASS_LIKE_OPEN], 10, 2.5, 3.0, -1.0, None), (vocab.SET_PIECE, 15, 2.5, 3.0, -1.0, None), (vocab.INCOMING, 10, 2.0, 3.0, None, 1.0), (["bad_touch"], 5, 3.0, 3.0, None, None), (["foul", "tackle"], 5, 3.0, 4.0, None, None)]


def located_features(events: DataFrame, tracking: DataFrame, frames: DataFrame, fps: int = 25, seconds: int | None = None, gate: int | None = None) -> DataFrame:
    """Rows of events by frame with the three distances, candidate (whether the type's gates hold) and score; ``seconds`` and ``gate`` fix a window and a row of ``GATES``."""
    from ..functions.scoring import score

    t = F.col("spadl_type")

    def case(i):
        c = None
        for g in GATES:
            v = F.lit((g if gate is None else GATES[gate])[i]).cast("double")
            c = F.when(t.isin(g[0]), v) if c is None else c.when(t.isin(g[0]), v)
        return c if gate is None else F.lit(GATES[gate][i]).cast("double")

    e = tmp.nearest(events.withColumn("s", case(1) if seconds is None else F.lit(float(seconds))).where("s is not null"), frames.select("match_id", "us", "frame_id"), ["match_id"], "us", "us")
    e = e.withColumn("lo", (F.col("event_frame") - F.col("s") * fps + 1).cast("long")).withColumn("hi", (F.col("event_frame") + F.col("s") * fps - 1).cast("long"))
    e = e.withColumns({"g_d": case(2), "g_h": case(3), "g_lo": case(4), "g_hi": case(5)})
    p = tracking.where(~F.col("ball")).select(*KEYS, "player_id", F.col("frame_id").alias("frame"), F.col("x").alias("px"), F.col("y").alias("py"))
    b = tracking.where("ball").select(*KEYS, F.col("frame_id").alias("frame"), F.col("x").alias("bx"), F.col("y").alias("by"), F.coalesce("z", F.lit(0.0)).alias("ball_height"), F.coalesce("accel_s", F.lit(0.0)).alias("ball_accel_s"))
    j = tmp.merge_join(tmp.range_join(e, p, [*KEYS, "player_id"], "lo", "hi", "frame", 10 * fps), b, [*KEYS, "frame"])
    j = j.withColumn("player_ball_dist", distance(F.col("px"), F.col("py"), F.col("bx"), F.col("by")))
    j = j.withColumn("player_event_dist", distance(F.col("px"), F.col("py"), F.col("start_x"), F.col("start_y"))).withColumn("ball_event_dist", distance(F.col("bx"), F.col("by"), F.col("start_x"), F.col("start_y")))
    j = j.withColumn("candidate", F.expr("player_ball_dist <= g_d and ball_height <= g_h and (g_lo is null or ball_accel_s >= g_lo) and (g_hi is null or ball_accel_s <= g_hi)"))
    return j.withColumn("score", score("located")).select(*KEYS, "event_idx", "us", "frame", "ball_accel_s", "ball_height", "player_ball_dist", "player_event_dist", "ball_event_dist", "candidate", "score")


def located_offsets(events: DataFrame, tracking: DataFrame, frames: DataFrame, kick: DataFrame, fps: int = 25) -> DataFrame:
    """match_id, period_id, offset: of the kickoff, or, where none is found, of the period's second event by its best frame within five seconds; 0 without one."""
    w = Window.partitionBy(*KEYS).orderBy("event_idx")
    second = events.withColumn("__k", F.row_number().over(w)).where("__k = 2").drop("__k").join(kick.where(~F.col("ok")).select(*KEYS), KEYS, "left_semi")
    best = tmp.top1(located_features(second, tracking, frames, fps, vocab.WINDOW_S["kickoff"], 0).where("candidate"), KEYS, F.desc("score"), "frame")
    at = tmp.merge_join(best.select(*KEYS, "us", F.col("frame").alias("frame_id")), frames.select(*KEYS, "frame_id", F.col("us").alias("fus")), [*KEYS, "frame_id"])
    return kick.select(*KEYS, "offset").join(at.select(*KEYS, (F.col("us") - F.col("fus")).alias("__o")), KEYS, "left").select(*KEYS, F.coalesce("__o", "offset").alias("offset"))


def located(events: DataFrame, tracking: DataFrame, fps: int = 25) -> DataFrame:
    """The baseline that uses annotated positions: match_id, event_idx, frame_id.

    Gates by type, a score of three distances, and the forward-only fold.
    """
    from .fold import forward_only

    ship(events.sparkSession)
    frames = kept(frame_dimension(tracking))
    e = with_neighbours(events)
    kick = kept(kickoffs(e, tracking, frames, fps))
    off = located_offsets(e, tracking, frames, kick, fps)
    e = e.join(F.broadcast(off), KEYS, "left").withColumn("us", F.col("us") - F.coalesce("offset", F.lit(0)))  # one row a period
    j = located_features(e, tracking, frames, fps).where("candidate")
    c = j.groupBy("match_id", "period_id", "event_idx").agg(F.array_sort(F.collect_list(F.struct(F.col("frame").alias("frame_id"), F.col("score").alias("fvalue")))).alias("cands"))
    c = c.withColumn("key", F.concat_ws("|", "match_id", "period_id"))
    first = kick.select(F.concat_ws("|", *KEYS).alias("key"), "event_idx", F.array(F.struct(F.col("kick_frame").alias("frame_id"), F.lit(0.0).alias("fvalue"))).alias("cands"))
    c = c.select("key", "event_idx", "cands").join(first.select("key", "event_idx"), ["key", "event_idx"], "left_anti").unionByName(first)
    got = forward_only(c, "key", ["event_idx"], "event_idx")
    return got.select(F.split_part("key", F.lit("|"), F.lit(1)).alias("match_id"), "event_idx", "frame_id")

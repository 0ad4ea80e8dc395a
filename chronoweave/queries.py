"""Registered queries on the driver's tables, and their DuckDB equivalents.

Roles: a match is a ``user_id``; view, click and error rows are tracking frames, numbered
in time; purchase and signup rows are annotated events; ``value`` is the signal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .contracts import Contract, validate
from .functions import scoring, times
from .operators import relational as rel
from .operators import signal as sig
from .operators import temporal as tmp

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
HOUR = 3_600_000_000
FRAMES_SQL = """fr as (select user_id, event_id, epoch_us(ts) as us, value, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_id from events where event_type in ('view', 'click', 'error')),
an as (select user_id, event_id, epoch_us(ts) as us, value from events where event_type in ('purchase', 'signup')),
ne as (select a.user_id, a.event_id, arg_min(f.frame_id, (abs(f.us - a.us), f.frame_id)) as event_frame, min(abs(f.us - a.us)) as gap from an a join fr f using (user_id) group by all)"""


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle.replace("{F}", "with " + FRAMES_SQL)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, d):
    return table(spark, d, "events").withColumn("us", times.micros(F.col("ts")))


def frames(spark, d) -> DataFrame:
    f = events(spark, d).where(F.col("event_type").isin("view", "click", "error"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return f.select("user_id", "event_id", "us", "value", n.cast("long").alias("frame_id"))


def annotated(spark, d) -> DataFrame:
    return events(spark, d).where(F.col("event_type").isin("purchase", "signup")).select("user_id", "event_id", "us", "value")


def matched(spark, d, tolerance=None) -> DataFrame:
    return tmp.nearest(annotated(spark, d), frames(spark, d).select("user_id", "us", "frame_id"), ["user_id"], "us", "us", tolerance=tolerance)


@query("""{F}, ep as (select *, sum(case when g is null or g >= 21600000000 then 1 else 0 end) over (partition by user_id order by frame_id) as episode_id
  from (select *, us - lag(us) over (partition by user_id order by frame_id) as g from fr)),
c as (select n.user_id, n.event_id, e.frame_id, e.episode_id,
  50 * greatest(0, least(1, 1 - abs(e.us - a.us) / 86400000000.0)) + 50 * greatest(0, least(1, 1 - abs(e.value - a.value) / 100.0)) as score
  from ne n join an a using (user_id, event_id) join ep e on e.user_id = n.user_id and e.frame_id between n.event_frame - 5 and n.event_frame + 5)
select user_id, event_id, frame_id, episode_id::bigint as episode_id, round(score, 6) as score from c qualify row_number() over (partition by event_id order by round(score, 9) desc, frame_id) = 1""")
def flagship_sync(spark: SparkSession, d: str) -> DataFrame:
    """Episodes, nearest frame, range join, clamped scores, best frame: the synchroniser without its fold."""
    fr = tmp.episodes(frames(spark, d).withColumn("t", F.col("us")), ["user_id"], frame="us", gap=6 * HOUR).select("user_id", "frame_id", F.col("us").alias("fus"), F.col("value").alias("fvalue"), "episode_id")
    ev = matched(spark, d).withColumn("lo", F.col("event_frame") - 5).withColumn("hi", F.col("event_frame") + 5)
    c = tmp.range_join(ev, fr, ["user_id"], "lo", "hi", "frame_id", width=8)
    delay = scoring.clamp_linear(F.abs(F.col("fus") - F.col("us")).cast("double"), 0, 24 * HOUR)
    dist = scoring.clamp_linear(F.abs(F.col("fvalue") - F.col("value")), 0, 100)
    best = tmp.top1(c.withColumn("score", 50 * delay + 50 * dist), ["event_id"], F.desc(F.round("score", 9)), "frame_id")
    return best.select("user_id", "event_id", "frame_id", F.col("episode_id").cast("long").alias("episode_id"), F.round("score", 6).alias("score"))


@query("""{F} select user_id, frame_id, (sum(case when g is null or g >= 21600000000 then 1 else 0 end) over (partition by user_id order by frame_id))::bigint as episode_id
from (select *, us - lag(us) over (partition by user_id order by frame_id) as g from fr)""")
def episodes_gap(spark, d):
    return tmp.episodes(frames(spark, d), ["user_id"], frame="us", gap=6 * HOUR).select("user_id", "frame_id", "episode_id")


@query("{F} select user_id, event_id, event_frame from ne")
def asof_nearest(spark, d):
    return matched(spark, d).select("user_id", "event_id", "event_frame")


@query("{F} select user_id, event_id, case when gap <= 3600000000 then event_frame end as event_frame from ne")
def asof_nearest_tol(spark, d):
    return matched(spark, d, tolerance=HOUR).select("user_id", "event_id", "event_frame")


@query("{F} select n.user_id, n.event_id, f.frame_id, f.value from ne n join fr f on f.user_id = n.user_id and f.frame_id between n.event_frame - 4 and n.event_frame + 4")
def window_range_join(spark, d):
    ev = matched(spark, d).select("user_id", "event_id", (F.col("event_frame") - 4).alias("lo"), (F.col("event_frame") + 4).alias("hi"))
    return tmp.range_join(ev, frames(spark, d).select("user_id", "frame_id", "value"), ["user_id"], "lo", "hi", "frame_id", width=8).select("user_id", "event_id", "frame_id", "value")


_EP = """{F}, ep as (select *, sum(case when g is null or g >= 21600000000 then 1 else 0 end) over (partition by user_id order by frame_id) as episode_id
  from (select *, us - lag(us) over (partition by user_id order by frame_id) as g from fr))"""


@query(_EP + " select user_id, episode_id::bigint as episode_id, frame_id from ep qualify row_number() over (partition by user_id, episode_id order by frame_id) <= 3")
def episode_head(spark, d):
    e = tmp.episodes(frames(spark, d), ["user_id"], frame="us", gap=6 * HOUR)
    return tmp.ends(e, ["user_id", "episode_id"], 3).select("user_id", "episode_id", "frame_id")


@query(_EP + " select user_id, episode_id::bigint as episode_id, frame_id from ep qualify row_number() over (partition by user_id, episode_id order by frame_id desc) <= 3")
def episode_tail(spark, d):
    e = tmp.episodes(frames(spark, d), ["user_id"], frame="us", gap=6 * HOUR)
    return tmp.ends(e, ["user_id", "episode_id"], 3, tail=True).select("user_id", "episode_id", "frame_id")


@query("""with h as (select distinct user_id, epoch_us(ts) // 3600000000 as frame_id from events), s as (select *, case when frame_id - lag(frame_id) over (partition by user_id order by frame_id) > 24 then 1 else 0 end as g from h)
select user_id, frame_id from (select *, sum(g) over (partition by user_id order by frame_id) as r from s) where r < 1""")
def first_contiguous_run(spark, d):
    days = events(spark, d).select("user_id", F.expr("us div 3600000000").alias("hour")).distinct()
    w = Window.partitionBy("user_id").orderBy("hour")
    # positions that leave one out wherever the gap is over a day
    p = F.when(F.col("hour") - F.lag("hour").over(w) > 24, 2).otherwise(1)
    pos = F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return tmp.first_run(days.withColumn("p", p).withColumn("pos", pos), ["user_id"], "pos").select("user_id", F.col("hour").alias("frame_id"))


@query("""with h as (select distinct user_id, epoch_us(ts) // 86400000000 as frame_id from events), g as (select *, lead(frame_id) over (partition by user_id order by frame_id) - frame_id as s from h)
select user_id, coalesce(min(frame_id) filter (where s > 1), max(frame_id)) as gap_frame from g group by user_id""")
def first_gap(spark, d):
    h = events(spark, d).select("user_id", F.expr("us div 86400000000").alias("frame_id")).distinct()
    return tmp.first_gap(h, ["user_id"])


@query("select event_id, lead(event_type) over w as next_type, lead(event_id) over w as next_event, lag(event_id, 2) over w as before_last from events window w as (partition by user_id order by ts, event_id)")
def lead_next_event(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, d).select("event_id", F.lead("event_type").over(w).alias("next_type"), F.lead("event_id").over(w).alias("next_event"), F.lag("event_id", 2).over(w).alias("before_last"))


@query("select event_id, user_id from (select *, lead(event_type) over w as nt, lead(epoch_us(ts)) over w - epoch_us(ts) as gap from events window w as (partition by user_id order by ts, event_id)) where not coalesce(nt = event_type and gap < 86400000000, false)")
def self_repeat_filter(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, d).withColumn("nt", F.lead("event_type").over(w)).withColumn("gap", F.lead("us").over(w) - F.col("us"))
    return e.where(~F.coalesce((F.col("nt") == F.col("event_type")) & (F.col("gap") < 24 * HOUR), F.lit(False))).select("event_id", "user_id")


@query("{F}, m as (select f.user_id, f.frame_id, min(n.event_id) as e from fr f left join ne n on n.user_id = f.user_id and n.event_frame = f.frame_id group by all) select user_id, frame_id, last_value(e ignore nulls) over (partition by user_id order by frame_id) as last_event from m")
def ffill_merge(spark, d):
    m = matched(spark, d).groupBy("user_id", F.col("event_frame").alias("frame_id")).agg(F.min("event_id").alias("last_event"))
    return rel.merge_streams(frames(spark, d).select("user_id", "frame_id"), m, ["user_id"], "frame_id", ["last_event"])


@query("{F}, m as (select f.user_id, f.frame_id, min(n.event_id) as e from fr f left join ne n on n.user_id = f.user_id and n.event_frame = f.frame_id group by all) select user_id, frame_id, first_value(e ignore nulls) over (partition by user_id order by frame_id rows between current row and unbounded following) as next_event from m")
def bfill(spark, d):
    m = matched(spark, d).groupBy("user_id", F.col("event_frame").alias("frame_id")).agg(F.min("event_id").alias("next_event"))
    return tmp.back_fill(frames(spark, d).select("user_id", "frame_id").join(m, ["user_id", "frame_id"], "left"), ["user_id"], ["frame_id"], ["next_event"])


@query("{F} select user_id, frame_id, min(value) over w as lo, max(value) over w as hi from fr window w as (partition by user_id order by frame_id range between 3 preceding and 3 following)")
def range_smooth_min_max(spark, d):
    x = lambda fn: tmp.near_extreme(F.col("value"), ["user_id"], "frame_id", fn)
    return frames(spark, d).select("user_id", "frame_id", x(F.min).alias("lo"), x(F.max).alias("hi"))


@query("{F} select user_id, frame_id, max(value) over (partition by user_id order by frame_id range between current row and 5 following) as a5, max(value) over (partition by user_id order by frame_id range between current row and 12 following) as a12 from fr")
def forward_max(spark, d):
    x = lambda n: tmp.near_extreme(F.col("value"), ["user_id"], "frame_id", F.max, 0, n)
    return frames(spark, d).select("user_id", "frame_id", x(5).alias("a5"), x(12).alias("a12"))


@query("""{F}, c as (select *, lead(frame_id) over (partition by user_id order by frame_id) as nf from fr where value > 50), e as (select user_id, max(frame_id) as me from fr group by user_id)
select c.user_id, c.frame_id, max(f.value) as kick_dist from c join e using (user_id) join fr f on f.user_id = c.user_id and f.frame_id between c.frame_id and coalesce(c.nf, e.me) group by all""")
def kick_dist_between_candidates(spark, d):
    f = frames(spark, d).select("user_id", "frame_id", "value")
    return tmp.between_candidates(f.where("value > 50").select("user_id", "frame_id"), f, ["user_id"], "value", width=16)


def _savgol_sql(width: int) -> str:
    row = sig.smoother(width)[width // 2]
    half = width // 2
    parts = []
    for k in range(-half, half + 1):
        x = "value" if k == 0 else f"lead(value, {k}) over w" if k > 0 else f"lag(value, {-k}) over w"
        parts.append(f"{float(row[k + half])!r}::double * {x}")
    return "{F} select user_id, frame_id, round(" + " + ".join(parts) + ", 6) as smooth from fr window w as (partition by user_id order by frame_id)"


@query(_savgol_sql(9))
def savgol9(spark, d):
    return frames(spark, d).select("user_id", "frame_id", F.round(sig.smooth_column("value", ["user_id"], ["frame_id"], 9), 6).alias("smooth"))


@query(_savgol_sql(15))
def savgol15(spark, d):
    return frames(spark, d).select("user_id", "frame_id", F.round(sig.smooth_column("value", ["user_id"], ["frame_id"], 15), 6).alias("smooth"))


_PEAK_SQL = """{F}, s as (select user_id, frame_id, {sign} * value as v from fr),
r as (select user_id, run, min(frame_id) as a, max(frame_id) as z, any_value(v) as v from (select *, sum(n) over (partition by user_id order by frame_id) as run
  from (select *, case when v = lag(v) over (partition by user_id order by frame_id) then 0 else 1 end as n from s)) group by all),
p as (select *, (a + z) // 2 as pos from (select *, lag(v) over (partition by user_id order by run) as l, lead(v) over (partition by user_id order by run) as g from r) where v > l and v > g),
h as (select p.user_id, p.run, p.pos, p.v, max(o.run) filter (where o.run < p.run and o.v > p.v) as hl, min(o.run) filter (where o.run > p.run and o.v > p.v) as hr from p join r o using (user_id) group by all),
b as (select h.user_id, h.pos, h.v, min(o.v) filter (where o.run <= h.run) as bl, min(o.v) filter (where o.run >= h.run) as br from h join r o on o.user_id = h.user_id and o.run > coalesce(h.hl, -1) and (h.hr is null or o.run < h.hr) group by all)
select user_id, pos as frame_id, {sign} * v as value, round(v - greatest(bl, br), 6) as prominence from b where v - greatest(bl, br) >= 10"""


@query(_PEAK_SQL.replace("{sign}", "1"))
def peaks_prominence(spark, d):
    p = sig.peaks_of_series(frames(spark, d).select("user_id", "frame_id", "value"), ["user_id"], "frame_id", "value", 10)
    return p.withColumn("prominence", F.round("prominence", 6))


@query(_PEAK_SQL.replace("{sign}", "-1"))
def valleys(spark, d):
    p = sig.peaks_of_series(frames(spark, d).select("user_id", "frame_id", (-F.col("value")).alias("value")), ["user_id"], "frame_id", "value", 10)
    return p.withColumn("prominence", F.round("prominence", 6)).withColumn("value", -F.col("value"))


@query("""{F}, a as (select user_id, frame_id from fr where value > 80), b as (select user_id, frame_id from fr where value < 20)
select user_id, frame_id, 'high' as source from a union all select user_id, frame_id, 'low' from b where not exists (select 1 from a where a.user_id = b.user_id and a.frame_id between b.frame_id - 3 and b.frame_id + 3)""")
def peak_candidates_union(spark, d):
    f = frames(spark, d)
    a = f.where("value > 80").select("user_id", "frame_id")
    b = f.where("value < 20").select("user_id", "frame_id", (F.col("frame_id") - 3).alias("lo"), (F.col("frame_id") + 3).alias("hi"))
    near = tmp.range_join(b, a.withColumnRenamed("frame_id", "at"), ["user_id"], "lo", "hi", "at", width=8).select("user_id", "frame_id").distinct()
    return a.withColumn("source", F.lit("high")).unionByName(b.join(near, ["user_id", "frame_id"], "left_anti").select("user_id", "frame_id", F.lit("low").alias("source")))


@query("select event_id, round(greatest(0.0, least(1.0, 1 - value / 100)), 6) as down, round(greatest(0.0, least(1.0, (value - 20) / 60)), 6) as up from events")
def clamped_score(spark, d):
    return events(spark, d).select("event_id", F.round(scoring.clamp_linear(F.col("value"), 0, 100), 6).alias("down"), F.round(scoring.clamp_linear(F.col("value"), 20, 80, True), 6).alias("up"))


_CL = "greatest(0.0, least(1.0, {}))"


def _line_score(parts, points):
    return " + ".join(f"{points} * " + _CL.format(p) for p in parts)


_FEATURES = {"ball_accel": "l_quantity", "player_dist": "l_discount * 40", "oppo_dist": "l_tax * 50", "kick_dist": "l_linenumber", "frame_delay": "l_extendedprice / 400", "max_speed": "l_quantity / 10", "delta_speed": "l_tax * 40", "angle_change": "l_discount * 20 - 1", "closest_dist": "l_tax * 30", "next_player_dist": "l_discount * 30"}


def _scores_sql() -> str:
    f = {k: f"({v})" for k, v in _FEATURES.items()}
    ba, pd, kd, fd = f"{f['ball_accel']} / 20", f"1 - {f['player_dist']} / 3", f"{f['kick_dist']} / 5", f"1 - {f['frame_delay']} / 125"
    od = f"1 - {f['oppo_dist']} / 3"
    return f"""select l_orderkey, l_linenumber, round({_line_score([ba, pd, kd, fd], 25)}, 6) as major, round({_line_score([ba, pd, od, kd, fd], 20)}, 6) as tackle,
round({_line_score([f"{f['ball_accel']} * 2 / 20", f"{f['max_speed']} / 5", f"{f['delta_speed']} * 2 / 5", f"1 - ({f['oppo_dist']} - 3) / 3", f"1 - ({f['angle_change']} + 1) / 2"], 20)}, 6) as take_on,
round({_line_score([ba, pd, kd], '(100.0 / 3)')}, 6) as dispossessed, round({_line_score([ba, f"1 - {f['closest_dist']} / 3", f"1 - {f['next_player_dist']} / 3", kd], 25)}, 6) as receive from lineitem"""


@query(_scores_sql())
def combined_scores(spark, d):
    li = table(spark, d, "lineitem")
    f = lambda name: F.expr(_FEATURES[name])
    return li.select("l_orderkey", "l_linenumber", *[F.round(scoring.score(n, f), 6).alias(n) for n in ("major", "tackle", "take_on", "dispossessed", "receive")])


@query("""select event_id, round(100.0 / 3 * (greatest(0, least(1, 1 - value / sqrt(105 * 105 + 68 * 68))) + greatest(0, least(1, 1 - (100 - value) / sqrt(105 * 105 + 68 * 68))) + greatest(0, least(1, 1 - value * 2 / sqrt(105 * 105 + 68 * 68)))), 6) as score from events""")
def score_located(spark, d):
    x = {"player_ball_dist": F.col("value"), "player_event_dist": 100 - F.col("value"), "ball_event_dist": F.col("value") * 2}
    return events(spark, d).select("event_id", F.round(scoring.score("located", x.__getitem__), 6).alias("score"))


@query("select user_id, event_id, value from events qualify row_number() over (partition by user_id order by value desc, event_id) = 1")
def top1_by_score(spark, d):
    return tmp.top1(events(spark, d), ["user_id"], F.desc("value"), "event_id").select("user_id", "event_id", "value")


@query("""with recursive {F2}, ev as (select n.user_id, n.event_id, n.event_frame, row_number() over (partition by n.user_id order by a.us, n.event_id) as k from ne n join an a using (user_id, event_id)),
r as (select user_id, 0::bigint as k, 0::bigint as floor, null::bigint as event_id, null::bigint as frame_id from (select distinct user_id from ev)
  union all select e.user_id, e.k, coalesce(m.f, r.floor), e.event_id, m.f from r join ev e on e.user_id = r.user_id and e.k = r.k + 1
  left join lateral (select f.frame_id as f from fr f where f.user_id = e.user_id and f.frame_id between greatest(e.event_frame - 4, r.floor) and e.event_frame + 4 order by f.value desc, f.frame_id limit 1) m on true)
select user_id, event_id, frame_id from r where k > 0""".replace("{F2}", FRAMES_SQL))
def monotone_match(spark, d):
    """Forward-only matching: the best frame of each event's window, never before the last match."""
    from .plans.fold import forward_only

    ev = matched(spark, d).withColumn("lo", F.col("event_frame") - 4).withColumn("hi", F.col("event_frame") + 4)
    f = frames(spark, d).select("user_id", "frame_id", F.col("value").alias("fvalue"))
    c = tmp.range_join(ev, f, ["user_id"], "lo", "hi", "frame_id", width=8)
    arr = c.groupBy("user_id", "event_id", "us").agg(F.array_sort(F.collect_list(F.struct("frame_id", "fvalue"))).alias("cands"))
    return forward_only(arr, "user_id", ["us", "event_id"], "event_id")


@query("{F} select user_id, event_id, min(event_frame) over (partition by user_id order by event_id rows between 1 following and unbounded following) as later_min, max(event_frame) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as earlier_max from ne")
def following_min_preceding_max(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return matched(spark, d).select("user_id", "event_id", F.min("event_frame").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("later_min"), F.max("event_frame").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier_max"))


@query("select event_id, last_value(case when event_type <> 'error' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as last_other from events")
def last_nonmatching_row(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events(spark, d).select("event_id", F.last(F.when(F.col("event_type") != "error", F.col("event_id")), True).over(w).alias("last_other"))


_POS = "e as (select vec_id, label, vec_id // 10 as frame, embedding[1]::double as x, embedding[2]::double as y from embeddings)"


def positions(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.expr("vec_id div 10").alias("frame"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


@query(f"with {_POS} select a.vec_id, b.vec_id as nearest, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) as dist from e a join e b on a.frame = b.frame and a.label <> b.label qualify row_number() over (partition by a.vec_id order by sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.vec_id) = 1")
def nearest_opponent(spark, d):
    a = positions(spark, d)
    b = a.select("frame", F.col("vec_id").alias("nearest"), F.col("label").alias("bl"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return tmp.nearest_object(a, b, ["frame"], "x", "y", "bx", "by", "nearest", F.col("label") != F.col("bl")).select("vec_id", "nearest", F.round("dist", 6).alias("dist"))


@query(f"""with {_POS}, c as (select a.vec_id, b.vec_id as nearest, case when b.x <= a.x + 0.1 then sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) else 105.0 end as dist from e a join e b on a.frame = b.frame and a.vec_id <> b.vec_id)
select vec_id, nearest, round(dist, 6) as dist from c qualify row_number() over (partition by vec_id order by dist, nearest) = 1""")
def nearest_opponent_theta(spark, d):
    a = positions(spark, d)
    b = a.select("frame", F.col("vec_id").alias("nearest"), F.col("x").alias("bx"), F.col("y").alias("by"))
    j = a.join(b, "frame").where("vec_id <> nearest")
    dist = F.when(F.col("bx") <= F.col("x") + 0.1, scoring.distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))).otherwise(105.0)
    return tmp.top1(j.withColumn("dist", dist), ["vec_id"], "dist", "nearest").select("vec_id", "nearest", F.round("dist", 6).alias("dist"))


@query("select vec_id, round(case when n > 0 then (embedding[1]::double * embedding[3] + embedding[2]::double * embedding[4]) / n else 0 end, 6) as cosine from (select *, sqrt(embedding[1]::double * embedding[1] + embedding[2]::double * embedding[2]) * sqrt(embedding[3]::double * embedding[3] + embedding[4]::double * embedding[4]) as n from embeddings)")
def cosine_angle(spark, d):
    x = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    return table(spark, d, "embeddings").select("vec_id", F.round(scoring.cosine2(x[0], x[1], x[2], x[3]), 6).alias("cosine"))


@query("select l_orderkey, l_linenumber, u.o as object_id, u.x as x from (select l_orderkey, l_linenumber, unnest([{'o': 'l_disc', 'x': l_discount}, {'o': 'l_tax', 'x': l_tax}, {'o': 'l_qty', 'x': l_quantity}]) as u from lineitem)")
def unpivot_measures(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("l_disc_x"), F.col("l_tax").alias("l_tax_x"), F.col("l_quantity").alias("l_qty_x"))
    return rel.unpivot_objects(li, ["l_orderkey", "l_linenumber"], "l_", ["x"])


@query("select l_orderkey, max(case when l_returnflag = 'A' then l_quantity end) as a, max(case when l_returnflag = 'N' then l_quantity end) as n, max(case when l_returnflag = 'R' then l_quantity end) as r from lineitem group by l_orderkey")
def pivot_back(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("l_quantity"))
    return p.toDF("l_orderkey", "a", "n", "r")


@query("select n_nationkey as c_nationkey, n_name, r_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def natural_join(spark, d):
    n = table(spark, d, "nation").withColumnsRenamed({"n_nationkey": "c_nationkey", "n_regionkey": "r_regionkey"})
    j = rel.natural_join(rel.natural_join(table(spark, d, "customer"), n), table(spark, d, "region"))
    return j.groupBy("c_nationkey", "n_name", "r_name").agg(F.count("*").alias("customers"))


@query("select o_orderkey, o_custkey from orders where o_custkey in (select o_custkey from orders group by o_custkey having count(distinct o_orderstatus) = 1)")
def semi_single_date(spark, d):
    return rel.single_valued(table(spark, d, "orders"), "o_custkey", "o_orderstatus").select("o_orderkey", "o_custkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def anti_unmatched(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select s_suppkey, n_name as nation from supplier left join nation on s_nationkey = n_nationkey")
def map_join(spark, d):
    return rel.lookup(table(spark, d, "supplier"), table(spark, d, "nation"), "s_nationkey", "n_nationkey", "n_name", "nation").select("s_suppkey", "nation")


@query("""select event_id, case when event_type = 'purchase' and value > 66 then 'shot' when event_type = 'purchase' and nt = 'error' then 'cross' when event_type = 'purchase' then 'pass'
when event_type = 'signup' and pt = 'signup' then 'tackle' when event_type = 'signup' then 'interception' end as spadl_type from (select *, lead(event_type) over w as nt, lag(event_type) over w as pt from events window w as (partition by user_id order by ts, event_id))""")
def spadl_case_typing(spark, d):
    from .sources.typing_rules import rules

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, d).withColumn("nt", F.lead("event_type").over(w)).withColumn("pt", F.lag("event_type").over(w))
    t, v = F.col("event_type"), F.col("value")
    ordered = [(t == "signup", "interception"), ((t == "signup") & (F.col("pt") == "signup"), "tackle"), (t == "purchase", "pass"), ((t == "purchase") & (F.col("nt") == "error"), "cross"), ((t == "purchase") & (v > 66), "shot")]
    return e.select("event_id", rules(ordered).alias("spadl_type"))


@query("select event_id, epoch_us(ts) - first_value(epoch_us(ts)) over w as us_in_match, round((epoch_us(ts) - first_value(epoch_us(ts)) over w) / 1000000.0, 6) as seconds, ((epoch_us(ts) - first_value(epoch_us(ts)) over w) // 1000000)::bigint * 25 as frame_id from events window w as (partition by user_id order by ts, event_id)")
def period_offset(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, d).withColumn("u", F.col("us") - F.first("us").over(w))
    return e.select("event_id", F.col("u").alias("us_in_match"), F.round(F.col("u") / 1e6, 6).alias("seconds"), times.frame_of(F.expr("u div 1000000").cast("double")).alias("frame_id"))


@query("{F}, b as (select a.user_id, min(a.us) - arg_min(f.us, f.frame_id) as off from (select user_id, min(us) as us from an group by user_id) a join fr f using (user_id) group by a.user_id) select an.event_id, an.us - b.off as us from an join b using (user_id)")
def clock_bias(spark, d):
    a = annotated(spark, d)
    first = frames(spark, d).groupBy("user_id").agg(F.min_by("us", "frame_id").alias("f0"))
    off = a.groupBy("user_id").agg(F.min("us").alias("e0")).join(first, "user_id").select("user_id", (F.col("e0") - F.col("f0")).alias("off"))
    return a.join(off, "user_id").select("event_id", (F.col("us") - F.col("off")).alias("us"))


@query(f"""with {_POS}, m as (select label, avg(x) as mx from e group by label), g as (select avg(mx) as g from m)
select e.vec_id, case when round(m.mx, 9) > round(g.g, 9) then rint(({{L}} - e.x) * 100) / 100 else e.x end as x from e join m using (label), g""".replace("{L}", "105.0").replace("rint(", "round_even(").replace("* 100) / 100", "* 100, 0) / 100"))
def orientation_flip(spark, d):
    p = positions(spark, d)
    m = p.groupBy("label").agg(F.avg("x").alias("mx"))
    g = m.agg(F.avg("mx").alias("g"))  # the mean of the objects' means
    return p.join(m, "label").crossJoin(F.broadcast(g)).select("vec_id", rel.flip_if("x", F.round("mx", 9) > F.round("g", 9), 105.0).alias("x"))


@query("""select coalesce(lang, 'total') as category, count(*) as total, round(avg(abs(z)), 6) as mean_diff, count(*) filter (where abs(z) <= 0) as exact, count(*) filter (where abs(z) <= 5) as within_5, count(*) filter (where abs(z) <= 25) as within_25,
count(*) filter (where abs(z) <= 50) as within_50, count(z) as valid, round((count(*) filter (where abs(z) <= 0))::double / count(*), 6) as exact_rate, round((count(*) filter (where abs(z) <= 5))::double / count(*), 6) as within_5_rate,
round((count(*) filter (where abs(z) <= 25))::double / count(*), 6) as within_25_rate, round((count(*) filter (where abs(z) <= 50))::double / count(*), 6) as within_50_rate, round(count(z)::double / count(*), 6) as valid_rate
from (select d.lang, case when l.quality = 1 then d.n_chars % 101 - 50 end as z from labels l join documents d using (doc_id)) group by grouping sets ((lang), ())""")
def accuracy_report(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rel.accuracy(j.select("lang", F.when(F.col("quality") == 1, F.col("n_chars") % 101 - 50).alias("diff")), "diff", "lang")


@query("""with b as (select least(greatest(floor(l_quantity / 50 * 10)::bigint, 0), 9) as i, least(greatest(floor(l_discount / 0.1 * 8)::bigint, 0), 7) as j from lineitem), c as (select 10 * (7 - j) + i as bin, count(*) as n from b group by all)
select r.bin, coalesce(n, 0) as n from (select unnest(range(80)) as bin) r left join c using (bin)""")
def heatmap_2d(spark, d):
    return rel.histogram2d(table(spark, d, "lineitem"), "l_quantity", "l_discount", 50, 0.1, 10, 8)


@query("{F}, e as (select n.user_id, n.event_id, n.event_frame as frame_id, lead(n.event_frame) over (partition by n.user_id order by a.us, n.event_id) as nf from ne n join an a using (user_id, event_id)) select user_id, event_id, frame_id, 'event' as kind from e union all select user_id, event_id, frame_id + 1, 'receive' from e where frame_id + 1 < nf")
def union_receive_rows(spark, d):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = matched(spark, d).withColumn("nf", F.lead("event_frame").over(w)).select("user_id", "event_id", F.col("event_frame").alias("frame_id"), "nf")
    more = e.where(F.col("frame_id") + 1 < F.col("nf")).select("user_id", "event_id", (F.col("frame_id") + 1).alias("frame_id"), F.lit("receive").alias("kind"))
    return e.select("user_id", "event_id", "frame_id", F.lit("event").alias("kind")).unionByName(more)


@query("select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")
def dedupe_first(spark, d):
    return rel.keep_first(events(spark, d), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query("""select 'value_range' as rule, count(*) filter (where not (value between 0 and 99)) as violations from events union all select 'type_known', count(*) filter (where event_type not in ('view', 'click')) from events
union all select 'event_id_not_null', count(*) filter (where event_id is null) from events union all select 'user_id_not_null', count(*) filter (where user_id is null) from events union all select 'value_type', count(*) from events""")
def validate_contract(spark, d):
    c = Contract({"event_id": "bigint", "user_id": "bigint", "value": "float"}, nullable=frozenset({"value"}), checks={"value_range": lambda: F.col("value").between(0, 99), "type_known": lambda: F.col("event_type").isin("view", "click")})
    return validate(events(spark, d), c)


@query("select event_id, printf('%02d:%02d.%02d', c // 6000, (c // 100) % 60, c % 100) as clock, c / 100.0 as seconds from (select event_id, (event_id * 7919) % 600000 as c from events)")
def format_parse_clock(spark, d):
    e = events(spark, d).select("event_id", (F.col("event_id") * 7919 % 600000 / 100).alias("s"))
    return e.select("event_id", times.format_clock(F.col("s")).alias("clock"), F.round(times.parse_clock(times.format_clock(F.col("s"))), 2).alias("seconds"))


@query("{F} select user_id, frame_id, value from fr where frame_id % 5 = 0")
def strided_sample(spark, d):
    return rel.strided(frames(spark, d), ["user_id"], ["frame_id"], 5).select("user_id", "frame_id", "value")


@query("{F} select user_id, frame_id, array_to_string(list(event_id) over (partition by user_id order by frame_id rows between 4 preceding and current row), ',') as history from fr")
def history_list(spark, d):
    w = Window.partitionBy("user_id").orderBy("frame_id").rowsBetween(-4, 0)
    return frames(spark, d).select("user_id", "frame_id", F.array_join(F.collect_list(F.col("event_id").cast("string")).over(w), ",").alias("history"))


@query("select event_id from events where event_type = 'click' intersect select event_id from events where value > 50")
def intersect_ids(spark, d):
    e = events(spark, d)
    return e.where("event_type = 'click'").select("event_id").intersect(e.where("value > 50").select("event_id"))


@query("select user_id from events where event_type = 'view' except select user_id from events where event_type = 'error' and value > 90")
def except_users(spark, d):
    e = events(spark, d)
    return e.where("event_type = 'view'").select("user_id").subtract(e.where("event_type = 'error' and value > 90").select("user_id"))


@query("select user_id, string_agg(distinct event_type, ' vs ' order by event_type) as kinds, count(*) as n, min(value) as lo, max(value) as hi from events group by user_id")
def string_aggregate(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), " vs ").alias("kinds"), F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))

"""Queries for the steps of the synchroniser, the providers and the reports, on match tables made of ``events``.

A match is a ``user_id``.  Each view, click or error row gives ten frames of a ball and four
players, whose places are waves of the frame number; purchase and signup rows are the events,
with types, players and clocks from their ids.  The same tables are built in SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vocab
from .functions import times
from .operators import relational as rel
from .operators import signal as sig
from .plans import report
from .plans import synchronise as syn
from .queries import events, query, table
from .sources import files, parquet_provider, xml_provider
from .storage import shared_dir

SECOND = 10_400_000
_TYPES = "[" + ", ".join(f"'{t}'" for t in vocab.TYPES) + "]"
MATCH_SQL = f"""n as (select user_id as u, row_number() over (partition by user_id order by ts, event_id) - 1 as n from events where event_type in ('view', 'click', 'error')),
fr as (select u, u::varchar as match_id, n * 12 + 10 * (n // 7) + j as frame_id, (case when n < 20 then 1 else 2 end)::bigint as period_id from n, range(10) r(j)),
tr as (select u, match_id, frame_id, period_id, frame_id / 25.0::double as timestamp, frame_id * 40000 as us, p as player_id, k = 0 as ball,
  52.5::double + (abs((frame_id + k * 17 + u * 5) % 160 - 80) - 40) * 0.5::double as x, 34::double + (abs((frame_id + k * 23 + u * 3) % 120 - 60) - 30) * 0.5::double as y,
  case when k = 0 then ((frame_id + u) % 40) * 0.125::double end as z, ((frame_id + k) % 8)::double as speed, ((frame_id * 7 + u) % 50 - 20)::double as accel_s, ((frame_id * 7 + u + k) % 50)::double as accel_v
  from fr, (values (0, null), (1, 'home_1'), (2, 'home_2'), (3, 'away_1'), (4, 'away_2')) o(k, p)),
ev as (select *, (case when us < {SECOND} then 1 else 2 end)::bigint as period_id from (select user_id as u, user_id::varchar as match_id, event_id, i as event_idx, ['home_1', 'home_2', 'away_1', 'away_2'][event_id % 4 + 1] as player_id,
  case when i = 0 then 'pass' else {_TYPES}[(event_id * 7) % 26 + 1] end as spadl_type, value > 50 as success, value, i * 700000 + event_id % 11 * 30000 as us
  from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events where event_type in ('purchase', 'signup')))),
nb as (select *, lead(player_id) over p as next_player_id, lead(spadl_type) over p as next_type, lag(player_id) over m as prev_player_id, lag(us) over m as prev_us from ev
  window p as (partition by match_id, period_id order by event_idx), m as (partition by match_id order by event_idx)),
ep as (select *, sum(case when g is null or g >= 5 then 1 else 0 end) over (partition by match_id order by period_id, frame_id) as episode_id
  from (select *, frame_id - lag(frame_id) over (partition by match_id, period_id order by frame_id) as g, frame_id * 40000 as us from fr))"""


def role(sql: str):
    return query("with " + MATCH_SQL + sql)


def utc(us):
    return F.timestamp_add("MICROSECOND", us, F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"))


#: bytes of the events' files whose matches lie together; their tracking has about 400,000 rows
PART = 1 << 18


def match_rows(spark, d, kinds: list[str]) -> DataFrame:
    """Rows of events of some types, moved by match_id, so that steps by match leave what is made of them where it is."""
    n = int(str(table(spark, d, "events")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // PART + 2  # rows in a single part would be moved by any join
    return events(spark, d).where(F.col("event_type").isin(kinds)).withColumn("match_id", F.col("user_id").cast("string")).repartition(n, "match_id")


def match_tracking(spark, d) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("match_id").orderBy("ts", "event_id")) - 1
    f = match_rows(spark, d, ["view", "click", "error"]).select("match_id", F.col("user_id").alias("u"), n.cast("long").alias("n"))
    f = f.select("match_id", "u", "n", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("j")).select("match_id", "u", F.expr("n * 12 + 10 * (n div 7) + j").alias("frame_id"), F.when(F.col("n") < 20, 1).otherwise(2).cast("long").alias("period_id"))
    objects = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate([None, "home_1", "home_2", "away_1", "away_2"])])
    t = f.select("*", F.inline(objects))
    wave = lambda a, b, m: F.expr(f"cast(abs((frame_id + k * {a} + u * {b}) % {m} - {m // 2}) - {m // 4} as double) * 0.5D")
    return t.select(
        "match_id", "frame_id", "period_id", (F.col("frame_id") / F.lit(25.0)).alias("timestamp"), utc(F.col("frame_id") * 40000).alias("utc_timestamp"), F.col("p").alias("player_id"), (F.col("k") == 0).alias("ball"),
        (52.5 + wave(17, 5, 160)).alias("x"), (34.0 + wave(23, 3, 120)).alias("y"), F.expr("case when k = 0 then (frame_id + u) % 40 * 0.125D end").alias("z"),
        F.expr("cast((frame_id + k) % 8 as double)").alias("speed"), F.expr("cast((frame_id * 7 + u) % 50 - 20 as double)").alias("accel_s"), F.expr("cast((frame_id * 7 + u + k) % 50 as double)").alias("accel_v"),
    )


def match_events(spark, d) -> DataFrame:
    i = (F.row_number().over(Window.partitionBy("match_id").orderBy("ts", "event_id")) - 1).cast("long")
    e = match_rows(spark, d, ["purchase", "signup"]).withColumn("i", i).withColumn("t", F.expr("i * 700000 + event_id % 11 * 30000"))
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int") + 1)
    kind = F.when(F.col("i") == 0, "pass").otherwise(pick(vocab.TYPES, F.expr("event_id * 7 % 26")))
    return e.select(
        "match_id", F.col("i").alias("event_idx"), F.when(F.col("t") < SECOND, 1).otherwise(2).cast("long").alias("period_id"), utc(F.col("t")).alias("utc_timestamp"),
        pick(["home_1", "home_2", "away_1", "away_2"], F.expr("event_id % 4")).alias("player_id"), kind.alias("spadl_type"), (F.col("value") > 50).alias("success"), "event_id", "value",
    )


def since(us):
    """Microseconds of the match clock."""
    return us - times.micros(F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"))


@role(" select match_id, period_id, frame_id, episode_id::bigint as episode_id from ep")
def frame_dimension(spark, d):
    return syn.frame_dimension(match_tracking(spark, d)).select("match_id", "period_id", "frame_id", F.col("episode_id").cast("long").alias("episode_id"))


_NEAR = """, s as (select *, case when spadl_type = 'foul' then prev_us else us end as probe, case when spadl_type in ({pass}, {inc}, 'tackle') then 10 when spadl_type in ({piece}) then 15 else 10 end as w from nb),
ne as (select s.match_id, s.event_idx, arg_min(f.frame_id, (abs(f.us - s.probe), f.frame_id)) as ef, min(abs(f.us - s.probe)) as gap from s join ep f using (match_id) where probe is not null group by all),
eps as (select match_id, episode_id, min(frame_id) as a, max(frame_id) as z, max(frame_id) filter (where i <= 25) as head, min(frame_id) filter (where j <= 25) as tail
  from (select *, row_number() over (partition by match_id, episode_id order by frame_id) as i, row_number() over (partition by match_id, episode_id order by frame_id desc) as j from ep) group by all),
b as (select s.*, ne.ef, gap > w * 1000000 as far, eps.* exclude (match_id), w * 25 - 1 as reach, ef - a < w * 25 as early from s join ne using (match_id, event_idx) join ep f on f.match_id = s.match_id and f.frame_id = ef join eps on eps.match_id = s.match_id and eps.episode_id = f.episode_id),
wb as (select match_id, event_idx, case when spadl_type = 'foul' then z else ef end as event_frame,
  case when spadl_type = 'foul' then case when not far then tail end when spadl_type in ({piece}) then case when far then null when early then a when spadl_type = 'throw_in' then ef - reach end else ef - reach end as lo,
  case when spadl_type = 'foul' then case when not far then z end when spadl_type in ({piece}) then case when far then null when early then head when spadl_type = 'throw_in' then ef + reach end else ef + reach end as hi from b)"""
for _k, _v in {"pass": vocab.PASS_LIKE_OPEN, "inc": vocab.INCOMING, "piece": vocab.SET_PIECE}.items():
    _NEAR = _NEAR.replace("{" + _k + "}", ", ".join(f"'{t}'" for t in _v))


def bounded(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    t, e = match_tracking(spark, d), syn.with_neighbours(match_events(spark, d))
    frames = syn.frame_dimension(t)
    return t, frames, syn.window_bounds(e, frames)


@role(_NEAR + " select match_id, event_idx, event_frame, lo, hi from wb")
def window_of_frames(spark, d):
    """The frames that may hold each event, by its type; fouls of a match's start have no event before them and no row."""
    return bounded(spark, d)[2].select("match_id", "event_idx", "event_frame", "lo", "hi")


@role(_NEAR + f""", own as (select e.*, wb.event_frame, wb.lo, wb.hi, t.frame_id as frame, t.x as px, t.y as py, b.x as bx, b.y as byy, b.z as ball_height, b.accel_v as ball_accel from nb e join wb using (match_id, event_idx)
  join tr t on t.match_id = e.match_id and t.period_id = e.period_id and t.player_id = e.player_id and t.frame_id between lo and hi join tr b on b.match_id = t.match_id and b.frame_id = t.frame_id and b.ball),
named as (select *, case when player_id[1:4] = 'home' then 105::double else 0 end as gx, case when spadl_type = 'tackle' and prev_player_id[1:4] <> player_id[1:4] then prev_player_id
  when spadl_type = 'take_on' and not success and next_type = 'tackle' and next_player_id[1:4] <> player_id[1:4] then next_player_id end as named from own where spadl_type in ('tackle', 'take_on', 'second_take_on')),
opp as (select n.match_id, n.event_idx, n.frame, o.player_id as oppo_id, o.x as ox, o.y as oy from named n join tr o on o.match_id = n.match_id and o.frame_id = n.frame and not o.ball and o.player_id[1:4] <> n.player_id[1:4] and (named is null or o.player_id = named)
  where named is not null or spadl_type <> 'tackle' qualify row_number() over (partition by n.match_id, n.event_idx, n.frame order by
  case when named is not null or sqrt((o.x - gx) ** 2 + (o.y - 34) ** 2) <= sqrt((px - gx) ** 2 + (py - 34) ** 2) + 1 then sqrt((o.x - px) ** 2 + (o.y - py) ** 2) else {vocab.PITCH_X}::double end, o.player_id) = 1)
select match_id, event_idx, frame, round(sqrt((px - bx) ** 2 + (py - byy) ** 2), 6) as player_dist, ball_height, ball_accel, greatest(0, frame - event_frame)::double as frame_delay, oppo_id,
  round(sqrt((ox - bx) ** 2 + (oy - byy) ** 2), 6) as oppo_dist, ox - px as oppo_rel_x, oy - py as oppo_rel_y from own left join opp using (match_id, event_idx, frame)""")
def frame_features(spark, d):
    """Acting player, ball and opponent of every frame of every event's window."""
    t, _, e = bounded(spark, d)
    f = syn.window_rows(e, t)
    rows = f.select("match_id", "event_idx", F.inline(F.arrays_zip(*[F.col(f"f_{c}").alias(c) for c in syn.PACKED])))
    return rows.select("match_id", "event_idx", F.col("frame").cast("long").alias("frame"), F.round("player_dist", 6).alias("player_dist"), "ball_height", "ball_accel", "frame_delay", "oppo_id", F.round("oppo_dist", 6).alias("oppo_dist"), "oppo_rel_x", "oppo_rel_y")


_KICK = """, st as (select match_id, period_id, min(frame_id) as f0 from ep group by all),
first as (select * from nb qualify row_number() over (partition by match_id, period_id order by event_idx) = 1),
bl as (select t.* from tr t join st using (match_id, period_id) where ball and frame_id < f0 + 125 and x between 49.5 and 55.5 and y between 31 and 37),
run as (select * from (select *, sum(g) over (partition by match_id, period_id order by frame_id) as r from (select *, case when frame_id - lag(frame_id) over (partition by match_id, period_id order by frame_id) > 1 then 1 else 0 end as g from bl)) where r < 1),
dist as (select run.match_id, run.period_id, run.frame_id, run.accel_v, sqrt((t.x - run.x) ** 2 + (t.y - run.y) ** 2) as dist from run join first using (match_id, period_id) join tr t on t.match_id = run.match_id and t.frame_id = run.frame_id and t.player_id = first.player_id),
pick as (select match_id, period_id, frame_id as found from dist qualify row_number() over (partition by match_id, period_id order by case when dist < 2 then 0 else 1 end, case when dist < 2 then accel_v end desc nulls last, dist, frame_id) = 1),
crowd as (select match_id, period_id, count(*) as c from tr t join st using (match_id, period_id) join (select match_id, period_id, player_id[1:4] as team from first) using (match_id, period_id)
  where frame_id = f0 and not ball and player_id[1:4] = team and x between 47.5 and 57.5 and y between 29 and 39 group by all),
kick as (select first.match_id, first.period_id, first.event_idx, first.us, found is not null and coalesce(c, 0) <= 1 and spadl_type = 'pass' as ok, case when found is not null and coalesce(c, 0) <= 1 and spadl_type = 'pass' then found else f0 end as kick_frame
  from first join st using (match_id, period_id) left join pick using (match_id, period_id) left join crowd using (match_id, period_id))"""


@role(_KICK + ' select match_id, period_id, event_idx, kick_frame, ok, case when ok then us - kick_frame * 40000 else 0 end as "offset" from kick')
def kickoff(spark, d):
    """The kickoff frame and clock offset of each period, with the first frame where none is found."""
    t, e = match_tracking(spark, d), syn.with_neighbours(match_events(spark, d)).withColumn("us", since(F.col("us")))
    frames = syn.frame_dimension(t).withColumn("us", since(F.col("us")))
    return syn.kickoffs(e, t, frames).select("match_id", "period_id", "event_idx", "kick_frame", "ok", "offset")


_SYNCED = """, sy as (select e.*, arg_min(f.frame_id, (abs(f.us - e.us), f.frame_id)) as frame_id from nb e join ep f using (match_id) group by all),
ca as (select e.*, f.episode_id, max(f2.z) as ep_last, e.nf as next_frame, g.episode_id as next_ep from (select *, min(frame_id) over (partition by match_id order by event_idx rows between 1 following and unbounded following) as nf from sy) e
  join ep f on f.match_id = e.match_id and f.frame_id = e.frame_id join (select match_id, episode_id, max(frame_id) as z from ep group by all) f2 on f2.match_id = e.match_id and f2.episode_id = f.episode_id
  left join ep g on g.match_id = e.match_id and g.frame_id = e.nf where spadl_type in ({passes}) group by all),
cs as (select *, least(frame_id + 250, ep_last, coalesce(next_frame, frame_id + 250)) as max_frame, case when next_type is null then 1 when next_type in ({oop}) then 2 when spadl_type in ('shot', 'shot_freekick', 'shot_penalty') and success then 3
  when next_ep = episode_id and next_type in ({inc}, 'shot_block', 'keeper_punch') then 4 when frame_id = least(frame_id + 250, ep_last, coalesce(next_frame, frame_id + 250)) then 5 else 0 end as c from ca)"""
for _k, _v in {"passes": syn.PASSES, "oop": vocab.SET_PIECE_OOP, "inc": vocab.INCOMING}.items():
    _SYNCED = _SYNCED.replace("{" + _k + "}", ", ".join(f"'{t}'" for t in _v))


def synced_roles(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tracking, frames, and events that hold the frame nearest to their clock."""
    from .operators import temporal as tmp

    t, e = match_tracking(spark, d), syn.with_neighbours(match_events(spark, d))
    frames = syn.frame_dimension(t)
    return t, frames, tmp.nearest(e, frames.select("match_id", "us", "frame_id"), ["match_id"], "us", "us", out="frame_id")


@role(_SYNCED + """ select match_id, event_idx, c as "case", max_frame, case when c = 2 then 'out' when c = 3 then 'goal' when c > 3 then next_player_id end as receiver_id,
case when c between 1 and 3 then ep_last when c = 4 then next_frame when c = 5 then max_frame end as receive_frame_id from cs""")
def receive_cases(spark, d):
    """Which rule decides each pass's receive, and its result where one does."""
    _, frames, e = synced_roles(spark, d)
    c = syn.receive_cases(e, frames)
    return c.select("match_id", "event_idx", "case", "max_frame").join(syn.quick_receives(c), ["match_id", "event_idx"], "left")


@role(_SYNCED + """, dd as (select cs.match_id, cs.event_idx, cs.next_player_id, cs.player_id as passer, cs.success, cs.spadl_type, cs.next_type, t.frame_id as frame, t.player_id as obj, sqrt((t.x - b.x) ** 2 + (t.y - b.y) ** 2) as dist, b.z as ball_height, b.accel_v as ball_accel
  from cs join tr t on t.match_id = cs.match_id and t.period_id = cs.period_id and t.frame_id between cs.frame_id and max_frame and not t.ball join tr b on b.match_id = t.match_id and b.frame_id = t.frame_id and b.ball where c = 0),
ok as (select *, case when spadl_type = 'clearance' or coalesce(next_type = 'shot_block', false) then obj = next_player_id when spadl_type in ('pass', 'cross', 'freekick_crossed', 'freekick_short', {oop})
  then case when success then obj[1:4] = passer[1:4] and obj <> passer else obj[1:4] <> passer[1:4] end else true end as cand from dd)
select match_id, event_idx, frame, round(min(case when obj = next_player_id then case when next_player_id = passer then 0 else dist end end), 6) as next_player_dist, round(min(dist) filter (where cand), 6) as closest_dist,
  arg_min(obj, (dist, case when obj[1:4] = 'home' then 0 else 1 end, obj)) filter (where cand) as closest_id, any_value(ball_height) as ball_height, any_value(ball_accel) as ball_accel from ok group by match_id, event_idx, frame
having min(case when obj = next_player_id then 0 end) is not null and count(*) filter (where cand) > 0""".replace("{oop}", ", ".join(f"'{t}'" for t in vocab.SET_PIECE_OOP)))
def receive_features(spark, d):
    """Distances to the next player and to the nearest possible receiver in every frame after a pass."""
    t, frames, e = synced_roles(spark, d)
    f = syn.receive_features(syn.receive_cases(e, frames), t)
    rows = f.select("match_id", "event_idx", F.inline(F.arrays_zip(*[F.col(c) for c in (*syn.RECEIVE, "closest_id")])))
    return rows.select("match_id", "event_idx", F.col("frame").cast("long").alias("frame"), F.round("next_player_dist", 6).alias("next_player_dist"), F.round("closest_dist", 6).alias("closest_dist"), "closest_id", "ball_height", "ball_accel")


def _gate_sql(i: int) -> str:
    parts = [f"when spadl_type in ({', '.join(repr(t) for t in g[0])}) then {'null' if g[i] is None else g[i]}::double" for g in syn.GATES]
    return "case " + " ".join(parts) + " end"


@role(f""", g as (select *, {_gate_sql(1)} as w, {_gate_sql(2)} as gd, {_gate_sql(3)} as gh, {_gate_sql(4)} as glo, {_gate_sql(5)} as ghi, value as sx, value * 0.68::double as sy from ev),
ne as (select g.match_id, g.event_idx, arg_min(f.frame_id, (abs(f.us - g.us), f.frame_id)) as ef from g join ep f using (match_id) where w is not null group by all),
j as (select g.*, t.frame_id as frame, b.accel_s as acc, b.z as h, sqrt((t.x - b.x) ** 2 + (t.y - b.y) ** 2) as pb, sqrt((t.x - sx) ** 2 + (t.y - sy) ** 2) as pe, sqrt((b.x - sx) ** 2 + (b.y - sy) ** 2) as be
  from g join ne using (match_id, event_idx) join tr t on t.match_id = g.match_id and t.period_id = g.period_id and t.player_id = g.player_id and t.frame_id between ef - w * 25 + 1 and ef + w * 25 - 1 join tr b on b.match_id = t.match_id and b.frame_id = t.frame_id and b.ball)
select match_id, event_idx, frame, pb <= gd and h <= gh and (glo is null or acc >= glo) and (ghi is null or acc <= ghi) as candidate,
  round(100.0::double / 3 * (greatest(0, least(1, 1 - pb / sqrt(15649))) + greatest(0, least(1, 1 - pe / sqrt(15649))) + greatest(0, least(1, 1 - be / sqrt(15649)))), 6) as score from j""")
def located_features(spark, d):
    """Gates and scores of the located baseline in every frame of every event's window."""
    t, e = match_tracking(spark, d), syn.with_neighbours(match_events(spark, d))
    e = e.withColumns({"start_x": F.col("value"), "start_y": F.col("value") * 0.68})
    return syn.located_features(e, t, syn.frame_dimension(t)).select("match_id", "event_idx", "frame", "candidate", F.round("score", 6).alias("score"))


def _smooth_sql(source: str, col: str, out: str, width: int) -> str:
    """A Savitzky-Golay filter with its ends over series (match_id, k) ordered by frame_id, as a subquery."""
    h, half = sig.smoother(width), width // 2
    at = lambda k: "v" if k == 0 else f"lead(v, {k}) over w" if k > 0 else f"lag(v, {-k}) over w"
    line = lambda row, first: " + ".join(f"{float(c)!r}::double * {at(j - first)}" for j, c in enumerate(row))
    ends = " ".join(f"when i = {r + 1} then {line(h[r], r)} when i = n - {r} then {line(h[width - 1 - r], width - 1 - r)}" for r in range(half))
    return f"(select *, case when n < {width} then v {ends} else {line(h[half], half)} end as {out} from (select *, {col} as v, row_number() over w as i, count(*) over (partition by match_id, k) as n from {source} window w as (partition by match_id, k order by frame_id)) window w as (partition by match_id, k order by frame_id))"


def _rate_sql(source: str, col: str, out: str) -> str:
    step = f"({col} - lag({col}) over (partition by match_id, k order by frame_id)) * 25"
    return f"(select *, first_value({out}_ ignore nulls) over (partition by match_id, k order by frame_id rows between current row and unbounded following) as {out} from (select *, {step} as {out}_ from {source}))"


_KIN = ", t0 as (select match_id, frame_id, period_id, coalesce(player_id, 'ball') as k, x, y from tr where period_id = 1)"
_SRC = "t0"
for _a in ("x", "y"):
    _KIN += f", r{_a} as {_rate_sql(_SRC, _a, 'd' + _a)}, s{_a} as (select * exclude (v, i, n) from {_smooth_sql('r' + _a, 'd' + _a, 'v' + _a, 15)})"
    _SRC = "s" + _a
_KIN += f", sp as (select *, sqrt(vx * vx + vy * vy) as speed from {_SRC})"
_SRC = "sp"
for _c, _o in (("speed", "accel_s"), ("vx", "ax"), ("vy", "ay")):
    _KIN += f", r{_o} as {_rate_sql(_SRC, _c, 'd' + _o)}, s{_o} as (select * exclude (v, i, n) from {_smooth_sql('r' + _o, 'd' + _o, _o, 9)})"
    _SRC = "s" + _o


@role(_KIN + " select match_id, k as object_id, frame_id, round(speed, 5) + 0.0 as speed, round(accel_s, 4) + 0.0 as accel_s, round(sqrt(ax * ax + ay * ay), 4) + 0.0 as accel_v from say")
def kinematics(spark, d):
    """Smoothed speed and accelerations of every object in the first period."""
    t = match_tracking(spark, d).where("period_id = 1").select("match_id", "frame_id", "period_id", F.coalesce("player_id", F.lit("ball")).alias("object_id"), "x", "y")
    k = sig.kinematics(t, ["match_id", "period_id", "object_id"])
    return k.select("match_id", "object_id", "frame_id", (F.round("speed", 5) + 0.0).alias("speed"), (F.round("accel_s", 4) + 0.0).alias("accel_s"), (F.round("accel_v", 4) + 0.0).alias("accel_v"))


@role(""", side as (select match_id, period_id, case when avg(mx) filter (where o[1:4] = 'home') < avg(mx) filter (where o[1:4] = 'away') then 'away' else 'home' end as turn from (select match_id, period_id, player_id as o, avg(x) as mx from tr where not ball group by all) group by all)
select match_id, event_idx, case when player_id[1:4] = turn then round((105 - value) * 100) / 100 else value end as start_x, case when player_id[1:4] = turn then round((68 - value * 0.5::double) * 100) / 100 else value * 0.5::double end as start_y from ev join side using (match_id, period_id)""".replace("round((", "round_even((").replace(") * 100) / 100", ") * 100, 0) / 100"))
def orientation_parquet(spark, d):
    """Events of the team that attacks leftwards turned round, by mean places."""
    e = match_events(spark, d).withColumns({"object_id": F.col("player_id"), "start_x": F.col("value"), "start_y": F.col("value") * 0.5})
    t = match_tracking(spark, d).where(~F.col("ball")).select("match_id", "period_id", F.col("player_id").alias("object_id"), "x")
    return parquet_provider.orient(e, t, "match_id").join(t.select("match_id", "period_id").distinct(), ["match_id", "period_id"], "left_semi").select("match_id", "event_idx", "start_x", "start_y")


@role(""", kp as (select match_id, period_id, avg(x) filter (where player_id = 'home_1') > avg(x) filter (where player_id = 'away_1') as turn from tr group by all)
select match_id, event_idx, case when turn then round_even((105 - value) * 100, 0) / 100 else value end as coordinates_x, case when turn then round_even((68 - value * 0.5::double) * 100, 0) / 100 else value * 0.5::double end as coordinates_y,
case when turn then round_even((105 - value * 0.25::double) * 100, 0) / 100 else value * 0.25::double end as end_coordinates_x, null::double as end_coordinates_y from ev left join kp using (match_id, period_id)""")
def orientation_xml(spark, d):
    """Both ends of events turned in periods in which the home keeper stands on the right."""
    e = match_events(spark, d).withColumns({"coordinates_x": F.col("value"), "coordinates_y": F.col("value") * 0.5, "end_coordinates_x": F.col("value") * 0.25, "end_coordinates_y": F.lit(None).cast("double")})
    k = match_tracking(spark, d).where(F.col("player_id").isin("home_1", "away_1")).select("match_id", "period_id", F.left("player_id", F.lit(4)).alias("home_away"), "x")
    return xml_provider.orient(e, k).select("match_id", "event_idx", "coordinates_x", "coordinates_y", "end_coordinates_x", "end_coordinates_y")


_ACTIONS = ["pass", "offside_pass", "free_kick", "corner", "goal_kick", "goal_attempt", "attempted_tackle", "ball_touch", "save", "claim", "punch", "keeper_pick-up", "keeper_sweeper", "throw_in", "take_on", "tackle", "interception", "clearance", "aerial", "ball_recovery", "dispossessed", "foul", "bad_touch", "shield"]
_ACT_SQL = "['" + "', '".join(_ACTIONS) + f"'][(event_id * 5) % {len(_ACTIONS)} + 1]"
_RAW = f"""with raw as (select user_id::varchar as m, event_id, ts, {_ACT_SQL} as a, event_id % 3 = 0 as c, event_id % 13 = 0 as pen, case when event_id % 2 = 0 then 'direct' end as fk, case when event_id % 5 = 0 then 0.25::double end as xg,
  case when event_id % 3 = 1 then 'goal_keeper' else 'mid' end as pos, value >= 40 as outcome, (event_id % 4)::varchar as p, case when event_id % 6 = 0 then 52.5 else value end::double as x, 34::double as y, (1 + (day(ts) > 15)::int)::bigint as period_id from events),
nx as (select *, lead(pos) over w as npos, lead(a) over w as na, lag(a) over w as pa, lag(p) over w as pp, lead(period_id) over w as np, lead(x) over w as nx, lead(period_id, 2) over w as np2, lead(x, 2) over w as nx2 from raw window w as (partition by m order by ts, event_id)),
ty as (select *, case when a in ('throw_in', 'take_on', 'tackle', 'interception', 'clearance', 'bad_touch', 'ball_recovery', 'dispossessed', 'foul') then a when a = 'keeper_sweeper' then case when npos = 'goal_keeper' then 'keeper_sweeper' else 'clearance' end
  when a = 'keeper_pick-up' then 'keeper_pick_up' when a = 'punch' then 'keeper_punch' when a = 'claim' then 'keeper_claim' when a = 'save' then case when pos = 'goal_keeper' then 'keeper_save' else 'shot_block' end when a = 'ball_touch' then 'bad_touch' when a = 'attempted_tackle' then 'tackle'
  when a = 'free_kick' and fk is not null and xg is not null then 'shot_freekick' when a = 'goal_attempt' then case when pen then 'shot_penalty' else 'shot' end when a = 'goal_kick' then 'goalkick' when a = 'corner' then case when c then 'corner_crossed' else 'corner_short' end
  when a = 'free_kick' and fk is not null then case when c then 'freekick_crossed' else 'freekick_short' end when a = 'free_kick' then 'foul' when contains(a, 'pass') then case when c then 'cross' else 'pass' end end as t from nx)"""


def raw_actions(spark, d) -> DataFrame:
    e = events(spark, d)
    return e.select(
        F.col("user_id").cast("string").alias(parquet_provider.MATCH), "event_id", F.col("ts").alias(parquet_provider.TIME), F.element_at(F.array(*[F.lit(a) for a in _ACTIONS]), F.expr(f"cast(event_id * 5 % {len(_ACTIONS)} as int) + 1")).alias("action_type"),
        F.expr("event_id % 3 = 0").alias("cross"), F.expr("event_id % 13 = 0").alias("penalty"), F.expr("case when event_id % 2 = 0 then 'direct' end").alias("free_kick_type"), F.expr("case when event_id % 5 = 0 then 0.25D end").alias("expected_goal"),
        F.expr("case when event_id % 3 = 1 then 'goal_keeper' else 'mid' end").alias("advanced_position"), (F.col("value") >= 40).alias("outcome"), F.expr("cast(event_id % 4 as string)").alias("player_id"), F.expr("case when event_id % 6 = 0 then 52.5D else value end").alias("start_x"),
        F.lit(34.0).alias("start_y"), F.expr("cast(1 + cast(day(ts) > 15 as int) as bigint)").alias("period_id"), F.col("ts").alias("utc_timestamp"),
    )


_TYPED = _RAW.replace("'free_kick' and fk is not null then case", "'free_kick' and fk is not null and not pen then case").replace("when a = 'free_kick' and fk is not null and xg is not null", "when a = 'free_kick' and fk is not null and xg is not null")
_TYPED = _TYPED.replace("and not pen then case when c then 'freekick_crossed'", "then case when c then 'freekick_crossed'")
_TYPED += """, ok as (select *, case when t in ('shot', 'shot_freekick', 'shot_penalty') then coalesce(np = period_id and nx between 49.5 and 55.5, false) or (t in ('shot', 'shot_freekick') and coalesce(na = 'attempted_tackle' and np2 = period_id and nx2 between 49.5 and 55.5, false))
  when a = 'attempted_tackle' or contains(a, '_pass') then false else outcome end as success, a = 'offside_pass' as offside, coalesce(pa = 'aerial' and pp = p, false) as aerial from ty)"""


@query(_TYPED + " select event_id, t as spadl_type, success, offside, aerial from ok")
def parquet_typing(spark, d):
    """Event types, success, offside and aerial of raw actions; neighbours within a match."""
    return parquet_provider.type_events(raw_actions(spark, d), order=("utc_timestamp", "event_id")).select("event_id", "spadl_type", "success", "offside", "aerial")


@query(_TYPED + """, f as (select * from ok where t is not null and not (t = 'tackle' and not success)),
q as (select *, lead(ts) over (partition by m order by ts) as nts, lead(p) over (partition by m order by ts) as np_, lead(period_id) over (partition by m order by ts) as npe from f)
select event_id, t as spadl_type from q where not coalesce(t in ('pass', 'cross', 'freekick_short', 'freekick_crossed', 'throw_in', 'goalkick', 'corner_short', 'corner_crossed') and epoch_us(nts) - epoch_us(ts) < 5000000 and np_ = p and npe = period_id, false)""")
def tackles_and_self_passes(spark, d):
    """Typed actions without failed tackles and passes to oneself."""
    e = parquet_provider.type_events(raw_actions(spark, d), order=("utc_timestamp", "event_id")).where("spadl_type is not null")
    return parquet_provider.drop_self_passes(parquet_provider.drop_failed_tackles(e)).select("event_id", "spadl_type")


@role(""", w as (select match_id, period_id, frame_id, max(x) filter (where player_id = 'home_1') as h from tr group by all)
select match_id, period_id, case when period_id = 1 then frame_id else frame_id + e end as frame_id, s + frame_id * 40000 as us from w join (select match_id, max(frame_id) + 1 as e from w where period_id = 1 group by 1) using (match_id)
join (select match_id, period_id, min(us) as s from ev group by all) using (match_id, period_id)""")
def tracking_clock(spark, d):
    """Frame numbers and times of raw tracking, from seconds in each period and the period's first event."""
    t = match_tracking(spark, d).where(F.col("player_id") == "home_1").select("match_id", "period_id", "timestamp")
    got = parquet_provider.tracking_clock(t, match_events(spark, d)).where("utc_timestamp is not null")
    return got.select("match_id", "period_id", "frame_id", since(times.micros(F.col("utc_timestamp"))).alias("us"))


def wide_tracking(spark, d) -> DataFrame:
    """One row a frame with a column for each object's place, and for its provider id."""
    t = match_tracking(spark, d).withColumn("o", F.coalesce("player_id", F.lit("ball")))
    names = ["ball", "home_1", "home_2", "away_1", "away_2"]
    w = t.groupBy("match_id", "period_id", "frame_id", "timestamp").pivot("o", names).agg(F.first("x").alias("x"), F.first("y").alias("y"))
    ids = {f"{n}_id": F.when(F.expr(f"frame_id % {i + 2} = 1 and cast(match_id as bigint) % {i + 3} <> 0"), F.concat(F.lit("p"), "match_id", F.lit(n))) for i, n in enumerate(names[1:])}
    return w.withColumns(ids)


_WIDE = """, w as (select match_id, period_id, frame_id, timestamp, u, max(x) filter (where ball) as ball_x, max(y) filter (where ball) as ball_y, max(x) filter (where player_id = 'home_1') as home_1_x, max(x) filter (where player_id = 'away_2') as away_2_x from tr group by all)"""


@role(_WIDE + """ select match_id, 'p' || match_id || o as player_id, o as object_id from (select distinct match_id, o from w, (values (0, 'home_1'), (1, 'home_2'), (2, 'away_1'), (3, 'away_2')) o(i, o) where frame_id % (i + 2) = 1 and u % (i + 3) <> 0)""")
def object_ids(spark, d):
    """Provider ids of players to object ids, by the first known id of each tracking column."""
    return parquet_provider.object_ids(wide_tracking(spark, d), "match_id").select("match_id", "player_id", "object_id")


@role(_WIDE + """, l as (select match_id, unnest([{'c': 'ball_x', 'a': min(frame_id) filter (where ball_x > 60), 'z': max(frame_id) filter (where ball_x > 60)}, {'c': 'home_1_x', 'a': min(frame_id) filter (where home_1_x < 40), 'z': max(frame_id) filter (where home_1_x < 40)},
  {'c': 'away_2_x', 'a': min(frame_id) filter (where away_2_x > 1000), 'z': max(frame_id) filter (where away_2_x > 1000)}]) as r from w group by match_id) select match_id, r.c as "column", r.a as "first", r.z as "last" from l where r.a is not null""")
def valid_ranges(spark, d):
    """First and last frame at which each column is known; columns that never are have no row."""
    w = wide_tracking(spark, d).withColumns({"ball_x": F.when(F.col("ball_x") > 60, F.col("ball_x")), "home_1_x": F.when(F.col("home_1_x") < 40, F.col("home_1_x")), "away_2_x": F.when(F.col("away_2_x") > 1000, F.col("away_2_x"))})
    return rel.valid_range(w, ["match_id"], "frame_id", ["ball_x", "home_1_x", "away_2_x"])


@query("""select user_id, u.c as "column", u.v as "value" from (select user_id, unnest([{'c': 'a', 'v': arg_min(event_type, (ts, event_id)) filter (where value > 90)}, {'c': 'b', 'v': arg_min(event_id, (ts, event_id)) filter (where event_type = 'error')::varchar}]) as u from events group by user_id) where u.v is not null""")
def first_known(spark, d):
    e = events(spark, d).withColumns({"a": F.when(F.col("value") > 90, F.col("event_type")), "b": F.when(F.col("event_type") == "error", F.col("event_id"))})
    return rel.first_valid(e.withColumn("at", F.struct("ts", "event_id")), ["user_id"], "at", ["a", "b"])


@query("select user_id, event_type, row_number() over (partition by user_id order by t, i) - 1 as place from (select user_id, event_type, min((ts, event_id))[1] as t, min((ts, event_id))[2] as i from events group by all)")
def by_appearance(spark, d):
    return rel.by_appearance(events(spark, d), ["user_id"], ["ts", "event_id"], "event_type")


@query("select event_id, rpad(event_type, (select max(length(event_type))::int from events), ' ') || ' | ' || rpad(coalesce(p, ''), (select max(length(coalesce(p, '')))::int from events2), ' ') as line from events2".replace("select event_id", "with events2 as (select *, case when event_id % 3 <> 0 then event_id::varchar end as p from events) select event_id", 1))
def padded_lines(spark, d):
    e = events(spark, d).withColumn("p", F.when(F.col("event_id") % 3 != 0, F.col("event_id")))
    return rel.padded_lines(e, ["event_type", "p"]).select("event_id", "line")


@role(" select match_id, frame_id, (frame_id - 100) // 75 as segment from fr where frame_id >= 100")
def frame_segments(spark, d):
    return rel.segments(syn.frame_dimension(match_tracking(spark, d)), "frame_id", 100, 75).select("match_id", "frame_id", "segment")


@query("with c as (select s_suppkey, s_nationkey as n_nationkey from supplier where s_suppkey % 3 = 0) select n_nationkey, n_name, s_suppkey from c right join nation using (n_nationkey)")
def right_natural_join(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    return rel.natural_join(s, table(spark, d, "nation").select("n_nationkey", "n_name"), "right")


@query("select event_id, value, null::varchar is null as dropped from events")
def drop_null_columns(spark, d):
    """A column that is null in every row goes; one that is null in some stays."""
    e = events(spark, d).select("event_id", "value", F.lit(None).cast("string").alias("nothing"))
    got = rel.drop_null_columns(e)
    return got.withColumn("dropped", F.lit("nothing" not in got.columns))


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("select event_id, user_id, event_type, round(value, 6) as value from events")
def csv_round_trip(spark, d):
    """Events written as CSV and read with their schema."""
    path = _folder(spark, "csv")
    events(spark, d).select("event_id", "user_id", "event_type", "value").write.option("header", True).csv(path)
    return files.read_csv(spark, path, "event_id long, user_id long, event_type string, value double", "*.csv").withColumn("value", F.round("value", 6))


@query("select user_id::varchar as match_id, event_id from events where user_id in (1, 7, 13)")
def partition_scan(spark, d):
    """Three matches of a table laid out by match; only their folders are read."""
    path = _folder(spark, "matches")
    events(spark, d).select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("match_id"), "event_id").repartition("match_id").write.partitionBy("match_id").parquet(path)
    return files.read_matches(spark, path, ["m1", "m7", "m13"]).select(F.expr("substring(match_id, 2)").alias("match_id"), "event_id")


@query("""with c as (select user_id, count(*) filter (where event_type = 'error') as unsynced from events group by user_id), k as (select user_id from c where unsynced <= 12)
select user_id::varchar as match_id, event_id from events join k using (user_id)""")
def gated_sink(spark, d):
    """Matches with few unmatched events are written; one that was written before and is not accepted now is gone."""
    path = _folder(spark, "gated")
    e = events(spark, d).select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("match_id"), "event_id", F.when(F.col("event_type") != "error", F.col("event_id")).alias("frame_id"))
    files.write_synced(e, path, limit=1 << 30)
    done = files.write_synced(e, path, limit=12)
    files.drop_output(done.where("not ok"), path)
    return spark.read.option("header", True).csv(path).select(F.expr("substring(match_id, 2)").alias("match_id"), F.col("event_id").cast("long").alias("event_id"))


@query("""select event_id, frame, epoch_us(timestamp '2024-01-01 12:00:00') + frame * 40000 as us, printf('%02d:%02d.%02d', c // 6000, (c // 100) % 60, c % 100) as clock, (ts::date - date '1970-01-01')::bigint as day, epoch_us(ts) - 7200000000 as zoned
from (select *, (event_id * 7919) % 150000 * 4 as c, (event_id * 7919) % 150000 as frame from events)""")
def clocks(spark, d):
    """Clock text to frame and back to times; dates; times with a zone."""
    e = events(spark, d).withColumn("c", F.col("event_id") * 7919 % 150000 * 4 / F.lit(100.0))
    frame = times.clock_to_frame(times.format_clock(F.col("c")))
    start = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    zoned = times.utc_from_zoned(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00")))
    return e.select("event_id", frame.alias("frame"), times.micros(times.utc_of_frame(frame, start)).alias("us"), times.display_clock(F.col("c")).alias("clock"), F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"), times.micros(zoned).alias("zoned"))


@query("select event_id, round_even(value * 100, 0) / 100 as timestamp, round_even(value * 100, 0) / 100 as ball_z, null as n from events".replace(", null as n", ""))
def scaled_units(spark, d):
    """Seconds in hundredths and centimetres to metres, halves to even."""
    return parquet_provider.scale(events(spark, d).select("event_id", F.col("value").alias("timestamp"), (F.col("value") * 100).alias("ball_z")))


@query("""with recursive f as (select user_id, row_number() over (partition by user_id order by ts, event_id) as i, value as v from events),
d as (select *, lead(v) over w - v as s1, v - lag(v) over w as s0, count(*) over (partition by user_id) as n from f window w as (partition by user_id order by i))
select user_id, i, round(25 * case when i < n then s1 else s0 end, 4) + 0.0 as rel_speed, round(25 * case when i = 1 then 0 else abs(25 * (case when i < n then s1 else s0 end - s0)) end, 3) + 0.0 as rel_accel from d where n > 1""")
def relative_motion(spark, d):
    """Speed of a distance to its next value (the last one carried) and the size of its change."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, d).withColumns({"i": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("user_id"))}).where("n > 1")
    speed = sig.relative_speed("value", w, 25)
    e = e.withColumn("s", speed)
    return e.select("user_id", "i", (F.round("s", 4) + 0.0).alias("rel_speed"), (F.round(sig.relative_accel("s", w, 25), 3) + 0.0).alias("rel_accel"))


_SYNC2 = _SYNCED + """, rc as (select e.match_id, e.event_idx, e.period_id, e.us, e.player_id, e.spadl_type, case when e.event_idx % 4 <> 3 then e.frame_id end as frame_id, case when e.event_idx % 3 = 0 then e.frame_id + 10 end as receive_frame_id, e.next_player_id as receiver_id, e.value, e.event_id from sy e)"""


def report_rows(spark, d) -> DataFrame:
    """Synced events some of which lack a frame, with receives ten frames on."""
    _, _, e = synced_roles(spark, d)
    return e.withColumn("f", F.col("frame_id")).withColumns({"frame_id": F.when(F.col("event_idx") % 4 != 3, F.col("f")), "receive_frame_id": F.when(F.col("event_idx") % 3 == 0, F.col("f") + 10), "receiver_id": F.col("next_player_id")}).drop("f")


@role(_SYNC2 + """, x as (select *, lead(frame_id) over w as nf, lead(event_idx) over w is null as la from rc window w as (partition by match_id order by event_idx)),
r as (select match_id, period_id, frame_id, player_id, spadl_type as event_type, event_idx::double as o from rc where frame_id is not null union all select match_id, period_id, receive_frame_id, receiver_id, 'receive', 1e18 from x where receive_frame_id is not null and (la or receive_frame_id < nf))
select match_id, period_id, frame_id, player_id, event_type from r qualify row_number() over (partition by match_id, frame_id order by o, player_id nulls first) = 1""")
def receive_rows(spark, d):
    """Synced events with the receives that come before the next event, one row a frame."""
    return report.with_receives(report_rows(spark, d))


_CASES = " ".join(f"when spadl_type = '{t}' then '{c}'" for t, c in report.CATEGORY.items())
_PASS_SQL = ", ".join(f"'{t}'" for t in syn.PASSES)


def _accuracy_sql(by: str) -> str:
    cols = "count(*) filter (where z = 0) as exact, count(*) filter (where abs(z) <= 5) as within_5, count(*) filter (where abs(z) <= 25) as within_25, count(*) filter (where abs(z) <= 50) as within_50, count(got) as valid"
    one = f"{by} count(*) filter (where counts) as total, sum(abs(z)) as s, count(z) as n, {cols}"
    group = f"group by {by.rstrip(' ,')}" if by else ""
    rows = f"""select {by} 'event_start' as side, case {_CASES} end as cat, true as counts, frame_id - tf as z, frame_id as got from a union all select {by} 'event_end', 'event_end', spadl_type in ({_PASS_SQL}), receive_frame_id - tr_, receive_frame_id from a"""
    return f""", q as ({rows}), s as (select cat as category, false as t, {one} from q where side = 'event_start' group by {by} cat union all select side, false, {one} from q group by {by} side union all select 'total', true, {one} from q {group})
select {by} category, total, round(case when t then s / total else s / n end, 6) as mean_diff, exact, within_5, within_25, within_50, valid, round(exact / total, 6) as exact_rate, round(within_5 / total, 6) as within_5_rate, round(within_25 / total, 6) as within_25_rate, round(within_50 / total, 6) as within_50_rate, round(valid / total, 6) as valid_rate from s"""


def truths(df: DataFrame) -> DataFrame:
    shift = F.expr("event_id % 61 - 30")
    return df.withColumns({"true_frame": F.col("frame_id") + F.when(F.col("event_id") % 5 != 0, shift).otherwise(0), "true_receive": F.col("receive_frame_id") + shift})


_TRUTH = ", a as (select *, frame_id + case when event_id % 5 <> 0 then event_id % 61 - 30 else 0 end as tf, receive_frame_id + event_id % 61 - 30 as tr_{} from rc)"


@role(_SYNC2 + _TRUTH.format("") + _accuracy_sql(""))
def accuracy_of_sync(spark, d):
    """The report by category, over all starts, all ends and in total."""
    return report.accuracy_report(truths(report_rows(spark, d)))


@role(_SYNC2 + ", m as (select *, 'a' as method from rc union all select * replace (frame_id + 3 as frame_id), 'b' from rc)" + _TRUTH.format("").replace("from rc", "from m").replace("frame_id + case", "case when method = 'b' then frame_id - 3 else frame_id end + case") + _accuracy_sql("method, "))
def accuracy_by_method(spark, d):
    """The report of two synchronisers, one three frames late."""
    a = truths(report_rows(spark, d))
    return report.accuracy_by_method({"a": a, "b": a.withColumn("frame_id", F.col("frame_id") + 3)})


@role(_SYNC2 + _WIDE.replace("with ", "") + """, c as (select match_id, period_id, frame_id * 4 as t, player_id, spadl_type as event_type from rc where frame_id is not null),
an as (select match_id, period_id, round_even(round_even((us - min(us) over (partition by match_id, period_id)) / 1e6 * 25, 0) / 25 * 100, 0)::bigint as t, value as annot_x, value * 0.5::double as annot_y from rc),
m as (select w.match_id, w.frame_id, c.player_id, event_type, case when c.player_id is not null then ball_x end as event_x, case when c.player_id is not null then ball_y end as event_y, annot_x, annot_y
  from w left join c on c.match_id = w.match_id and c.period_id = w.period_id and c.t = w.frame_id * 4 left join an on an.match_id = w.match_id and an.period_id = w.period_id and an.t = w.frame_id * 4)
select match_id, frame_id, player_id, event_type, event_x, event_y, annot_x, annot_y from m""")
def merge_synced(spark, d):
    """Wide frames with synced events at the ball and annotated places at their own time."""
    e = report_rows(spark, d).withColumns({"synced_ts": times.format_clock(F.col("frame_id") / 25), "start_x": F.col("value"), "start_y": F.col("value") * 0.5})
    return report.merge_synced(e, wide_tracking(spark, d)).select("match_id", "frame_id", "player_id", "event_type", "event_x", "event_y", "annot_x", "annot_y")


@role(_WIDE + """, s as (select *, row_number() over (partition by match_id order by frame_id) - 1 as i from w) select match_id, frame_id, (frame_id - 30) // 200 as segment, 105 - ball_x as ball_x, 68 - ball_y as ball_y,
printf('%02d:%02d.%02d', (frame_id * 4) // 6000, ((frame_id * 4) // 100) % 60, (frame_id * 4) % 100) as clock from s where i % 5 = 0 and frame_id >= 30""")
def frame_table(spark, d):
    """Every fifth frame from the thirtieth on, with segment, clock and a turned pitch; a column that is never known goes."""
    w = wide_tracking(spark, d).select("match_id", "frame_id", "timestamp", "ball_x", "ball_y", F.lit(None).cast("double").alias("none_x"))
    return report.frame_table(w, step=5, start=30, segment=200, rotate=True).select("match_id", "frame_id", "segment", "ball_x", "ball_y", "clock")


@role(""" select match_id, p as object, row_number() over (partition by match_id, p[1:4] order by p) as number from (select distinct match_id, player_id as p from tr where not ball)""")
def player_numbers(spark, d):
    o = match_tracking(spark, d).where(~F.col("ball")).select("match_id", F.col("player_id").alias("object")).distinct()
    return report.player_numbers(o)


@query("select n_name, case when n_regionkey = 1 then 'b' when n_nationkey < 10 then 'a' else 'c' end as g from nation")
def map_union(spark, d):
    """Two dictionaries united; the later one wins."""
    n = table(spark, d, "nation")
    a = F.create_map(*[F.lit(x) for k in range(25) for x in (k, "a" if k < 10 else "c")])
    b = F.when(F.col("n_regionkey") == 1, F.create_map(F.col("n_nationkey"), F.lit("b"))).otherwise(F.create_map().cast("map<int,string>"))
    both = F.map_concat(F.map_filter(a.cast("map<int,string>"), lambda k, _: ~F.map_contains_key(b, k)), b)
    return n.select("n_name", F.element_at(both, F.col("n_nationkey")).alias("g"))


@role(_SYNC2 + """, an as (select *, case when event_idx % 5 = 4 then 'missing' when event_idx % 7 = 3 then 'false_positive' end as et from rc where period_id = 1 and frame_id is not null and spadl_type <> 'shot_block'),
k as (select *, case when coalesce(et <> 'missing', true) then row_number() over (partition by match_id, coalesce(et <> 'missing', true) order by event_idx) - 1 end as k from an),
re as (select match_id, us, value, row_number() over (partition by match_id order by event_idx) - 1 as k from ev)
select k.match_id, k.event_idx as "row", case when k.spadl_type = 'bad_touch' then 'bad_touch' else k.spadl_type end as spadl_type, k.frame_id as frame, case when k.k is null then k.frame_id * 40000 else re.us end as us, case when k.k is null then b.x else re.value end as start_x
from k left join re on re.match_id = k.match_id and re.k = k.k left join tr b on b.match_id = k.match_id and b.frame_id = k.frame_id and b.ball""")
def align_annotations(spark, d):
    """Cleaned annotations with the recorded events' times and places by rank; missing ones at their frame and the ball."""
    kind = F.when(F.col("spadl_type") == "shot_block", "shield_ball_oop").when(F.col("spadl_type") == "bad_touch", "ball_touch").otherwise(F.col("spadl_type"))
    a = report_rows(spark, d).where("frame_id is not null").select(
        "match_id", "period_id", F.col("event_idx").alias("row"), kind.alias("spadl_type"), F.when(F.col("event_idx") % 5 == 4, "missing").when(F.col("event_idx") % 7 == 3, "false_positive").alias("error_type"),
        times.format_clock(F.col("frame_id") / 25).alias("synced_ts"), F.lit(None).cast("string").alias("receive_ts"),
    )
    e = match_events(spark, d).withColumns({"start_x": F.col("value"), "start_y": F.col("value") * 0.5})
    ball = match_tracking(spark, d).where("ball")
    got = report.align_annotations(report.clean_annotations(a), e, ball, F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"))
    return got.select("match_id", "row", "spadl_type", "frame", since(times.micros(F.col("utc_timestamp"))).alias("us"), "start_x")


@role(_WIDE + """ select match_id, r.o as object_id, frame_id, round(r.x, 6) as x, 'alive' as ball_state from (select match_id, frame_id, unnest([{'o': 'ball', 'x': ball_x}, {'o': 'home_1', 'x': home_1_x}]) as r from w where frame_id % 9 < 6)""")
def live_frames(spark, d):
    """Wide frames made long, with derivatives over all frames, and then only the live ones."""
    w = wide_tracking(spark, d).select("match_id", "period_id", "frame_id", "timestamp", utc(F.col("frame_id") * 40000).alias("utc_timestamp"), F.when(F.col("frame_id") % 9 < 6, "alive").otherwise("dead").alias("ball_state"), "ball_x", "ball_y", "home_1_x", "home_1_y")
    t = parquet_provider.long_tracking(w)
    return t.select("match_id", F.coalesce("player_id", F.lit("ball")).alias("object_id"), "frame_id", F.round("x", 6).alias("x"), F.lit("alive").alias("ball_state"))


#: XML of an event by kind; {p}, {t}, {r} stand for player, team and recipient
_XML = [
    '<Play Player="{p}" Team="{t}" Recipient="{r}" Evaluation="successfullyCompleted"><Pass/></Play>', '<Play Player="{p}" Team="{t}" Recipient="{r}" Evaluation="unsuccessful"><Cross/></Play>', '<ShotAtGoal Player="{p}" Team="{t}" TypeOfShot="head"><SavedShot GoalKeeper="{r}"/></ShotAtGoal>',
    '<ShotAtGoal Player="{p}" Team="{t}" TypeOfShot="leg"><SuccessfulShot/></ShotAtGoal>', '<ThrowIn Team="{t}"><Play Player="{p}" Team="{t}" Recipient="{r}" Evaluation="successfullyCompleted"><Pass/></Play></ThrowIn>', '<CornerKick Team="{t}"><Play Player="{p}" Team="{t}" Recipient="{r}" Evaluation="unsuccessful"><Cross/></Play></CornerKick>',
    '<OtherBallAction DefensiveClearance="true" Player="{p}" Team="{t}"/>', '<BallClaiming Type="InterceptedBall" Player="{p}" Team="{t}"/>', '<BallClaiming Type="BallClaimed" Player="{p}" Team="{t}"/>', '<Foul Fouler="{p}" TeamFouler="{t}" Fouled="{r}" FoulType="x"/>', '<TacklingGame Type="air" Winner="{p}" WinnerTeam="{t}" Loser="{r}"/>',
    '<Penalty Team="{t}"><ShotAtGoal Player="{p}" Team="{t}"><ShotWide/></ShotAtGoal></Penalty>', '<Caution Player="{p}" Team="{t}" CardColor="yellow"/>', "<Delete/>",
]


def _write_xml(rows: DataFrame, path: str) -> None:
    """A document for each m, of the elements in ``value``, in a folder of its own."""
    whole = rows.groupBy("m").agg(F.concat(F.lit("<R>"), F.array_join(F.collect_list("value"), ""), F.lit("</R>")).alias("value"))
    whole.repartition("m").write.partitionBy("m").text(path)


def _xml_events(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, d).withColumns({"i": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("user_id"))})
    e = e.withColumns({"p": F.concat(F.lit("P"), F.expr("cast(event_id % 4 as string)")), "t": F.concat(F.lit("T"), F.expr("cast(event_id % 2 as string)")), "r": F.concat(F.lit("P"), F.expr("cast((event_id + 1) % 4 as string)"))})
    kind = F.element_at(F.array(*[F.lit(x) for x in _XML]), F.expr(f"cast(event_id * 3 % {len(_XML)} as int) + 1"))
    kind = F.when(F.col("i") == 1, '<KickOff GameSection="firstHalf"><Play Player="{p}" Team="{t}" Recipient="{r}" Evaluation="successfullyCompleted"><Pass/></Play></KickOff>').when(F.col("i") == F.col("n"), '<FinalWhistle GameSection="firstHalf"/>').otherwise(kind)
    for k in "ptr":
        kind = F.replace(kind, F.lit("{" + k + "}"), F.col(k))
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")
    x = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.format_string("%.2f", "value"))
    line = F.concat(F.lit('<Event EventId="'), F.col("event_id").cast("string"), F.lit('" EventTime="'), time, F.lit('" X-Position="'), x, F.lit('" Y-Source-Position="'), F.format_string("%.2f", "value"), F.lit('">'), kind, F.lit("</Event>"))
    path = _folder(spark, "xml")
    _write_xml(e.select(F.col("user_id").alias("m"), line.alias("value")), path)
    return xml_provider.read_events(spark, path, r"/m=([^/]+)/")


_XML_SQL = f"""with e as (select *, row_number() over w as i, count(*) over (partition by user_id) as n, (event_id * 3) % {len(_XML)} as k, date_trunc('milliseconds', ts) as t from events window w as (partition by user_id order by ts, event_id)),
r as (select user_id::varchar as match_id, event_id::varchar as event_id, t, i, case when i = 1 then 0 when i = n then 99 else k end as kind, 'P' || event_id % 4 as player_id, 'T' || event_id % 2 as team_id, 'P' || (event_id + 1) % 4 as rc, case when event_id % 5 <> 0 then round(value, 2) end as x, round(value, 2) as y from e where i = 1 or i = n or k <> 13),
v as (select match_id, event_id, t, kind, i = 1 as kick, 1::bigint as period_id, case when kind in (0, 4) then 'Pass' when kind in (1, 5) then 'Cross' when kind in (2, 3, 11) then 'Shot' when kind = 6 then 'Clearance' when kind = 7 then 'Interception' when kind = 8 then 'Recovery' when kind = 9 then 'Foul' when kind = 10 then 'AerialDuel' when kind = 12 then 'Card' else 'FinalWhistle' end as event_type,
  case when kind <> 99 then player_id end as player_id, case when kind <> 99 then team_id end as team_id, case when kind in (0, 1, 2, 4, 5, 9, 10) then rc end as receiver_player_id, case when i = 1 then 'KickOff' when kind = 4 then 'ThrowIn' when kind = 5 then 'CornerKick' when kind = 11 then 'Penalty' end as set_piece_type,
  case when kind in (0, 3, 4, 10) then true when kind in (1, 2, 5, 11) then false end as success, x, y from r)"""


@query(_XML_SQL + " select match_id, event_id, period_id, event_type, player_id, team_id, receiver_player_id, set_piece_type, success, x as coordinates_x, y as coordinates_y from v")
def xml_events(spark, d):
    """Events written as XML, a file a match, and read by the provider."""
    return _xml_events(spark, d).select("match_id", "event_id", "period_id", "event_type", "player_id", "team_id", "receiver_player_id", "set_piece_type", "success", "coordinates_x", "coordinates_y")


@query(_XML_SQL + """, s as (select *, case when kind = 0 then 'pass' when kind = 1 then 'cross' when kind in (2, 3) then 'shot' when kind = 4 then 'throw_in' when kind = 5 then 'corner_crossed' when kind = 6 then 'clearance' when kind = 7 then 'interception' when kind = 8 then 'ball_recovery' when kind = 9 then 'foul' when kind = 11 then 'shot_penalty' end as spadl_type from v)
select event_id, spadl_type, case when kind in (7, 8) then true when kind = 9 then false when kind = 6 then coalesce(lead(team_id) over w = team_id, false) else coalesce(success, false) end as success from s where spadl_type is not null window w as (partition by match_id order by t, event_id)""")
def xml_typing(spark, d):
    """Types and success of events read from XML."""
    return xml_provider.type_events(_xml_events(spark, d)).select("event_id", "spadl_type", "success")


_CODES = ", ".join(f"('{k}', '{v}')" for k, v in xml_provider.POSITIONS.items())
_CODE_SQL = "['" + "', '".join([*xml_provider.POSITIONS, "ZZ"]) + f"'][s_suppkey % {len(xml_provider.POSITIONS) + 1} + 1]"


@query(f"""select n_name as team_name, case when n_nationkey % 2 = 1 then 'away' else 'home' end as home_away, 'S' || s_suppkey as player_id, s_suppkey::int as uniform_number, c.v as position, (case when n_nationkey % 2 = 1 then 'away_' else 'home_' end) || s_suppkey as object_id, s_suppkey % 3 = 0 as starting
from supplier join nation on s_nationkey = n_nationkey left join (values {_CODES}) c(k, v) on c.k = {_CODE_SQL}""")
def xml_lineup(spark, d):
    """Lineups written as nested XML and read by the provider, position codes translated."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    code = F.element_at(F.array(*[F.lit(c) for c in [*xml_provider.POSITIONS, "ZZ"]]), F.expr(f"cast(s_suppkey % {len(xml_provider.POSITIONS) + 1} as int) + 1"))
    num = F.col("s_suppkey").cast("string")
    player = F.concat(F.lit('<Player PersonId="S'), num, F.lit('" ShirtNumber="'), num, F.lit('" Shortname="x" Starting="'), F.expr("cast(s_suppkey % 3 = 0 as string)"), F.lit('" PlayingPosition="'), code, F.lit('" TeamLeader="false"/>'))
    team = s.groupBy("n_nationkey", "n_name").agg(F.array_join(F.collect_list(player), "").alias("ps"))
    line = F.concat(F.lit('<Team TeamId="'), F.col("n_nationkey").cast("string"), F.lit('" TeamName="'), F.col("n_name"), F.lit('" Role="'), F.when(F.col("n_nationkey") % 2 == 1, "guest").otherwise("home"), F.lit('"><Players>'), F.col("ps"), F.lit("</Players></Team>"))
    path = _folder(spark, "lineup")
    _write_xml(team.select(F.lit(1).alias("m"), line.alias("value")), path)
    return xml_provider.read_lineup(spark, path).select("team_name", "home_away", "player_id", "uniform_number", "position", "object_id", "starting")


@role(""" select match_id, period_id, coalesce(player_id, 'BALL') as person_id, frame_id, x, y, z, case when frame_id % 9 < 6 then 'alive' else 'dead' end as ball_state, round((frame_id - min(frame_id) over (partition by match_id, period_id)) / 25.0::double, 6) as timestamp from tr where ball or player_id = 'away_2'""")
def xml_tracking(spark, d):
    """Frame sets written as XML and read by the provider."""
    t = match_tracking(spark, d).where(F.col("ball") | (F.col("player_id") == "away_2")).withColumn("o", F.coalesce("player_id", F.lit("BALL")))
    n = F.col("frame_id").cast("string")
    z = F.when(F.col("z").isNull(), "").otherwise(F.concat(F.lit('" Z="'), F.col("z").cast("string")))
    frame = F.concat(F.lit('<Frame N="'), n, F.lit('" X="'), (F.col("x") - 52.5).cast("string"), F.lit('" Y="'), (F.col("y") - 34).cast("string"), z, F.lit('" BallStatus="'), F.when(F.col("frame_id") % 9 < 6, "1").otherwise("0"), F.lit('"/>'))
    sets = t.groupBy("match_id", "period_id", "o").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_id", frame.alias("f")))), lambda s: s["f"]), "").alias("fs"))
    half = F.when(F.col("period_id") == 1, "firstHalf").otherwise("secondHalf")
    line = F.concat(F.lit('<FrameSet GameSection="'), half, F.lit('" TeamId="'), F.col("o"), F.lit('" PersonId="'), F.col("o"), F.lit('">'), F.col("fs"), F.lit("</FrameSet>"))
    path = _folder(spark, "frames")
    _write_xml(sets.select(F.col("match_id").alias("m"), line.alias("value")), path)
    got = xml_provider.read_tracking(spark, path, r"/m=([^/]+)/")
    return got.select("match_id", "period_id", "person_id", "frame_id", "x", "y", "z", "ball_state", F.round("timestamp", 6).alias("timestamp"))


@query()
def sync_full(spark, d):
    """The whole synchroniser on the match tables; its folds have no SQL, its steps above have."""
    s = syn.synchronise(match_events(spark, d).drop("event_id", "value"), match_tracking(spark, d))
    return s.select("match_id", "event_idx", "frame_id", "synced_ts", "receiver_id", "receive_frame_id", "receive_ts")

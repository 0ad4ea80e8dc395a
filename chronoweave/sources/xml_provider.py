"""Provider that delivers XML: lineups, events and tracking, read by Spark's XML source.

Elements become structs and attributes fields with a leading underscore; an element is
present where its field is not null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .typing_rules import rules
from ..deploy import ship
from ..functions import times
from ..operators.signal import kinematics

# fixed values: position codes of the provider
POSITIONS = {
    "TW": "GK",
    "IVR": "RCB",
    "IVL": "LCB",
    "IVZ": "CB",
    "RV": "RB",
    "LV": "LB",
    "DMR": "RDM",
    "DRM": "RDM",
    "DML": "LDM",
    "DLM": "LDM",
    "DMZ": "CDM",
    "HR": "RCM",
    "HL": "LCM",
    "MZ": "CM",
    "RM": "RM",
    "LM": "LM",
    "ORM": "RAM",
    "OLM": "LAM",
    "ZO": "CAM",
    "RA": "RWF",
    "LA": "LWF",
    "STR": "RCF",
    "STL": "LCF",
    "STZ": "CF",
}

PLAYER = "struct<_PersonId:string,_ShirtNumber:int,_Shortname:string,_Starting:string,_PlayingPosition:string,_TeamLeader:string>"
LINEUP_SCHEMA = f"_TeamId string, _TeamName string, _Role string, Players struct<Player:array<{PLAYER}>>"
_PASS = "struct<_VALUE:string>"
_SHOT = "struct<_Player:string,_Team:string,_TypeOfShot:string,SuccessfulShot:struct<_Goal:string>,SavedShot:struct<_GoalKeeper:string>,BlockedShot:struct<_Player:string>,ShotWide:struct<_Placing:string>,ShotWoodWork:struct<_Location:string>,OtherShot:struct<_VALUE:string>>"
_PLAY = f"struct<_Player:string,_Team:string,_Recipient:string,_Evaluation:string,Pass:{_PASS},Cross:{_PASS}>"
_SET = f"struct<_Team:string,_GameSection:string,Play:{_PLAY},ShotAtGoal:{_SHOT}>"
EVENT_SCHEMA = (
    "_EventId string, _EventTime string, `_X-Position` string, `_Y-Position` string, `_X-Source-Position` string, `_Y-Source-Position` string, `_End-X-Position` string, `_End-Y-Position` string, "
    f"Delete struct<_VALUE:string>, Play {_PLAY}, ShotAtGoal {_SHOT}, KickOff {_SET}, FinalWhistle {_SET}, ThrowIn {_SET}, GoalKick {_SET}, CornerKick {_SET}, FreeKick {_SET}, Penalty {_SET}, "
    "TacklingGame struct<_Type:string,_Winner:string,_WinnerTeam:string,_Loser:string,_LoserTeam:string,_PossessionChange:string>, BallClaiming struct<_Type:string,_Player:string,_Team:string>, "
    "OtherBallAction struct<_DefensiveClearance:string,_Player:string,_Team:string>, Foul struct<_Fouler:string,_TeamFouler:string,_Fouled:string,_FoulType:string>, Caution struct<_Player:string,_Team:string,_CardColor:string>, "
    "Substitution struct<_PlayerOut:string,_PlayerIn:string,_Team:string>"
)
SET_PIECES = ["ThrowIn", "GoalKick", "CornerKick", "FreeKick", "Penalty"]


#: the match in a file's path: what follows the last '_' or '/' and ends before the suffix
MATCH_OF = r"([^/_]+)\.[^./]*$"


def match_column(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("match_id")


def read_lineup(spark: SparkSession, path: str, match_of: str = MATCH_OF) -> DataFrame:
    """match_id, team_id, home_away, player_id, uniform_number, player_name, starting, captain, position, object_id."""
    t = spark.read.format("xml").option("rowTag", "Team").schema(LINEUP_SCHEMA).load(path).select("*", match_column(match_of))
    side = F.when(F.col("_Role") == "guest", "away").otherwise("home")
    p = t.select("match_id", F.col("_TeamId").alias("team_id"), F.col("_TeamName").alias("team_name"), side.alias("home_away"), F.explode("Players.Player").alias("p"))
    codes = F.create_map(*[F.lit(x) for kv in POSITIONS.items() for x in kv])
    return p.select(
        "match_id", "team_id", "team_name", "home_away", F.col("p._PersonId").alias("player_id"), F.col("p._ShirtNumber").alias("uniform_number"), F.col("p._Shortname").alias("player_name"), (F.col("p._Starting") == "true").alias("starting"),
        (F.col("p._TeamLeader") == "true").alias("captain"), F.try_element_at(codes, F.col("p._PlayingPosition")).alias("position"), F.concat_ws("_", "home_away", F.col("p._ShirtNumber").cast("string")).alias("object_id"),
    )


def number(text: Column, other: Column | None = None) -> Column:
    """A number or null; the empty string is null, and ``other`` stands in for a missing one."""
    x = F.nullif(text, F.lit(""))
    return (x if other is None else F.coalesce(x, F.nullif(other, F.lit("")))).try_cast("double")


def _play(play: Column, shot: Column) -> Column:
    kinds = [("SuccessfulShot", "SuccessfulShot"), ("SavedShot", "SavedShot"), ("BlockedShot", "BlockedShot"), ("ShotWide", "ShotWide"), ("ShotWoodWork", "ShotWoodWork"), ("OtherShot", "OtherShot")]
    result = None
    for f, name in kinds:
        result = F.when(shot[f].isNotNull(), name) if result is None else result.when(shot[f].isNotNull(), name)
    return F.when(
        play.isNotNull(),
        F.struct(
            F.when(play["Cross"].isNotNull(), "Cross").when(play["Pass"].isNotNull(), "Pass").otherwise("Play").alias("event_type"), play["_Team"].alias("team_id"), play["_Player"].alias("player_id"), play["_Recipient"].alias("receiver_player_id"),
            play["_Evaluation"].alias("result"), F.coalesce(play["_Evaluation"] == "successfullyCompleted", F.lit(False)).alias("success"), F.lit(None).cast("string").alias("body_part_type"),
        ),
    ).when(
        shot.isNotNull(),
        F.struct(
            F.lit("Shot").alias("event_type"), shot["_Team"].alias("team_id"), shot["_Player"].alias("player_id"), F.coalesce(shot["SavedShot"]["_GoalKeeper"], shot["BlockedShot"]["_Player"]).alias("receiver_player_id"),
            result.alias("result"), shot["SuccessfulShot"].isNotNull().alias("success"), shot["_TypeOfShot"].alias("body_part_type"),
        ),
    )


def read_events(spark: SparkSession, path: str, match_of: str = MATCH_OF) -> DataFrame:
    """One row an event with its match, provider type, players, places, result and period."""
    e = spark.read.format("xml").option("rowTag", "Event").schema(EVENT_SCHEMA).load(path).select("*", match_column(match_of)).where(F.col("Delete").isNull())
    c = F.col
    none = F.lit(None).cast("string")
    fields = ["event_type", "team_id", "player_id", "receiver_player_id", "result", "success", "body_part_type"]

    def row(kind, team=none, player=none, receiver=none, result=none, success=None) -> Column:
        ok = F.lit(None).cast("boolean") if success is None else success
        return F.struct(*[x.alias(n) for n, x in zip(fields, (kind, team, player, receiver, result, ok, none), strict=True)])

    case = F.when(c("Play").isNotNull() | c("ShotAtGoal").isNotNull(), _play(c("Play"), c("ShotAtGoal")))
    for tag in ["KickOff", *SET_PIECES]:
        case = case.when(c(tag).isNotNull(), F.coalesce(_play(c(f"{tag}.Play"), c(f"{tag}.ShotAtGoal")), row(F.lit(None).cast("string"), c(f"{tag}._Team"))))
    air = F.when(c("TacklingGame._Type") == "air", "AerialDuel").otherwise("GroundDuel")
    case = (
        case.when(c("FinalWhistle").isNotNull(), row(F.lit("FinalWhistle")))
        .when(c("TacklingGame").isNotNull(), row(air, c("TacklingGame._WinnerTeam"), c("TacklingGame._Winner"), c("TacklingGame._Loser"), c("TacklingGame._PossessionChange"), F.lit(True)))
        .when(c("BallClaiming").isNotNull(), row(F.when(c("BallClaiming._Type") == "InterceptedBall", "Interception").when(c("BallClaiming._Type") == "BallClaimed", "Recovery").otherwise("BallClaiming"), c("BallClaiming._Team"), c("BallClaiming._Player")))
        .when(c("OtherBallAction").isNotNull(), row(F.when(c("OtherBallAction._DefensiveClearance") == "true", "Clearance").otherwise("OtherBallAction"), c("OtherBallAction._Team"), c("OtherBallAction._Player")))
        .when(c("Foul").isNotNull(), row(F.lit("Foul"), c("Foul._TeamFouler"), c("Foul._Fouler"), c("Foul._Fouled"), c("Foul._FoulType")))
        .when(c("Caution").isNotNull(), row(F.lit("Card"), c("Caution._Team"), c("Caution._Player"), none, c("Caution._CardColor")))
        .when(c("Substitution").isNotNull(), row(F.lit("Substitution"), c("Substitution._Team"), c("Substitution._PlayerOut"), c("Substitution._PlayerIn")))
    )
    piece = None
    for tag in ["KickOff", *SET_PIECES]:
        piece = F.when(c(tag).isNotNull(), tag) if piece is None else piece.when(c(tag).isNotNull(), tag)
    section = F.coalesce(c("KickOff._GameSection"), c("FinalWhistle._GameSection"))
    out = e.select(
        "match_id", c("_EventId").alias("event_id"), times.utc_from_zoned(c("_EventTime")).alias("utc_timestamp"), F.when(section == "firstHalf", 1).when(section == "secondHalf", 2).alias("marker"), c("FinalWhistle").isNotNull().alias("whistle"),
        number(c("_X-Position"), c("_X-Source-Position")).alias("coordinates_x"), number(c("_Y-Position"), c("_Y-Source-Position")).alias("coordinates_y"), number(c("_End-X-Position")).alias("end_coordinates_x"), number(c("_End-Y-Position")).alias("end_coordinates_y"),
        piece.alias("set_piece_type"), case.alias("p"),
    )
    return assign_periods(out.select("*", "p.*").drop("p"))


def assign_periods(events: DataFrame) -> DataFrame:
    """period_id from the first kickoff marker to the last final whistle of each period of the match."""
    at = lambda whistle: F.col("utc_timestamp") if whistle is None else F.when(F.col("whistle") == whistle, F.col("utc_timestamp"))
    marks = events.where("marker is not null").groupBy("match_id", F.col("marker").alias("__p")).agg(F.min(at(False)).alias("__a"), F.max(at(True)).alias("__z"))  # two rows a match
    marks = marks.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(F.col("__p").alias("p"), F.col("__a").alias("a"), F.col("__z").alias("z")))).alias("__marks"))
    j = events.join(marks, "match_id", "left")
    inside = F.filter("__marks", lambda m: (F.col("utc_timestamp") >= m["a"]) & (m["z"].isNull() | (F.col("utc_timestamp") <= m["z"])))
    return j.withColumn("period_id", F.get(inside, F.lit(0))["p"].cast("long")).drop("__marks", "marker", "whistle")


def static_types(event_type: Column, piece: Column) -> Column:
    """Types that need no neighbours."""
    t, p = event_type, piece
    table = {
        ("Pass", None): "pass", ("Pass", "ThrowIn"): "throw_in", ("Pass", "GoalKick"): "goalkick", ("Pass", "CornerKick"): "corner_short", ("Pass", "FreeKick"): "freekick_short",
        ("Cross", None): "cross", ("Cross", "CornerKick"): "corner_crossed", ("Cross", "FreeKick"): "freekick_crossed", ("Shot", None): "shot", ("Shot", "FreeKick"): "shot_freekick", ("Shot", "Penalty"): "shot_penalty",
    }
    ordered = [((t == a) & ((p == b) if b else F.lit(True)), v) for (a, b), v in table.items()]
    ordered += [(t == a, v) for a, v in (("Interception", "interception"), ("Recovery", "ball_recovery"), ("Clearance", "clearance"), ("Foul", "foul"))]
    return rules(ordered)


def other_action(rows: list[dict], i: int, spadl: list) -> dict[int, str]:
    """New types by row for an OtherBallAction at i, given the types set so far."""
    me, out = rows[i], {}
    who, team = me["player_id"], me["team_id"]
    at = lambda k: rows[k] if 0 <= k < len(rows) else None
    kind = lambda r: (r or {}).get("event_type") or ""
    recent = me["recent"]
    r = at(recent) if recent is not None else None
    header = any(kind(x) == "AerialDuel" and x["player_id"] == who for x in (at(i - 1), at(i + 1)))
    lost = r is not None and not r["success"]
    if r is not None and r["receiver_player_id"] == who and lost:
        if kind(r) in ("Pass", "Cross"):
            return {i: "clearance" if header else "interception"}
        if kind(r) == "Shot":
            return {i: "shot_block"}
    if kind(r) == "Clearance":
        out[i] = "ball_recovery"
    turned = recent is not None and spadl[recent] in ("interception", "clearance")
    after, before = at(i + 1), at(i - 1)
    if kind(after) == "GroundDuel":
        won, gone = after["player_id"] == who, after["receiver_player_id"] == who
        if won and kind(before) == "OtherBallAction" and before["player_id"] == after["receiver_player_id"]:
            return out | {i - 1: "dispossessed", i: "tackle"}
        if won and r is not None and r["team_id"] != team:
            return out | {i: "interception" if turned else "tackle"}
        if gone:
            out[i] = "dispossessed"
            if kind(before) == "OtherBallAction" and before["player_id"] == after["player_id"]:
                out[i - 1] = "tackle"
            return out
    if kind(before) == "GroundDuel" and who in (before["player_id"], before["receiver_player_id"]):
        return out | {i: "interception" if turned else "tackle"}
    near = [at(k) for k in range(i - 1, i + 3)]
    duel = any(kind(x) == "GroundDuel" and who in (x["player_id"], x["receiver_player_id"]) for x in near)
    if not duel and after is not None and after["player_id"] != who:
        out[i] = "bad_touch"
    return out


def type_events(events: DataFrame) -> DataFrame:
    """spadl_type and success; OtherBallAction rows are typed in order, a match at a time, as each reads types set before it."""
    ship(events.sparkSession)
    e = events.withColumn("spadl_type", static_types(F.col("event_type"), F.col("set_piece_type")))
    cols = ["match_id", "event_id", "event_type", "player_id", "team_id", "receiver_player_id", "success", "spadl_type"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["utc_timestamp", "event_id"])
        rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        kinds, last = [r["spadl_type"] for r in rows], None
        for i, r in enumerate(rows):  # each row's last earlier row that is no duel
            r["recent"] = last
            if "Duel" not in (r["event_type"] or ""):
                last = i
        for i, r in enumerate(rows):
            if r["event_type"] == "OtherBallAction":
                for k, v in other_action(rows, i, kinds).items():
                    kinds[k] = v
        return pd.DataFrame({"match_id": pdf["match_id"], "event_id": pdf["event_id"], "spadl_type": kinds})

    typed = e.select(*cols, "utc_timestamp").groupBy("match_id").applyInPandas(fold, "match_id string, event_id string, spadl_type string")
    e = e.drop("spadl_type").join(typed, ["match_id", "event_id"]).where("spadl_type is not null")
    w = Window.partitionBy("match_id").orderBy("utc_timestamp", "event_id")
    follows = (F.lead("period_id").over(w) == F.col("period_id")) & (F.lead("team_id").over(w) == F.col("team_id"))
    # fixed values: types that always or never succeed
    always = ["interception", "tackle", "dispossessed", "ball_recovery", "shot_block"]
    never = ["foul"]
    t = F.col("spadl_type")
    ok = F.when(t.isin(always), True).when(t.isin(never), False).when(t.isin("clearance", "bad_touch"), F.coalesce(follows, F.lit(False))).otherwise(F.coalesce("success", F.lit(False)))
    return e.withColumn("success", ok)


def orient(events: DataFrame, keepers: DataFrame, length: float = 105.0, width: float = 68.0) -> DataFrame:
    """Rotate the periods in which the home keeper stands right of the away keeper; both ends of an event turn.  keepers: match_id, period_id, home_away, x."""
    m = keepers.groupBy("match_id", "period_id").pivot("home_away", ["home", "away"]).agg(F.avg("x"))
    turn = m.select("match_id", "period_id", (F.col("home") > F.col("away")).alias("__turn"))
    j = events.join(F.broadcast(turn), ["match_id", "period_id"], "left")  # one row a period
    flip = lambda c, n: F.when(F.col("__turn"), F.rint((n - F.col(c)) * 100) / 100).otherwise(F.col(c))
    return j.withColumns({"coordinates_x": flip("coordinates_x", length), "coordinates_y": flip("coordinates_y", width), "end_coordinates_x": flip("end_coordinates_x", length), "end_coordinates_y": flip("end_coordinates_y", width)}).drop("__turn")


def read_tracking(spark: SparkSession, path: str, match_of: str = MATCH_OF, length: float = 105.0, width: float = 68.0, fps: int = 25) -> DataFrame:
    """Rows of frame sets, centred metres moved to the corner: match_id, period_id, team_id, person_id, frame_id, x, y, z, ball_state, timestamp (seconds of the period)."""
    schema = "_GameSection string, _TeamId string, _PersonId string, Frame array<struct<_N:long,_X:double,_Y:double,_Z:double,_BallStatus:int,_T:string>>"
    t = spark.read.format("xml").option("rowTag", "FrameSet").schema(schema).load(path).select("*", match_column(match_of))
    period = F.when(F.col("_GameSection") == "firstHalf", 1).when(F.col("_GameSection") == "secondHalf", 2).cast("long")
    f = t.select("match_id", period.alias("period_id"), F.col("_TeamId").alias("team_id"), F.col("_PersonId").alias("person_id"), F.explode("Frame").alias("f"))
    f = f.select(
        "match_id", "period_id", "team_id", "person_id", F.col("f._N").alias("frame_id"), (F.col("f._X") + length / 2).alias("x"), (F.col("f._Y") + width / 2).alias("y"), F.col("f._Z").alias("z"),
        F.when(F.col("f._BallStatus") == 1, "alive").when(F.col("f._BallStatus") == 0, "dead").alias("ball_state"),
    )
    start = f.groupBy("match_id", "period_id").agg(F.min("frame_id").alias("__n"))  # a grouped minimum, one row a period
    return f.join(start, ["match_id", "period_id"]).withColumn("timestamp", times.seconds_of_frame(F.col("frame_id") - F.col("__n"), fps)).drop("__n")


def named_objects(df: DataFrame, lineup: DataFrame, person: str, out: str) -> DataFrame:
    """``out``: the object id (home_7) of a provider's person id."""
    ids = lineup.select("match_id", F.col("player_id").alias("__p"), F.col("object_id").alias(out)).dropDuplicates(["match_id", "__p"])
    return df.join(ids, (df["match_id"] == ids["match_id"]) & (df[person] == ids["__p"]), "left").drop(ids["match_id"], "__p")


def contract_events(typed: DataFrame, lineup: DataFrame) -> DataFrame:
    """Events of the synchroniser's contract, numbered in time; player_id is the object id."""
    e = named_objects(typed, lineup, "player_id", "object_id").where("object_id is not null and period_id is not null")
    w = Window.partitionBy("match_id").orderBy("period_id", "utc_timestamp", "event_id")
    return e.select("match_id", (F.row_number().over(w) - 1).cast("long").alias("event_idx"), "period_id", "utc_timestamp", F.col("object_id").alias("player_id"), "spadl_type", "success", F.col("coordinates_x").alias("start_x"), F.col("coordinates_y").alias("start_y"))


def contract_tracking(raw: DataFrame, lineup: DataFrame, events: DataFrame, fps: int = 25) -> DataFrame:
    """Tracking of the synchroniser's contract: object ids, utc from each period's first event, derivatives by object and period, then live frames only."""
    ball = F.col("person_id").isNull() | (F.upper("team_id") == "BALL")
    state = raw.where(ball).groupBy("match_id", "period_id", "frame_id").agg(F.max("ball_state").alias("__s"))
    t = named_objects(raw.withColumn("ball", ball), lineup, "person_id", "object_id").where("ball or object_id is not null").drop("ball_state")
    t = kinematics(t.withColumn("__o", F.when(F.col("ball"), "ball").otherwise(F.col("object_id"))), ["match_id", "period_id", "__o"], "frame_id", fps)
    start = events.where("period_id is not null").groupBy("match_id", "period_id").agg(F.min("utc_timestamp").alias("__t"))
    t = t.join(state, ["match_id", "period_id", "frame_id"]).where("__s = 'alive'").join(start, ["match_id", "period_id"])
    utc = times.shift(F.col("__t"), F.rint(F.col("timestamp") * 1e6).cast("long"))
    return t.select("match_id", "frame_id", "period_id", "timestamp", utc.alias("utc_timestamp"), F.when(~F.col("ball"), F.col("object_id")).alias("player_id"), "ball", "x", "y", F.when(F.col("ball"), F.col("z")).alias("z"), "speed", "accel_s", "accel_v")

import datetime as dt

from pyspark.sql import functions as F

from chronoweave.plans import batch
from chronoweave.sources import files, parquet_provider, xml_provider

from test_sync import EVENT, TRACK, KICKS, T0, tracking_rows

T = lambda s: T0 + dt.timedelta(seconds=s)


def test_parquet_typing(spark):
    cols = "stats_perform_match_id string, period_id long, utc_timestamp timestamp_ntz, player_id string, action_type string, outcome boolean, cross boolean, penalty boolean, free_kick_type string, expected_goal double, advanced_position string, start_x double, start_y double"
    rows = [
        ("a", 1, T(0), "p1", "pass", True, False, None, None, None, "mid", 50.0, 30.0),
        ("a", 1, T(1), "p2", "pass", True, True, False, None, None, "mid", 50.0, 30.0),
        ("a", 1, T(2), "p2", "goal_attempt", None, None, False, None, 0.3, "mid", 95.0, 30.0),
        ("a", 1, T(40), "p3", "pass", True, None, None, None, None, "mid", 52.5, 34.0),
        ("a", 1, T(50), "p1", "free_kick", True, False, False, None, None, "mid", 50.0, 30.0),
        ("a", 1, T(51), "p1", "free_kick", True, True, False, "direct", None, "mid", 50.0, 30.0),
        ("a", 1, T(60), "p9", "save", True, None, None, None, None, "goal_keeper", 5.0, 30.0),
        ("a", 1, T(61), "p9", "keeper_sweeper", True, None, None, None, None, "goal_keeper", 5.0, 30.0),
        ("b", 1, T(0), "k", "offside_pass", True, None, None, None, None, "goal_keeper", 52.0, 34.0),
    ]
    got = parquet_provider.type_events(spark.createDataFrame(rows, cols)).orderBy("stats_perform_match_id", "utc_timestamp").collect()
    assert [r["spadl_type"] for r in got] == ["pass", "cross", "shot", "pass", "foul", "freekick_crossed", "keeper_save", "clearance", "pass"]
    assert [r["success"] for r in got][:3] == [True, True, True] and got[-1]["success"] is False and got[-1]["offside"]


def test_xml_provider(spark, tmp_path):
    (tmp_path / "meta.xml").write_text('<R><Team TeamId="T1" TeamName="X" Role="home"><Players><Player PersonId="P1" ShirtNumber="7" Shortname="A" Starting="true" PlayingPosition="DRM" TeamLeader="false"/></Players></Team><Team TeamId="T2" TeamName="Y" Role="guest"><Players><Player PersonId="P2" ShirtNumber="9" Shortname="B" Starting="false"/></Players></Team></R>')
    lineup = {r["player_id"]: r for r in xml_provider.read_lineup(spark, str(tmp_path / "meta.xml")).collect()}
    assert lineup["P1"]["object_id"] == "home_7" and lineup["P1"]["position"] == "RDM" and lineup["P2"]["home_away"] == "away" and lineup["P2"]["position"] is None
    ev = """<R>
<Event EventId="1" EventTime="2024-01-01T12:00:00.000+00:00" X-Source-Position="52.5" Y-Source-Position="34"><KickOff GameSection="firstHalf"><Play Player="P1" Team="T1" Recipient="P3" Evaluation="successfullyCompleted"><Pass/></Play></KickOff></Event>
<Event EventId="2" EventTime="2024-01-01T12:00:05.000+00:00" X-Position="" Y-Position="20"><Play Player="P3" Team="T1" Recipient="P2" Evaluation="unsuccessful"><Cross/></Play></Event>
<Event EventId="3" EventTime="2024-01-01T12:00:06.000+00:00"><OtherBallAction Player="P2" Team="T2"/></Event>
<Event EventId="4" EventTime="2024-01-01T12:00:07.000+00:00"><Delete/></Event>
<Event EventId="5" EventTime="2024-01-01T12:00:08.000+00:00"><ShotAtGoal Player="P2" Team="T2" TypeOfShot="head"><SuccessfulShot/></ShotAtGoal></Event>
<Event EventId="6" EventTime="2024-01-01T12:45:00.000+00:00"><FinalWhistle GameSection="firstHalf"/></Event>
</R>"""
    (tmp_path / "events.xml").write_text(ev)
    e = xml_provider.read_events(spark, str(tmp_path / "events.xml"))
    assert {r["event_id"]: r["period_id"] for r in e.collect()} == {"1": 1, "2": 1, "3": 1, "5": 1, "6": 1}
    got = {r["event_id"]: (r["spadl_type"], r["success"], r["coordinates_x"]) for r in xml_provider.type_events(e).collect()}
    assert got == {"1": ("pass", True, 52.5), "2": ("cross", False, None), "3": ("interception", True, None), "5": ("shot", True, None)}


def test_batch_writes_accepted_matches(spark, tmp_path):
    t = spark.createDataFrame(tracking_rows(), TRACK)
    ev = [(m, i, 1, T0 + dt.timedelta(microseconds=40000 * k), who, kind, True, p[0], p[1]) for m, kind in (("m", "pass"), ("x", "nonsense")) for i, (k, who, p, *_) in enumerate(KICKS)]
    status = {r["match_id"]: r["status"] for r in batch.run(spark.createDataFrame(ev, EVENT).drop("start_x", "start_y"), t, str(tmp_path / "out")).collect()}
    assert status == {"m": "written", "x": "no tracking"}
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3
    x = batch.explain_event(spark.createDataFrame(ev, EVENT), t, "m", 1)
    assert x.where("best").count() == 1


def test_listing_and_pending(spark, tmp_path):
    for n in ("a.csv", "b.csv", "c.txt"):
        (tmp_path / n).write_text("match_id,v\nm,1\n")
    assert files.listing(spark, str(tmp_path), "*.csv").count() == 2
    assert files.read_csv(spark, str(tmp_path), "match_id string, v int", "*.csv").count() == 2
    a, b = spark.createDataFrame([("m",), ("n",)], "match_id string"), spark.createDataFrame([("m",)], "match_id string")
    assert [r[0] for r in files.pending(a, b).collect()] == ["n"]


def other(before, me, after, spadl=None):
    """Types that the rules give around an OtherBallAction; rows are (type, player, team, receiver, success)."""
    rows = [dict(zip(("event_type", "player_id", "team_id", "receiver_player_id", "success"), r, strict=True)) for r in [*before, me, *after]]
    last = None
    for i, r in enumerate(rows):
        r["recent"] = last
        if "Duel" not in r["event_type"]:
            last = i
    got = xml_provider.other_action(rows, len(before), spadl or [None] * len(rows))
    return {k - len(before): v for k, v in got.items()}


def test_rules_for_other_ball_actions():
    me = ("OtherBallAction", "A", "t", None, None)
    failed, shot, clear = ("Pass", "X", "o", "A", False), ("Shot", "X", "o", "A", False), ("Clearance", "X", "o", None, None)
    idle, mine = ("Pass", "X", "o", "Z", True), ("Pass", "A", "t", "Z", True)
    won, lost, air = ("GroundDuel", "A", "t", "B", True), ("GroundDuel", "B", "o", "A", True), ("AerialDuel", "A", "t", "B", True)
    assert other([failed], me, [mine]) == {0: "interception"}
    assert other([failed, air], me, [mine]) == {0: "clearance"} and other([failed], me, [air]) == {0: "clearance"}
    assert other([shot], me, [mine]) == {0: "shot_block"}
    assert other([clear], me, [mine]) == {0: "ball_recovery"} and other([clear], me, [idle]) == {0: "bad_touch"}
    assert other([idle, ("OtherBallAction", "B", "o", None, None)], me, [won]) == {-1: "dispossessed", 0: "tackle"}
    assert other([idle], me, [won]) == {0: "tackle"} and other([("Pass", "X", "o", "Z", True)], me, [won], ["interception", None, None]) == {0: "interception"}
    assert other([mine], me, [won]) == {}
    assert other([idle], me, [lost]) == {0: "dispossessed"} and other([("OtherBallAction", "B", "o", None, None)], me, [lost]) == {-1: "tackle", 0: "dispossessed"}
    assert other([idle, won], me, [mine]) == {0: "tackle"} and other([idle, lost], me, [mine], ["clearance", None, None, None]) == {0: "interception"}
    assert other([idle], me, [idle]) == {0: "bad_touch"} and other([idle], me, [mine]) == {} and other([], me, []) == {}


def wide_match(spark):
    """The tiny match as a provider's wide frames, centimetres for the ball's height; the ball leaves and arrives at once."""
    spots = {"home_1": (52.5, 34.0), "home_2": (70.0, 40.0), "home_3": (60.0, 20.0), "away_1": (30.0, 10.0), "away_2": (90.0, 60.0)}
    rows = []
    for f in range(400):
        x, y = 52.5, 34.0
        for k, _, p, _, q, r in KICKS:
            if f > k:
                u = min(1.0, (f - k) / (r - k))
                x, y = p[0] + (q[0] - p[0]) * u, p[1] + (q[1] - p[1]) * u
        rows.append(("g", 1, f / 25, "alive", x, y, 10.0, *[v for o, s in spots.items() for v in (*s, f"p_{o}" if f == 3 else None)]))
    cols = "stats_perform_match_id string, period_id int, timestamp double, ball_state string, ball_x double, ball_y double, ball_z double, " + ", ".join(f"{o}_x double, {o}_y double, {o}_id string" for o in spots)
    return spark.createDataFrame(rows, cols)


def test_parquet_tables_to_written_matches(spark, tmp_path):
    from chronoweave.sources.provider import ParquetProvider

    acts = [(k, f"p_{who}", p) for k, who, p, *_ in KICKS] + [(300, "p_away_1", (30.0, 10.0))]
    cols = "stats_perform_match_id string, time_stamp timestamp_ntz, period_id int, player_id string, player_name string, action_type string, outcome boolean, cross boolean, penalty boolean, free_kick_type string, expected_goal double, start_x double, start_y double"
    raw = [("g", T0 + dt.timedelta(microseconds=40000 * (k - KICKS[0][0])), 1, who, "n", "pass" if i < 3 else "attempted_tackle", True, False, False, None, None, *p) for i, (k, who, p) in enumerate(acts)]
    raw += [("two dates", T0 + dt.timedelta(days=i), 1, "p_home_1", "n", "pass", True, False, False, None, None, 1.0, 1.0) for i in range(2)]
    lineup = spark.createDataFrame([(m, f"p_{o}", "mid") for m in ("g", "two dates") for o in ("home_1", "home_2", "home_3", "away_1", "away_2")], "stats_perform_match_id string, player_id string, advanced_position string")
    provider = ParquetProvider(spark.createDataFrame(raw, cols), lineup, wide_match(spark))
    e = provider.events().orderBy("event_idx").collect()
    assert [(r["match_id"], r["event_idx"], r["player_id"], r["spadl_type"]) for r in e] == [("g", 0, "home_1", "pass"), ("g", 1, "home_2", "pass"), ("g", 2, "home_3", "pass")]
    status = {r["match_id"]: r["status"] for r in batch.run_provider(provider, str(tmp_path / "out")).collect()}
    assert status == {"g": "written"}
    got = spark.read.option("header", True).csv(str(tmp_path / "out")).orderBy("event_idx").collect()
    for r, (kick, *_) in zip(got, KICKS, strict=True):
        assert abs(int(r["frame_id"]) - kick) <= 8, r
    # a limit that no match keeps: not accepted, and what was written goes
    none = {r["match_id"]: r["status"] for r in batch.run(provider.events().withColumn("player_id", F.lit("home_9")), provider.tracking(), str(tmp_path / "out"), limit=-1).collect()}
    assert none == {"g": "unsynced"} and not (tmp_path / "out" / "match_id=g").exists()


def test_xml_files_to_contracts(spark, tmp_path):
    from chronoweave.contracts import EVENTS, TRACKING, validate
    from chronoweave.sources.provider import XmlProvider

    for folder in ("lineup", "events", "frames"):
        (tmp_path / folder).mkdir()
    for m, day in (("m1", 1), ("m2", 2)):
        (tmp_path / "lineup" / f"l_{m}.xml").write_text(f'<R><Team TeamId="T1" TeamName="X" Role="home"><Players><Player PersonId="P1{m}" ShirtNumber="7"/></Players></Team><Team TeamId="T2" TeamName="Y" Role="guest"><Players><Player PersonId="P2{m}" ShirtNumber="9"/></Players></Team></R>')
        ev = "".join(f'<Event EventId="{i}" EventTime="2024-01-0{day}T12:00:{s:02d}.000+01:00">{x}</Event>' for i, s, x in [
            (1, 0, f'<KickOff GameSection="firstHalf"><Play Player="P1{m}" Team="T1" Evaluation="successfullyCompleted"><Pass/></Play></KickOff>'), (2, 4, f'<Play Player="P2{m}" Team="T2" Evaluation="unsuccessful"><Pass/></Play>'), (3, 9, '<FinalWhistle GameSection="firstHalf"/>')])
        (tmp_path / "events" / f"e_{m}.xml").write_text(f"<R>{ev}</R>")
        sets = "".join(f'<FrameSet GameSection="firstHalf" TeamId="{t}" PersonId="{p}">' + "".join(f'<Frame N="{1000 * day + i}" X="{0.1 * i:.2f}" Y="0" Z="0.5" BallStatus="{int(i < 80) if t == "BALL" else ""}"/>'.replace(' BallStatus=""', "") for i in range(100)) + "</FrameSet>" for t, p in (("T1", f"P1{m}"), ("T2", f"P2{m}"), ("BALL", "B")))
        (tmp_path / "frames" / f"f_{m}.xml").write_text(f"<R>{sets}</R>")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")  # times must not depend on the session's zone
    try:
        p = XmlProvider(spark, str(tmp_path / "lineup"), str(tmp_path / "events"), str(tmp_path / "frames"))
        e = {(r["match_id"], r["event_idx"]): (r["player_id"], r["spadl_type"], r["success"], r["utc_timestamp"]) for r in p.events().collect()}
        at = lambda d, s: dt.datetime(2024, 1, d, 11, 0, s)
        assert e == {("m1", 0): ("home_7", "pass", True, at(1, 0)), ("m1", 1): ("away_9", "pass", False, at(1, 4)), ("m2", 0): ("home_7", "pass", True, at(2, 0)), ("m2", 1): ("away_9", "pass", False, at(2, 4))}
        t = p.tracking()
        assert {(r["match_id"], r["player_id"], r["ball"]): (r["n"], r["a"], r["u"]) for r in t.groupBy("match_id", "player_id", "ball").agg(F.count("*").alias("n"), F.min("timestamp").alias("a"), F.min("utc_timestamp").alias("u")).collect()} == {
            (m, who, who is None): (80, 0.0, at(d, 0)) for m, d in (("m1", 1), ("m2", 2)) for who in ("home_7", "away_9", None)
        }
        assert validate(p.events().select(*EVENTS.types), EVENTS).where("violations > 0").count() == 0 and validate(t, TRACKING).where("violations > 0").count() == 0
        assert t.where("abs(speed - 2.5) > 1e-6").count() == 0
        assert files.file_of(spark, str(tmp_path / "events"), "e_", "m2").endswith("e_m2.xml")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_explanations(spark):
    t = spark.createDataFrame(tracking_rows(), TRACK)
    ev = spark.createDataFrame([("m", i, 1, T0 + dt.timedelta(microseconds=40000 * k), who, "pass", True, p[0], p[1]) for i, (k, who, p, *_) in enumerate(KICKS)], EVENT)
    from chronoweave.plans.synchronise import synchronise

    synced = synchronise(ev, t).withColumn("frame_id", F.col("frame_id"))
    x = batch.explain_receive(synced, t, "m", 0)
    frame = synced.where("event_idx = 0").first()["receive_frame_id"]
    assert [r["frame"] for r in x.where("best").collect()] == [frame] and x.where("candidate").count() >= 1
    y = batch.explain_located(ev, t, "m", 1)
    assert y.where("best").count() == 1 and y.where("best and not candidate").count() == 0
    assert batch.explain_receive(synced, t, "m", 2).count() == 0


def test_the_baseline_takes_its_clock_from_the_second_event(spark):
    """No player near the ball at the start: the kickoff falls back, and the second event's best frame gives the offset."""
    from chronoweave.plans.synchronise import frame_dimension, kickoffs, located_offsets, with_neighbours

    t = spark.createDataFrame(tracking_rows(), TRACK)
    far = t.withColumn("x", F.when(F.col("ball") & (F.col("frame_id") < 15), 10.0).otherwise(F.col("x"))).where("frame_id >= 10")
    late = dt.timedelta(seconds=3)
    ev = spark.createDataFrame([("m", i, 1, T0 + dt.timedelta(microseconds=40000 * k) + late, who, "clearance" if i == 0 else "pass", True, p[0], p[1]) for i, (k, who, p, *_) in enumerate(KICKS)], EVENT)
    e, frames = with_neighbours(ev), frame_dimension(far)
    kick = kickoffs(e, far, frames)
    assert not kick.first()["ok"]
    got = located_offsets(e, far, frames, kick).first()["offset"]
    assert abs(got - 3_000_000) <= 2_400_000 and got != 0

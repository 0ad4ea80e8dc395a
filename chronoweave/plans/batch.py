"""All matches of a provider in one job: status by match, synchronise, trim, gate, write."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import EVENTS, TRACKING, Contract
from ..sources.files import drop_output, trim_tail, write_synced
from ..sources.provider import Provider
from ..storage import kept
from .detectors import COMPAT_TACKLE, DETECTORS, explain, kind_of
from .synchronise import FEATURES, PACKED, RECEIVE, _arrays, features, frame_dimension, located_features, receive_cases, receive_features, synchronise, window_bounds, with_neighbours


def match_status(df: DataFrame, contract: Contract) -> DataFrame:
    """match_id, violations: rows that break a rule, by match; one aggregate."""
    bad = F.lit(False)
    for rule in contract.rules().values():
        bad = bad | ~F.coalesce(rule, F.lit(True))
    return df.groupBy("match_id").agg(F.count_if(bad).alias("violations"))


def run(events: DataFrame, tracking: DataFrame, out: str, fps: int = 25, limit: int = 50, post_sync_types: list[str] | None = None) -> DataFrame:
    """Writes the accepted matches under ``out``; match_id, status ('written', 'unsynced', 'invalid', 'no tracking') for every match."""
    e, t = match_status(events, EVENTS).withColumnRenamed("violations", "e"), match_status(tracking, TRACKING).withColumnRenamed("violations", "t")
    seen = e.join(t, "match_id", "left")
    seen = kept(seen)
    good = seen.where("e = 0 and t = 0").select("match_id")
    ev, tr = events.join(good, "match_id", "left_semi"), tracking.join(good, "match_id", "left_semi")
    synced = kept(trim_tail(kept(synchronise(ev, tr, fps, post_sync_types)), frame_dimension(tr)))
    done = write_synced(synced, out, limit)
    # what an earlier run wrote for a match that is not accepted now goes away
    stale = seen.select("match_id").join(done.where("ok").select("match_id"), "match_id", "left_anti")
    drop_output(stale, out)
    status = F.when(F.col("t").isNull(), "no tracking").when((F.col("e") > 0) | (F.col("t") > 0), "invalid").when(F.col("ok"), "written").otherwise("unsynced")
    return seen.join(done, "match_id", "left").select("match_id", status.alias("status"), F.col("unsynced"))


def run_provider(provider: Provider, out: str, fps: int = 25, limit: int = 50, post_sync_types: list[str] | None = None) -> DataFrame:
    """From a provider's tables to written matches: ``run`` on its events and tracking, each read once."""
    return run(kept(provider.events()), kept(provider.tracking()), out, fps, limit, post_sync_types)


def explain_event(events: DataFrame, tracking: DataFrame, match_id: str, event_idx: int, fps: int = 25, compat: bool = False) -> DataFrame:
    """frame, features, candidate, score and best of one event, as the detector sees its whole window."""
    spark = events.sparkSession
    e, t = events.where(F.col("match_id") == match_id), tracking.where(F.col("match_id") == match_id)
    n = with_neighbours(e)
    b = window_bounds(n, frame_dimension(t), fps).where(F.col("event_idx") == event_idx).select("match_id", "event_idx", "event_frame", "lo", "hi")
    got = features(n.join(b, ["match_id", "event_idx"]), t, fps).select("spadl_type", *[f"f_{c}" for c in PACKED]).toPandas()  # one event
    schema = ", ".join(f"{c} double" for c in FEATURES) + ", candidate boolean, score double, best boolean"
    row = next(got.itertuples(index=False), None)
    if row is None or row.f_frame is None:
        return spark.createDataFrame([], schema)
    f = _arrays(row, 0, float("inf"))
    kind = kind_of(row.spadl_type)[1]
    got = explain(COMPAT_TACKLE if compat and kind == "tackle" else DETECTORS[kind], f, fps) if kind in DETECTORS else None
    score = {} if got is None else dict(zip(got["frame"].tolist(), got["score"].tolist(), strict=True))
    top = max(score, key=lambda x: (score[x], -x)) if score else None
    return spark.createDataFrame([(*[float(f[c][i]) for c in FEATURES], x in score, score.get(x), x == top) for i, x in enumerate(f["frame"].tolist())], schema)


def explain_receive(synced: DataFrame, tracking: DataFrame, match_id: str, event_idx: int, fps: int = 25) -> DataFrame:
    """frame, features, closest_id, candidate, score and best of the search for one synced pass's receive; no rows where its case decides."""
    spark = synced.sparkSession
    e, t = synced.where(F.col("match_id") == match_id), tracking.where(F.col("match_id") == match_id)
    case = receive_cases(e, frame_dimension(t), fps).where((F.col("event_idx") == event_idx) & (F.col("case") == 0))
    got = receive_features(case, t, fps).toPandas()  # one event
    schema = ", ".join(f"{c} double" for c in RECEIVE) + ", closest_id string, candidate boolean, score double, best boolean"
    row = next(got.itertuples(index=False), None)
    if row is None:
        return spark.createDataFrame([], schema)
    f = {c: np.asarray(getattr(row, c), float) for c in RECEIVE}
    found = explain(DETECTORS["receive"], f, fps)
    score = {} if found is None else dict(zip(found["frame"].tolist(), found["score"].tolist(), strict=True))
    top = max(score, key=lambda x: (score[x], -x)) if score else None
    return spark.createDataFrame([(*[float(f[c][i]) for c in RECEIVE], row.closest_id[i], x in score, score.get(x), x == top) for i, x in enumerate(f["frame"].tolist())], schema)


def explain_located(events: DataFrame, tracking: DataFrame, match_id: str, event_idx: int, fps: int = 25) -> DataFrame:
    """frame, features, candidate, score and best of one event in the located baseline, over its whole window."""
    e, t = events.where((F.col("match_id") == match_id) & (F.col("event_idx") == event_idx)), tracking.where(F.col("match_id") == match_id)
    j = located_features(with_neighbours(e), t, frame_dimension(t), fps)
    w = Window.partitionBy("event_idx").orderBy(F.desc("candidate"), F.desc("score"), "frame")
    return j.withColumn("best", F.col("candidate") & (F.row_number().over(w) == 1)).drop("match_id", "period_id", "us")

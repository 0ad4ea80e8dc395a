"""Structured Streaming extensions: sessions, and forward-only matching as state of each match.

The batch engine needs no stream; these serve live feeds of the same shape.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..deploy import ship


def stream_episodes(frames: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Episodes of each key by event-time gaps, with a watermark."""
    return frames.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_forward_only(cands: DataFrame, key: str = "user_id", event: str = "event_id") -> DataFrame:
    """Rows (key, event, cands: array<struct<frame_id, fvalue>>) in; (key, event, frame_id) out.

    The state is the last matched frame; events of a batch are taken in the order of their id.
    """
    ship(cands.sparkSession)
    kinds = dict(cands.dtypes)

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else 0
        pdf = pd.concat(list(batches)).sort_values(event)
        out = []
        for row in pdf["cands"]:
            ok = [(c["fvalue"], -c["frame_id"]) for c in row if c["frame_id"] >= at]
            best = -max(ok)[1] if ok else None
            at = at if best is None else best
            out.append(best)
        state.update((at,))
        yield pd.DataFrame({key: pdf[key], event: pdf[event], "frame_id": pd.array(out, dtype="Int64")})

    return cands.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {event} {kinds[event]}, frame_id long", "at long", "append", GroupStateTimeout.NoTimeout)

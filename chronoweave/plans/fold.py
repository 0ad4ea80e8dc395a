"""Ordered folds: the parts whose next step depends on the last result.

A fold runs in one Python worker for each group (a match, or a period of one), on rows
that hold only the event's candidate arrays, so a group is small and groups are
independent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..deploy import ship


def forward_only(events: DataFrame, key: str, order: list[str], event: str, cands: str = "cands") -> DataFrame:
    """The candidate of largest value (earliest on ties) at or after the last match; events without one do not move it.

    Candidates travel as two flat arrays (frames, values), so a group becomes NumPy arrays without a Python object for each.
    """
    ship(events.sparkSession)
    kinds = dict(events.dtypes)
    names = [key, event, *[o for o in order if o not in (key, event)]]
    own = events.select(*names, F.col(f"{cands}.frame_id").cast("array<bigint>").alias("__f"), F.col(f"{cands}.fvalue").cast("array<double>").alias("__v"))
    types = [to_arrow_type(own.schema[c].dataType) for c in (key, event)]

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by([(o, "ascending") for o in order]).combine_chunks()
        frames, values = (t[c].combine_chunks() if t.num_rows else None for c in ("__f", "__v"))
        if isinstance(frames, pa.ChunkedArray):  # of an empty group
            frames, values = frames.chunk(0), values.chunk(0)
        off, f, v = frames.offsets.to_numpy(), frames.values.to_numpy(zero_copy_only=False), values.values.to_numpy(zero_copy_only=False)
        at, out = 0, []
        for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            open_ = np.flatnonzero(f[lo:hi] >= at) + lo
            best = None
            if len(open_):
                top = open_[v[open_] == v[open_].max()]
                at = best = int(f[top].min())
            out.append(best)
        return pa.table({key: t[key].cast(types[0]), event: t[event].cast(types[1]), "frame_id": pa.array(out, pa.int64())})

    return own.groupBy(key).applyInArrow(fold, f"{key} {kinds[key]}, {event} {kinds[event]}, frame_id long")

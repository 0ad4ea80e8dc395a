"""Smoothing and peaks: NumPy kernels for use inside folds, and native forms for whole tables."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..deploy import ship


@lru_cache
def smoother(width: int, degree: int = 2) -> np.ndarray:
    """Least-squares hat matrix of a local polynomial; its middle row smooths inner points."""
    x = np.arange(width) - width // 2
    v = np.vander(x, degree + 1, increasing=True).astype(float)
    return v @ np.linalg.pinv(v)


def smooth(y: np.ndarray, width: int = 9, degree: int = 2) -> np.ndarray:
    """Savitzky-Golay filter; the ends take the polynomial fitted to the end windows.  Short input is returned as it is."""
    y = np.asarray(y, float)
    if len(y) < width:
        return y
    h, half = smoother(width, degree), width // 2
    out = np.convolve(y, h[half][::-1], mode="same")
    out[:half] = h[:half] @ y[:width]
    out[-half:] = h[-half:] @ y[-width:]
    return out


def peaks(y: np.ndarray, prominence: float | None = None, distance: int | None = None) -> np.ndarray:
    """Strict local maxima (plateaus by their middle, ends never), thinned by distance from the highest, then by prominence."""
    y = np.asarray(y, float)
    if len(y) < 3:
        return np.zeros(0, int)
    start = np.concatenate([[0], np.flatnonzero(np.diff(y) != 0) + 1])
    stop = np.concatenate([start[1:], [len(y)]]) - 1
    level = y[start]
    inner = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    at = (start[inner] + stop[inner]) // 2
    if distance is not None and len(at):
        keep = np.ones(len(at), bool)
        for i in np.argsort(y[at], kind="stable")[::-1]:
            if keep[i]:
                near = np.abs(at - at[i]) < distance
                near[i] = False
                keep &= ~near
        at = at[keep]
    if prominence is not None and len(at):
        at = at[prominences(y)[at] >= prominence]
    return at


def _base(y: list) -> list:
    """For each value the least one back to the nearest strictly higher value; one pass with a falling stack."""
    out, stack = [], []
    for v in y:
        low = v
        while stack and stack[-1][0] <= v:
            low = min(low, stack.pop()[1])
        stack.append((v, low))
        out.append(low)
    return out


def prominences(y: np.ndarray) -> np.ndarray:
    """How far each value stands above the higher of its two bases; linear in the length."""
    values = np.asarray(y, float).tolist()
    return np.asarray(values) - np.maximum(_base(values), _base(values[::-1])[::-1])


def smooth_column(value: str, keys: list[str], order: list[str], width: int = 9, degree: int = 2) -> Column:
    """Inner points of the filter as one window expression; the half-width ends are null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    half, row = width // 2, smoother(width, degree)[width // 2]
    total = F.lit(0.0)
    for k in range(-half, half + 1):
        x = F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w) if k > 0 else F.col(value)
        total = total + float(row[k + half]) * x
    return total


def smooth_full(df: DataFrame, value: str, keys: list[str], order: list[str], out: str, width: int = 9, degree: int = 2) -> DataFrame:
    """The filter with its ends: end rows take the hat matrix of the first or last ``width`` values; series shorter than ``width`` stay as they are."""
    h, half = smoother(width, degree), width // 2
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = Window.partitionBy(*keys)
    d = df.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count("*").over(whole)).withColumn("__s", smooth_column(value, keys, order, width, degree))

    def end(first: bool) -> Column:
        case = None
        for r in range(half):
            at = F.col("__i") == r + 1 if first else F.col("__i") == F.col("__n") - r
            row = h[r] if first else h[width - 1 - r]
            terms = F.lit(0.0)
            for j in range(width):
                k = (j - r) if first else (j - (width - 1 - r))
                x = F.col(value) if k == 0 else F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w)
                terms = terms + float(row[j]) * x
            case = F.when(at, terms) if case is None else case.when(at, terms)
        return case

    return d.withColumn(out, F.when(F.col("__n") < width, F.col(value)).otherwise(F.coalesce(end(True), end(False), "__s"))).drop("__i", "__n", "__s")


def peaks_of_series(df: DataFrame, keys: list[str], pos: str, value: str, prominence: float, distance: int | None = None) -> DataFrame:
    """Peaks of every series with at least ``prominence``, for whole tables: keys, pos, value, prominence.

    One exchange by the keys, then the linear kernel in each series (a match period has some
    70,000 samples); a plateau counts at the middle of its first and last position.
    ``distance``, in samples, thins peaks from the highest before prominences count.
    """
    ship(df.sparkSession)
    own = df.select(*keys, pos, F.col(value).cast("double").alias(value))
    schema = T.StructType([*[own.schema[c] for c in (*keys, pos, value)], T.StructField("prominence", T.DoubleType())])

    def kernel(t: pa.Table) -> pa.Table:
        t = t.sort_by(pos)
        x, y = t[pos].to_numpy(), t[value].to_numpy()
        start = np.concatenate([[0], np.flatnonzero(np.diff(y) != 0) + 1])
        stop = np.concatenate([start[1:], [len(y)]]) - 1
        level = y[start]
        at = peaks(level) if distance is None else np.searchsorted(start, peaks(y, None, distance), "right") - 1
        p = prominences(level)[at] if len(at) else np.zeros(0)
        at, p = at[p >= prominence], p[p >= prominence]
        cols = {k: pa.array([t[k][0].as_py()] * len(at), t.schema.field(k).type) for k in keys}
        return pa.table(cols | {pos: pa.array((x[start[at]] + x[stop[at]]) // 2, t.schema.field(pos).type), value: pa.array(level[at], pa.float64()), "prominence": pa.array(p, pa.float64())})

    return own.groupBy(*keys).applyInArrow(kernel, schema)


def relative_speed(value: str, w, fps: float = 25) -> Column:
    """Change to the next value a second; the last value repeats the one before it.  w: the ordered window of a series."""
    return F.coalesce(F.lead(value).over(w) - F.col(value), F.col(value) - F.lag(value).over(w)) * fps


def relative_accel(speed: str, w, fps: float = 25) -> Column:
    """Size of the change of speed a second, 0 for the first value."""
    return F.coalesce(F.abs(F.col(speed) - F.lag(speed).over(w)), F.lit(0.0)) * fps


def kinematics(tracking: DataFrame, keys: list[str], frame: str = "frame_id", fps: float = 25) -> DataFrame:
    """vx, vy, speed, accel_s, accel_v of each object by smoothed differences; first differences take the next one's value."""
    w = Window.partitionBy(*keys).orderBy(frame)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)

    def rate(df, src, out):
        d = df.withColumn(out, (F.col(src) - F.lag(src).over(w)) * fps)
        return d.withColumn(out, F.first(out, True).over(ahead))

    t = tracking.where("x is not null and y is not null")
    for axis in ("x", "y"):
        t = smooth_full(rate(t, axis, f"__v{axis}"), f"__v{axis}", keys, [frame], f"v{axis}", 15)
    t = t.withColumn("speed", F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2))
    t = smooth_full(rate(t, "speed", "__as"), "__as", keys, [frame], "accel_s", 9)
    for axis in ("x", "y"):
        t = smooth_full(rate(t, f"v{axis}", f"__a{axis}"), f"__a{axis}", keys, [frame], f"__s{axis}", 9)
    t = t.withColumn("accel_v", F.sqrt(F.col("__sx") ** 2 + F.col("__sy") ** 2))
    return t.drop("__vx", "__vy", "__as", "__ax", "__ay", "__sx", "__sy")

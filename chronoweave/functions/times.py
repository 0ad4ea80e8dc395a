"""Time functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp_ntz since 1970, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def format_clock(seconds: Column) -> Column:
    """'MM:SS.ff' from rounded hundredths, so a carry is never lost."""
    c = F.rint(seconds * 100).cast("long")
    return F.format_string("%02d:%02d.%02d", F.floor(c / 6000).cast("long"), F.floor(c / 100).cast("long") % 60, c % 100)


def parse_clock(text: Column) -> Column:
    """Seconds of 'MM:SS.ff'; null if it is none."""
    p = F.split(text, ":")
    return F.get(p, F.lit(0)).try_cast("double") * 60 + F.get(p, F.lit(1)).try_cast("double")


def frame_of(seconds: Column, fps: int = 25) -> Column:
    return F.rint(seconds * fps).cast("long")


def seconds_of_frame(frame: Column, fps: int = 25) -> Column:
    return frame / F.lit(float(fps))


def clock_to_frame(text: Column, fps: int = 25) -> Column:
    return frame_of(parse_clock(text), fps)


def shift(ts: Column, us: Column) -> Column:
    """A timestamp moved by microseconds."""
    return F.timestamp_add("MICROSECOND", us, ts)


def utc_of_frame(frame: Column, start: Column, fps: int = 25) -> Column:
    """The time of a frame counted from ``start``; null frames stay null."""
    return shift(start, F.rint(frame * (1_000_000 / fps)).cast("long"))


def display_clock(seconds: Column) -> Column:
    """'MM:SS.ss' as shown on a frame, from rounded hundredths; the same as ``format_clock`` for whole hundredths."""
    return format_clock(F.rint(seconds * 100) / 100)


def utc_from_zoned(text: Column) -> Column:
    """timestamp_ntz in UTC of an ISO time with its zone ('...+02:00' or '...Z'), whatever the session's time zone."""
    micros_ = F.unix_micros(F.to_timestamp(text))
    return F.timestamp_add("MICROSECOND", micros_, F.lit("1970-01-01").cast("timestamp_ntz"))

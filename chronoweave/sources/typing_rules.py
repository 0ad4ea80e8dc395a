"""Event typing by ordered rules, as one CASE expression each.

Neighbour conditions use windows within a match, so nothing leaks between matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rules(ordered: list[tuple[Column, object]], default: Column | None = None) -> Column:
    """Rules in writing order, of which the last that holds wins."""
    case = None
    for cond, value in reversed(ordered):
        v = value if isinstance(value, Column) else F.lit(value)
        case = F.when(cond, v) if case is None else case.when(cond, v)
    if case is None:
        return F.lit(None).cast("string") if default is None else default
    return case if default is None else case.otherwise(default)

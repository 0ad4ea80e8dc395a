"""Table contracts, checked by one aggregate each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab


class ContractError(ValueError):
    pass


@dataclass(frozen=True)
class Contract:
    """types: column -> Spark type name; nullable: columns that may be null; checks: name -> Column that must not be false."""

    types: dict[str, str]
    nullable: frozenset[str] = frozenset()
    checks: dict[str, object] = field(default_factory=dict)

    def rules(self) -> dict[str, Column]:
        out = {f"{c}_not_null": F.col(c).isNotNull() for c in self.types if c not in self.nullable}
        return out | {name: rule() for name, rule in self.checks.items()}


def validate(df: DataFrame, contract: Contract, raise_on_error: bool = False) -> DataFrame:
    """rule, violations: one row a rule, from one pass over the table; missing or mistyped columns are violations of all rows."""
    have = dict(df.dtypes)
    shape = [f"{c}_type" for c, t in contract.types.items() if have.get(c) != t]
    usable = {n: r for n, r in contract.rules().items() if not any(n.startswith(f"{c}_") or n == c for c in contract.types if c not in have)}
    counted = df.agg(*[F.count_if(~F.coalesce(r, F.lit(True))).alias(n) for n, r in usable.items()], F.count("*").alias("__n"))
    rows = counted.unpivot([], [*usable, "__n"], "rule", "violations")
    out = rows.where("rule <> '__n'")
    if shape:
        out = out.unionByName(rows.where("rule = '__n'").withColumn("rule", F.explode(F.array(*[F.lit(s) for s in shape]))))
    if raise_on_error:
        bad = out.where("violations > 0").collect()  # one row a rule at most
        if bad:
            raise ContractError(", ".join(f"{r['rule']}: {r['violations']}" for r in bad))
    return out


def _in(col: str, values) -> object:
    return lambda: F.col(col).isin(list(values))


def _between(col: str, lo, hi) -> object:
    return lambda: F.col(col).isNull() | F.col(col).between(lo, hi)


EVENTS = Contract(
    {"match_id": "string", "event_idx": "bigint", "period_id": "bigint", "utc_timestamp": "timestamp_ntz", "player_id": "string", "spadl_type": "string", "success": "boolean"},
    checks={"period_id_known": _in("period_id", (1, 2)), "spadl_type_known": _in("spadl_type", vocab.TYPES)},
)
LOCATED_EVENTS = Contract(
    {k: v for k, v in EVENTS.types.items() if k != "success"} | {"start_x": "double", "start_y": "double"},
    checks=EVENTS.checks | {"start_x_range": _between("start_x", 0, vocab.PITCH_X), "start_y_range": _between("start_y", 0, vocab.PITCH_Y)},
)
TRACKING = Contract(
    {"match_id": "string", "frame_id": "bigint", "period_id": "bigint", "timestamp": "double", "utc_timestamp": "timestamp_ntz", "player_id": "string", "ball": "boolean", "x": "double", "y": "double", "z": "double", "speed": "double", "accel_s": "double", "accel_v": "double"},
    nullable=frozenset({"player_id", "z"}),
    checks={"period_id_known": _in("period_id", (1, 2)), "frame_id_range": lambda: F.col("frame_id") >= 0, "z_range": lambda: F.col("z").isNull() | (F.col("z") >= 0)},
)
SYNCED = Contract(EVENTS.types | {"frame_id": "bigint", "receiver_id": "string", "receive_frame_id": "bigint"}, nullable=frozenset({"frame_id", "receiver_id", "receive_frame_id"}), checks=EVENTS.checks)

"""Reshaping, merging, de-duplication and small relational helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Equi-join on all common columns; null keys match nothing."""
    return a.join(b, [c for c in a.columns if c in b.columns], how)


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, value: str, out: str, order: list | None = None) -> DataFrame:
    """Dictionary join on a key that is made unique first (the last in ``order`` wins)."""
    last = F.max_by(value, F.struct(*order)) if order else F.max(value)
    d = dim.groupBy(F.col(dim_key).alias("__k")).agg(last.alias(out))
    return df.join(d, df[key] == d["__k"], "left").drop("__k")


def single_valued(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of keys with exactly one distinct value (a semi-join)."""
    ok = df.groupBy(key).agg(F.count_distinct(value).alias("__n")).where("__n = 1").select(key)
    return df.join(ok, key, "left_semi")


def unpivot_objects(df: DataFrame, ids: list[str], prefix: str, measures: list[str]) -> DataFrame:
    """Wide columns ``<object>_<measure>`` into one row an object, in one pass.  Objects come from the column names."""
    names = list(dict.fromkeys(c[: -len(m) - 1] for m in measures for c in df.columns if c.endswith(f"_{m}") and c.startswith(prefix)))
    null = F.lit(None).cast("double")
    rows = F.array(*[F.struct(F.lit(n).alias("object_id"), *[(F.col(f"{n}_{m}").cast("double") if f"{n}_{m}" in df.columns else null).alias(m) for m in measures]) for n in names])
    return df.select(*ids, F.inline(rows))


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are null in every row; one aggregate."""
    n = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if n[c]])


def keep_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def strided(df: DataFrame, keys: list[str], order: list[str], step: int) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).where(F.col("__k") % step == 0).drop("__k")


def histogram2d(df: DataFrame, x: str, y: str, x_max: float, y_max: float, n: int = 50, m: int = 50) -> DataFrame:
    """bin, n of an n by m grid, row by row from the top; empty bins count 0."""
    i = F.least(F.greatest(F.floor(F.col(x) / x_max * n), F.lit(0)), F.lit(n - 1))
    j = F.least(F.greatest(F.floor(F.col(y) / y_max * m), F.lit(0)), F.lit(m - 1))
    got = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy((n * (m - 1 - j) + i).cast("long").alias("bin")).count()
    return df.sparkSession.range(n * m).withColumnRenamed("id", "bin").join(got, "bin", "left").select("bin", F.coalesce("count", F.lit(0).cast("long")).alias("n"))


def flip_if(col: str, flip: Column, length: float) -> Column:
    return F.when(flip, F.rint((length - F.col(col)) * 100) / 100).otherwise(F.col(col))


def merge_streams(frames: DataFrame, events: DataFrame, keys: list[str], frame: str, fill: list[str]) -> DataFrame:
    """Frames left-joined with events on an integer frame key, then filled forward over the series; several events of a frame repeat it."""
    j = frames.join(events, [*keys, frame], "left")
    w = Window.partitionBy(*keys).orderBy(frame, *fill[:1]).rowsBetween(Window.unboundedPreceding, 0)
    return j.withColumns({c: F.last(c, True).over(w) for c in fill})


def accuracy(df: DataFrame, diff: str, group: str, ks=(0, 5, 25, 50)) -> DataFrame:
    """Counts and rates of |diff| within limits by group and in total, by grouping sets."""
    a = F.abs(F.col(diff))
    out = df.groupingSets([[F.col(group)], []], F.col(group)).agg(
        F.count("*").alias("total"), F.round(F.avg(a), 6).alias("mean_diff"), *[F.count_if(a <= k).alias("exact" if k == 0 else f"within_{k}") for k in ks], F.count(diff).alias("valid")
    )
    rates = [(F.round(F.try_divide(F.col(c), F.col("total")), 6)).alias(f"{c}_rate") for c in ["exact", *[f"within_{k}" for k in ks if k], "valid"]]
    return out.select(F.coalesce(group, F.lit("total")).alias("category"), "total", "mean_diff", "exact", *[f"within_{k}" for k in ks if k], "valid", *rates)


def valid_range(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """keys, column, first, last: where each column begins and ceases to be known; columns that never are have no row."""
    at = [F.struct(F.lit(c).alias("column"), F.min(F.when(F.col(c).isNotNull(), F.col(order))).alias("first"), F.max(F.when(F.col(c).isNotNull(), F.col(order))).alias("last")) for c in columns]
    return df.groupBy(*keys).agg(*[a.alias(f"__{i}") for i, a in enumerate(at)]).select(*keys, F.inline(F.array(*[F.col(f"__{i}") for i in range(len(columns))]))).where("first is not null")


def first_valid(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """keys, column, value: the first known value of each column (as text)."""
    at = [F.struct(F.lit(c).alias("column"), F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), F.col(order))).alias("value")) for c in columns]
    return df.groupBy(*keys).agg(*[a.alias(f"__{i}") for i, a in enumerate(at)]).select(*keys, F.inline(F.array(*[F.col(f"__{i}") for i in range(len(columns))]))).where("value is not null")


def by_appearance(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "place") -> DataFrame:
    """keys, value, place: distinct values numbered from 0 in the order in which they first appear."""
    first = df.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("__at"))
    return first.select(*keys, value, (F.row_number().over(Window.partitionBy(*keys).orderBy("__at")) - 1).cast("long").alias(out))


def padded_lines(df: DataFrame, columns: list[str], out: str = "line") -> DataFrame:
    """One text a row: the columns padded to their longest value, joined by ' | '; nulls are blank."""
    texts = df.withColumns({f"__{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})
    widths = texts.agg(*[F.coalesce(F.max(F.length(f"__{c}")), F.lit(0)).alias(c) for c in columns]).first()  # one row
    return texts.withColumn(out, F.concat_ws(" | ", *[F.rpad(f"__{c}", widths[c], " ") for c in columns])).drop(*[f"__{c}" for c in columns])


def segments(df: DataFrame, frame: str, start: int, size: int, out: str = "segment") -> DataFrame:
    """Rows from ``start`` on with the number of their chunk of ``size`` frames."""
    return df.where(F.col(frame) >= start).withColumn(out, F.floor((F.col(frame) - start) / size))

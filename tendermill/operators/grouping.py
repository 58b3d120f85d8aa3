"""Shares, group statistics, top lists, pivots and set operations."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_sum(column: Column | str, digits: int = 8) -> Column:
    """Sum that does not depend on the order of the rows.

    Totals that later serve as an ordering or join value must come out the same when
    a lost task is run again; a double sum does not promise that, a decimal one does.
    """
    c = F.col(column) if isinstance(column, str) else column
    return F.sum(c.cast(f"decimal(28,{digits})")).cast("double")


def null_safe_join(df: DataFrame, per_group: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    """Join one row per group back to the rows; rows with null keys are a group like others."""
    keys = list(keys)
    right = per_group.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return df.join(right, same, how).drop(*(f"_key_{k}" for k in keys))


def with_group_stats(df: DataFrame, keys: Iterable[str], **stats: Column) -> DataFrame:
    """Group statistics joined back to the rows.

    A join instead of a window: the statistics are one small row per group, so a hot
    group is aggregated on the map side and its rows stay spread over the cluster.
    """
    keys = list(keys)
    per_group = df.groupBy(*keys).agg(*(c.alias(n) for n, c in stats.items()))
    if not keys:
        raise ValueError("name the group's keys; with_whole_stats needs none")
    return null_safe_join(df, per_group, keys)


def with_row(df: DataFrame, row: DataFrame, name: str) -> DataFrame:
    """Add a one-row frame to every row as the struct column ``name``.

    The row is a scalar subquery computed once, and held in one column: repeating the
    subquery in every expression that uses it would plan it again each time.
    """
    return df.withColumn(name, row.select(F.struct(*row.columns)).scalar())


def with_whole_stats(df: DataFrame, name: str, **stats: Column) -> DataFrame:
    """Statistics of all rows as the struct column ``name``."""
    return with_row(df, df.agg(*(c.alias(n) for n, c in stats.items())), name)


def with_share(df: DataFrame, value: str, keys: Iterable[str] = (), result: str = "share") -> DataFrame:
    """Percent of the group's (or the whole) total."""
    keys = list(keys)
    if keys:
        out = with_group_stats(df, keys, _total=F.sum(value))
        return out.withColumn(result, F.try_divide(F.col(value), F.col("_total")) * 100).drop("_total")
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(result, F.try_divide(F.col(value), total) * 100)


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_in_group(df: DataFrame, keys: Iterable[str], k: int, *order: Column | str, rank: str = "rank") -> DataFrame:
    """First k rows of each group. Spark cuts each map side to k before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def ranked_rows(df: DataFrame, *order: Column | str, rank: str = "rank") -> DataFrame:
    """Rank of every row of a frame known to be small (one row per group, month or class)."""
    return df.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def top_and_bottom(df: DataFrame, k: int, value: str, tie: str) -> DataFrame:
    best = top(df, k, F.desc(value), tie).withColumn("side", F.lit("top"))
    worst = top(df, k, F.asc(value), tie).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def value_counts(df: DataFrame, column: str, result: str = "n") -> DataFrame:
    """Non-null values by falling count."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(result))
        .orderBy(F.desc(result), column)
    )


def keep_keys_of(df: DataFrame, keys_frame: DataFrame, key: str) -> DataFrame:
    """Semi join to a list of keys."""
    return df.join(keys_frame.select(key), key, "left_semi")


def pivoted(df: DataFrame, index: Iterable[str], column: str, values: Iterable, cell: Column, fill: float | None = 0.0,
            prefix: str = "") -> DataFrame:
    """Pivot over a given value list, so the schema is fixed and no extra job looks for values."""
    values = list(values)
    out = df.groupBy(*index).pivot(column, values).agg(cell)
    named = out.withColumnsRenamed({str(v): f"{prefix}{v}" for v in values})
    return named if fill is None else named.fillna(fill)


def months_between(start: date, end: date) -> list[str]:
    """``yyyy-MM`` labels of a date range chosen by the user."""
    first, last = start.year * 12 + start.month - 1, end.year * 12 + end.month - 1
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(first, last + 1)]


def month_spine(df: DataFrame, date_column: str, result: str = "month") -> DataFrame:
    """Every month from the first to the last date: one row each, whatever the row count."""
    bounds = df.agg(F.min(date_column).alias("a"), F.max(date_column).alias("b"))
    return bounds.select(
        F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias(result)
    )


def stacked(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def common_values(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def values_without(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.distinct().join(right.distinct(), left.columns, "left_anti")

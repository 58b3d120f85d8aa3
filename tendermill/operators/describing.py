"""Summaries of numeric columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.operators import grouping
from tendermill.operators.quantiles import exact_quantiles

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def column_summary(df: DataFrame, column: str, keys: Iterable[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, least, exact quartiles and most of a column."""
    keys = list(keys)
    plain = df.groupBy(*keys).agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("least"), F.max(column).alias("most"))
    quartiles = exact_quantiles(df, keys, column, QUARTILES)
    order = [*keys, "n", "mean", "std", "least", *QUARTILES, "most"]
    if keys:
        return plain.join(quartiles, keys, "left").select(*order)
    found = grouping.with_row(plain, quartiles, "_q")
    return found.select("*", *(F.col(f"_q.{q}") for q in QUARTILES)).select(*order)


def column_summaries(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One row per column."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                         for c in columns))).alias("e")).select("e.*")
    return column_summary(long, "value", ["feature"])

"""Outlier rules."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.operators import grouping
from tendermill.operators.quantiles import exact_quantiles, running_totals


def sigma_bounds(df: DataFrame, keys: Iterable[str], columns: Iterable[str], sigmas: float = 3.0) -> DataFrame:
    """Rows beyond mean +/- ``sigmas`` sample deviations of their group in any column."""
    columns = list(columns)
    stats = {}
    for c in columns:
        stats[f"_{c}_mean"], stats[f"_{c}_std"] = F.avg(c), F.stddev_samp(c)
    joined = grouping.with_group_stats(df, keys, **stats)
    beyond = [
        (F.col(c) < F.col(f"_{c}_mean") - sigmas * F.col(f"_{c}_std"))
        | (F.col(c) > F.col(f"_{c}_mean") + sigmas * F.col(f"_{c}_std"))
        for c in columns
    ]
    return joined.where(reduce(or_, beyond)).drop(*stats)


def z_scored(series: DataFrame, value: str, least: float = 2.0) -> DataFrame:
    """Population z-score of each point of a series and whether it is an outlier."""
    whole = grouping.with_whole_stats(series, "_whole", mean=F.avg(value), std=F.stddev_pop(value))
    z = F.try_divide(F.col(value) - F.col("_whole.mean"), F.col("_whole.std"))
    scored = whole.withColumn("z", z).drop("_whole")
    return scored.withColumn("is_outlier", F.coalesce(F.abs("z") >= least, F.lit(False)))


def fence(df: DataFrame, value: str, width: float = 1.5) -> DataFrame:
    """One row with the quartile fence of a column: ``low`` and ``high``."""
    q = exact_quantiles(df, [], value, {"q1": 0.25, "q3": 0.75})
    step = (F.col("q3") - F.col("q1")) * width
    return q.select((F.col("q1") - step).alias("low"), (F.col("q3") + step).alias("high"))


def fenced(df: DataFrame, columns: Iterable[str], width: float = 1.5) -> DataFrame:
    """Mark rows outside the fence in any of the columns."""
    columns = list(columns)
    out = df
    for c in columns:
        out = grouping.with_row(out, fence(df, c, width), f"_fence_{c}")
    outside = [(F.col(c) < F.col(f"_fence_{c}.low")) | (F.col(c) > F.col(f"_fence_{c}.high")) for c in columns]
    marked = out.withColumn("is_outlier", F.coalesce(reduce(or_, outside), F.lit(False)))
    return marked.drop(*(f"_fence_{c}" for c in columns))


def without_outliers(series: DataFrame, value: str, width: float = 1.5) -> DataFrame:
    return fenced(series, [value], width).where(~F.col("is_outlier")).drop("is_outlier")


def above_quantile(df: DataFrame, value: str, q: float, tie: str) -> DataFrame:
    """Rows above the exact quantile, numbered by falling value."""
    bound = exact_quantiles(df, [], value, {"q": q}).select("q").scalar()
    return running_totals(df.where(F.col(value) > bound), [], value, [tie]).drop("running", "group_total", "group_rows")


def mahalanobis(df: DataFrame, columns: Iterable[str], contamination: float = 0.05) -> DataFrame:
    """Distance from the mean in units of the covariance; the far ``contamination`` share is anomalous.

    The moments are one aggregate row. The covariance of the few columns is
    inverted in closed form by the adjugate, so rows only meet column expressions.
    Like any estimator it is fitted first: two small jobs that bring one row each.
    """
    columns = list(columns)
    if len(columns) != 3:
        raise ValueError("three columns are compared: unit price, total and quantity")
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    kept = df.where(complete)
    stats = {f"m{i}": F.avg(c) for i, c in enumerate(columns)}
    for i in range(3):
        for j in range(i, 3):
            stats[f"c{i}{j}"] = F.covar_samp(columns[i], columns[j])
    c = [[F.col(f"c{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]

    def minor(i, j):
        r = [x for x in range(3) if x != i]
        k = [x for x in range(3) if x != j]
        return (c[r[0]][k[0]] * c[r[1]][k[1]] - c[r[0]][k[1]] * c[r[1]][k[0]]) * (-1) ** (i + j)

    determinant = sum((c[0][j] * minor(0, j) for j in range(3)), F.lit(0.0))
    moments = kept.agg(*(e.alias(n) for n, e in stats.items())).withColumn("det", determinant)
    weights = {f"w{i}{j}": F.try_divide(minor(i, j), F.col("det")) * (1 if i == j else 2)
               for i in range(3) for j in range(i, 3)}
    # the fit: one row of three means and six weights, then one bound; rows meet plain literals
    fit = moments.select("m0", "m1", "m2", *(w.alias(n) for n, w in weights.items())).first()
    x = [F.col(name) - F.lit(fit[f"m{i}"]) for i, name in enumerate(columns)]
    distance = sum((x[i] * x[j] * F.lit(fit[f"w{i}{j}"]) for i in range(3) for j in range(i, 3)), F.lit(0.0))
    scored = kept.withColumn("distance", distance)
    bound = exact_quantiles(scored, [], "distance", {"q": 1 - contamination}).first()["q"]
    return scored.withColumn("is_anomaly", F.col("distance") > F.lit(bound))

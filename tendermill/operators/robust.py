"""Distances that the outliers they look for cannot mask: a trimmed centre and covariance by concentration steps.

Starting from medians, the nearest share of the rows is kept, its mean and covariance measure all rows anew, and so on
until the determinant of the covariance falls no further; it cannot rise, as each step keeps the nearest rows. A step is
one exact quantile and one aggregate row, so only a few numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendermill.operators.quantiles import exact_quantiles
from tendermill.session import stored


def _distance(names: list[str], centre: np.ndarray, weights: np.ndarray) -> Column:
    x = [F.col(n) - F.lit(float(m)) for n, m in zip(names, centre)]
    n = len(names)
    return sum((x[i] * x[j] * F.lit(float(weights[i, j] * (1 if i == j else 2))) for i in range(n) for j in range(i, n)), F.lit(0.0))


def _moments(df: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = len(names)
    row = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(names)),
                 *(F.covar_samp(names[i], names[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n))).first()
    spread = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    return np.array([row[f"m{i}"] for i in range(n)]), spread


def trimmed_distance(df: DataFrame, columns: Iterable[str], kept: float = 0.75, contamination: float = 0.05, settled: float = 1e-4) -> DataFrame:
    """Complete rows with ``robust_distance`` (squared, from the trimmed centre) and ``is_anomaly`` (the far ``contamination`` share).

    Rows with a null or non-finite value in ``columns`` are left out. ``kept`` is the share of rows behind centre and
    covariance, so up to ``1 - kept`` of the rows, wherever they lie, cannot move them. Columns are put on the scale of
    their median distance from the median first (of the deviation where that is 0); columns that do not vary count for
    nothing. Rows at the edge of the share that lie equally far are all kept. Steps end when the determinant falls by
    less than ``settled`` of itself. An empty table stays empty.
    """
    columns = list(columns)
    names = [f"_robust_{i}" for i in range(len(columns))]
    finite = F.lit(True)
    for c in columns:
        v = F.col(c).cast("double")
        finite = finite & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    rows = df.where(finite)
    raw = stored(rows.select(*(F.col(c).cast("double").alias(n) for c, n in zip(columns, names))))
    if raw.isEmpty():
        return rows.withColumns({"robust_distance": F.lit(0.0), "is_anomaly": F.lit(False)})
    middle, scale = [], []
    deviations = raw.agg(*(F.stddev_pop(n).alias(n) for n in names)).first()
    for n in names:
        middle.append(exact_quantiles(raw, [], n, {"q": 0.5}, reread=True).first()["q"])
        away = raw.select(F.abs(F.col(n) - F.lit(middle[-1])).alias("away"))
        scale.append(exact_quantiles(away, [], "away", {"q": 0.5}, reread=True).first()["q"] or deviations[n] or 1.0)

    def unit(n: str, c: Column) -> Column:
        i = names.index(n)
        return (c - F.lit(float(middle[i]))) / F.lit(float(scale[i]))

    points = raw.select(*(unit(n, F.col(n)).alias(n) for n in names))
    centre, weights, before = np.zeros(len(names)), np.eye(len(names)), np.inf
    while True:
        far = points.withColumn("_far", _distance(names, centre, weights))
        bound = exact_quantiles(far, [], "_far", {"q": kept}, reread=True).first()["q"]
        next_centre, spread = _moments(far.where(F.col("_far") <= F.lit(bound)), names)
        size = float(np.linalg.det(spread))
        if not size < before * (1 - settled):
            break
        centre, weights, before = next_centre, np.linalg.pinv(spread, hermitian=True), size
    scored = rows.withColumns({n: unit(n, F.col(c).cast("double")) for c, n in zip(columns, names)})
    scored = scored.withColumn("robust_distance", _distance(names, centre, weights)).drop(*names)
    bound = exact_quantiles(points.withColumn("_far", _distance(names, centre, weights)), [], "_far", {"q": 1 - contamination}, reread=True).first()["q"]
    return scored.withColumn("is_anomaly", F.col("robust_distance") > F.lit(bound))

"""Trimmed distances against the same steps in numpy, and planted outliers that plain moments let pass."""

import numpy as np
import pandas as pd

from tendermill.operators.outliers import mahalanobis
from tendermill.operators.robust import trimmed_distance

COLUMNS = ["a", "b", "c"]


def table(spark, planted=True):
    rng = np.random.default_rng(12)
    plain = rng.normal(size=(380, 3)) @ np.array([[3.0, 1, 0], [0, 2, 0.5], [0, 0, 1]]) + [100, 50, 10]
    far = rng.normal(0, 0.1, (20, 3)) + [130, 20, 30]
    raw = np.vstack([plain, far]) if planted else plain
    return raw, spark.createDataFrame(pd.DataFrame(raw, columns=COLUMNS).assign(id=range(len(raw))))


def brute(raw, kept):
    middle = np.median(raw, axis=0)
    x = (raw - middle) / np.median(np.abs(raw - middle), axis=0)
    centre, weights, before = np.zeros(3), np.eye(3), np.inf
    while True:
        far = np.einsum("ni,ij,nj->n", x - centre, weights, x - centre)
        inner = x[far <= np.quantile(far, kept)]
        spread = np.cov(inner.T)
        if not np.linalg.det(spread) < before * (1 - 1e-4):
            return far
        centre, weights, before = inner.mean(axis=0), np.linalg.inv(spread), np.linalg.det(spread)


def test_equals_numpy_and_planted_rows_are_far(spark):
    raw, df = table(spark)
    got = trimmed_distance(df, COLUMNS).orderBy("id").toPandas()
    assert np.allclose(got["robust_distance"], brute(raw, 0.75), rtol=1e-6)
    assert got["is_anomaly"].sum() == 20 and set(np.flatnonzero(got["is_anomaly"])) == set(range(380, 400))
    masked = mahalanobis(df, COLUMNS).orderBy("id").toPandas()["distance"].to_numpy()
    robust = got["robust_distance"].to_numpy()
    assert robust[380:].min() / np.median(robust[:380]) > 5 * masked[380:].min() / np.median(masked[:380])


def test_nulls_constants_empty(spark):
    rows = [(float(k), 1.0, float(k % 3)) for k in range(30)] + [(None, 1.0, 0.0), (float("nan"), 1.0, 0.0), (1.0, float("inf"), 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = trimmed_distance(df, COLUMNS).collect()
    assert len(got) == 30 and all(np.isfinite(r["robust_distance"]) for r in got)
    assert trimmed_distance(df.limit(0), COLUMNS).count() == 0

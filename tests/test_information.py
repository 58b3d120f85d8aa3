import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tendermill.operators.information import digamma, mutual_information


def psi(m):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(m)))


def brute(x, y, k=3):
    """The estimator over all pairs."""
    x, y = ((v - v.mean()) / (v.std() or 1) for v in (x, y))
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    total, n = 0.0, len(x)
    for i in range(n):
        both = np.maximum(dx[i], dy[i])
        r = np.sort(both)[k]
        inside = r - 1e-9 * r
        own = k if r > 0 else (both == 0).sum()
        total += psi(n) + psi(own) - psi((dx[i] <= inside).sum()) - psi((dy[i] <= inside).sum())
    return max(total / n, 0.0)


def test_digamma(spark):
    got = spark.range(1, 40).select("id", digamma(F.col("id")).alias("v")).collect()
    assert all(r["v"] == pytest.approx(psi(r["id"]), abs=2e-9) for r in got)


def test_equals_all_pairs_in_each_group(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 300))
    whole = rng.integers(0, 4, 300).astype(float)
    groups = {
        "line": (a, 0.8 * a + 0.6 * b),
        "none": (a, b),
        "circle": (np.cos(a * 9), np.sin(a * 9) * 50),
        "whole": (whole, whole * 2 + rng.integers(0, 2, 300)),
        "hot": (np.where(np.arange(300) < 120, 5.0, a), np.where(np.arange(300) < 120, 1.0, b)),
        "still": (np.full(300, 3.0), b),
        None: (a * 1000, a * a),
    }
    rows = [(g, float(x), float(y)) for g, (xs, ys) in groups.items() for x, y in zip(xs, ys)]
    rows += [("few", 1.0, 2.0), ("few", 2.0, 1.0), ("line", None, 1.0), ("line", float("nan"), 1.0), ("line", 1.0, float("inf"))]
    got = {r["g"]: r["mutual_information"] for r in mutual_information(
        spark.createDataFrame(rows, "g string, x double, y double"), "g", "x", "y").collect()}
    assert set(got) == {*groups, "few"} and got.pop("few") is None
    for g, (x, y) in groups.items():
        assert got[g] == pytest.approx(brute(x, y), abs=1e-6), g
    assert got["line"] == pytest.approx(-0.5 * math.log(1 - 0.64), abs=0.12)
    assert got["none"] < 0.1 and got["circle"] > 0.5


def test_no_rows(spark):
    assert mutual_information(spark.createDataFrame([], "g string, x double, y double"), "g", "x", "y").count() == 0


def test_ranking_of_features(spark, tiny):
    from tendermill.catalog import load
    rows = load()["feature_ranking"].run(spark, tiny).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and len({r["feature"] for r in rows}) == len(rows)
    assert all(r["mutual_information"] >= 0 and -1e-3 <= r["score"] <= 1.001 for r in rows)
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert any(r["mutual_information"] > 0.05 for r in rows)

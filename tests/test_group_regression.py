"""Predictions of all groups in one job, against each group taken alone and against the conditions of the best weights."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendermill.functions.linear import LINEAR_MODELS, best_linear, penalised
from tendermill.plans import series
from tendermill.plans.group_regression import next_week_by_group


@pytest.mark.parametrize("name", list(LINEAR_MODELS))
def test_weights_are_the_best(name):
    penalty, absolute = LINEAR_MODELS[name]
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 6))
    x[:, 5] = x[:, 4]  # a column twice
    y = 3 * x[:, 0] - 0.05 * x[:, 1] + rng.normal(0, 0.1, 80) + 7
    w, b = penalised(x, y, penalty, absolute)
    left = y - x @ w - b
    assert abs(left.mean()) < 1e-9
    slope = -x.T @ left / len(y) + penalty * (1 - absolute) * w
    kept = np.abs(w) > 1e-9
    assert np.allclose(slope[kept], -penalty * absolute * np.sign(w[kept]), atol=1e-6)
    assert (np.abs(slope[~kept]) <= penalty * absolute + 1e-6).all()


def test_constant_columns_and_targets():
    x, y = np.ones((30, 3)), np.full(30, 5.0)
    model, score, guess = best_linear(x, y, np.arange(30) >= 20, np.ones(3), use_log=False)
    assert (model, score, round(guess, 9)) == ("Linear Regression", -math.inf, 5.0)


def contracts(spark):
    rng = np.random.default_rng(8)
    rows = []
    for project, weeks in (("a", 60), (None, 45), ("short", 10), ("once", 1)):
        for week in range(weeks):
            for k in range(int(rng.integers(1, 4))):
                amount = float(round(100 + 10 * week + 30 * rng.random(), 2))
                rows.append((project, dt.date(2020, 1, 6) + dt.timedelta(days=7 * week + k), f"{project}-{week}-{k}", f"s{k}", amount / 4, amount))
    rows.append(("undated", None, "x", "s", 1.0, 4.0))
    return spark.createDataFrame(rows, "project_name string, contract_signing_date date, contract_number string, "
                                       "counterparty_name string, unit_price_eur double, total_contract_amount_eur double")


def test_each_group_as_if_alone(spark):
    table = contracts(spark)
    got = {r["project_name"]: r for r in next_week_by_group(table).collect()}
    assert set(got) == {"a", None, "short", "once"}
    assert got["short"]["model"] is None and got["short"]["predicted"] is None and got["once"]["weeks"] == 1
    for project, weeks in (("a", 60), (None, 45)):
        own = table.where(F.col("project_name").eqNullSafe(F.lit(project)) & F.col("contract_signing_date").isNotNull())
        alone = series.weekly_features(own).orderBy("contract_week").toPandas()
        columns = [c for c in alone.columns if c not in ("contract_week", "target")]
        x, y = alone[columns].to_numpy(float), alone["target"].to_numpy(float)
        whole = np.isfinite(x).all(axis=1)
        known = whole & np.isfinite(y)
        n = int(known.sum())
        at = np.flatnonzero(whole)[-1]
        model, score, guess = best_linear(x[known], y[known], np.arange(n) >= n - math.ceil(0.3 * n), x[at], True)
        row = got[project]
        assert (row["weeks"], row["complete_weeks"], row["model"], row["last_week"]) == (weeks, n, model, alone["contract_week"][at])
        assert row["predicted"] == pytest.approx(guess, rel=1e-6) and row["r2_test"] == pytest.approx(score, rel=1e-6)
        assert row["mean"] == pytest.approx(alone["total_amount"].mean()) and row["median"] == pytest.approx(alone["total_amount"].median())
        assert row["deviation_percent"] == pytest.approx((guess - row["mean"]) / row["mean"] * 100)


def test_empty_table(spark):
    assert next_week_by_group(contracts(spark).limit(0)).count() == 0

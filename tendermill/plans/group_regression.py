"""Next week of every project (or other group) in one job.

Contracts are folded to one row per group and week by Spark. What is left of a group is bounded by the calendar, about
52 rows a year, so its four linear models are fitted in one call per group: the work is dealt by group over the cluster,
and no list of groups passes through the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from tendermill.functions.linear import best_linear
from tendermill.plans import series
from tendermill.plans.regression import NOT_FEATURES

#: Complete weeks below which a group gets no prediction (the diagnosis calls a series too short there).
LEAST_WEEKS = 20


def next_week_by_group(contracts: DataFrame, key: str = "project_name", lags: int = series.LAGS, test_share: float = series.TEST_SHARE,
                       use_log: bool = True, least_weeks: int = LEAST_WEEKS) -> DataFrame:
    """(key, last_week, weeks, complete_weeks, model, r2_test, predicted, mean, median, deviation_percent), one row per group.

    The model is the one of linear, ridge, lasso and elastic net regression with the highest R2 on the last weeks; trees
    are compared over all contracts together (``regression``). ``weeks`` counts weeks with contracts, ``complete_weeks`` those
    with all lags and a target. The prediction starts from the last week with all lags; r2_test is null where the test
    weeks do not vary. Groups with fewer than ``least_weeks`` complete weeks have a null model and prediction; a null
    key is a group like others; contracts without a signing date belong to no week and are left out.
    """
    features = series.weekly_features(contracts.where("contract_signing_date IS NOT NULL"), key, lags=lags, use_log=use_log)
    columns = [f.name for f in features.schema.fields if f.name not in NOT_FEATURES | {key}]
    table = features.selectExpr(f"`{key}`", "contract_week", "cast(target AS double) AS target",
                                *(f"cast(`{c}` AS double) AS `{c}`" for c in columns))
    total = columns.index("total_amount")

    def run(weeks: pd.DataFrame) -> pd.DataFrame:
        weeks = weeks.sort_values("contract_week")
        x, y = weeks[columns].to_numpy(np.float64), weeks["target"].to_numpy(np.float64)
        whole = np.isfinite(x).all(axis=1)
        known = whole & np.isfinite(y)
        amounts = x[:, total]
        mean, median = float(np.mean(amounts)), float(np.median(amounts))
        last, model, score, guess = None, None, None, None
        if whole.any():
            at = int(np.flatnonzero(whole)[-1])
            last = weeks["contract_week"].iloc[at]
        n = int(known.sum())
        if n >= max(least_weeks, 2):
            test = np.arange(n) >= n - math.ceil(n * test_share)
            model, score, guess = best_linear(x[known], y[known], test, x[at], use_log)
        return pd.DataFrame({
            key: [weeks[key].iloc[0]], "last_week": [last], "weeks": [len(weeks)], "complete_weeks": [n], "model": [model],
            "r2_test": pd.array([score if score is not None and np.isfinite(score) else None], dtype="Float64"),
            "predicted": pd.array([guess], dtype="Float64"), "mean": [mean], "median": [median],
            "deviation_percent": pd.array([None if guess is None or mean == 0 else (guess - mean) / mean * 100], dtype="Float64")})

    schema = StructType([StructField(key, table.schema[key].dataType), *StructType.fromDDL(
        "last_week date, weeks long, complete_weeks long, model string, r2_test double, predicted double, mean double, "
        "median double, deviation_percent double").fields])
    return table.groupBy(key).applyInPandas(run, schema)

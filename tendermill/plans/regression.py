"""Regression on the weekly features: ranking of features, comparison of models, next week.

The training table has one row per week, so every fit here is small; the heavy part,
folding contracts to weeks, is done before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.operators import grouping
from tendermill.operators.information import mutual_information
from tendermill.plans import series
from tendermill.session import checkpointed

SEED = 42
NOT_FEATURES = {"contract_week", "target", "is_test"}
# Weights of the three rankings, overfit gap that is flagged.
RANKING = {"forest": 0.4, "f_score": 0.3, "mutual_information": 0.3}
OVERFIT = 0.3


def models(trees: int = 200, rounds: int = 200) -> dict:
    """The compared models. Ridge and lasso are linear regressions with a penalty."""
    common = {"featuresCol": "features", "labelCol": "target"}
    return {
        "Random Forest": RandomForestRegressor(numTrees=trees, maxDepth=8, minInstancesPerNode=5, featureSubsetStrategy="sqrt",
                                               seed=SEED, **common),
        "Gradient Boosting": GBTRegressor(maxIter=rounds, maxDepth=5, stepSize=0.1, minInstancesPerNode=5,
                                          seed=SEED, **common),
        "Linear Regression": LinearRegression(**common),
        "Ridge Regression": LinearRegression(regParam=1.0, elasticNetParam=0.0, **common),
        "Lasso Regression": LinearRegression(regParam=0.1, elasticNetParam=1.0, **common),
        "ElasticNet": LinearRegression(regParam=0.1, elasticNetParam=0.5, **common),
        "Decision Tree": DecisionTreeRegressor(maxDepth=8, minInstancesPerNode=5, seed=SEED, **common),
    }


@dataclass
class Prepared:
    """Training table split by time, its feature names and the week to predict from."""

    train: DataFrame
    test: DataFrame
    last: DataFrame
    columns: list[str]
    use_log: bool


def prepared(features: DataFrame, test_share: float = series.TEST_SHARE, use_log: bool = True) -> Prepared:
    """Complete rows, standardised on all of them, the last share kept for testing."""
    columns = [f.name for f in features.schema.fields if f.name not in NOT_FEATURES]
    table = checkpointed(features.select("contract_week", "target", *(F.col(c).cast("double").alias(c) for c in columns)))
    known = table.na.drop(subset=[*columns, "target"])
    last = table.na.drop(subset=columns).orderBy(F.desc("contract_week")).limit(1)
    assembler = VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="keep")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(assembler.transform(known))
    split = series.chronological_split(known, test_share)
    ready = scaler.transform(assembler.transform(split)).drop("raw").persist()
    return Prepared(ready.where(~F.col("is_test")), ready.where("is_test"),
                    scaler.transform(assembler.transform(last)).drop("raw"), columns, use_log)


def feature_ranking(train: DataFrame, columns: list[str], trees: int = 100) -> DataFrame:
    """Forest importance, F score and mutual information, each scaled to 0-1 and weighted.

    Mutual information is estimated from nearest weeks, for all features in one job.
    """
    spark = train.sparkSession
    forest = RandomForestRegressor(numTrees=trees, maxDepth=8, seed=SEED, featuresCol="features", labelCol="target").fit(train)
    importance = spark.createDataFrame(
        [(c, float(v)) for c, v in zip(columns, forest.featureImportances.toArray())], "feature string, forest double")
    long = train.select("contract_week", "target", F.explode(F.array(*(
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in columns))).alias("e")
    ).select("contract_week", "target", "e.*")
    r2 = F.pow(F.corr("x", "target"), F.lit(2))
    f_score = long.groupBy("feature").agg((F.try_divide(r2, 1 - r2) * (F.count("*") - 2)).alias("f_score"))
    information = mutual_information(long, "feature", "x", "target")
    parts = importance.join(f_score, "feature").join(information, "feature").fillna(0.0)
    bounds = grouping.with_whole_stats(parts, "_b", **{f"{e}_{p}": getattr(F, e)(p) for p in RANKING for e in ("min", "max")})

    def unit(p):
        return F.coalesce(F.try_divide(F.col(p) - F.col(f"_b.min_{p}"), F.col(f"_b.max_{p}") - F.col(f"_b.min_{p}")), F.lit(0.0))

    score = sum((w * unit(p) for p, w in RANKING.items()), F.lit(0.0))
    return bounds.withColumn("score", score).drop("_b")


def _evaluated(predictions: DataFrame, use_log: bool) -> dict[str, float]:
    back = (lambda c: F.expm1(c)) if use_log else (lambda c: c)
    values = predictions.select(back(F.col("target")).alias("label"), back(F.col("prediction")).alias("prediction"))
    return {m: RegressionEvaluator(labelCol="label", metricName=m).evaluate(values) for m in ("r2", "mse", "rmse", "mae")}


def compared_models(data: Prepared, trees: int = 200, rounds: int = 200) -> tuple[list[tuple], dict]:
    """Fit every model; metrics on values, not logs; ranked by the test rows.

    The weeks lie in one partition in order: boosting runs thousands of small jobs, and bootstraps follow the place of a row.
    """
    train, test = (x.coalesce(1).sortWithinPartitions("contract_week").persist() for x in (data.train, data.test))
    rows, fitted = [], {}
    for name, model in models(trees, rounds).items():
        fitted[name] = model.fit(train)
        on_train = _evaluated(fitted[name].transform(train), data.use_log)
        on_test = _evaluated(fitted[name].transform(test), data.use_log)
        gap = on_train["r2"] - on_test["r2"]
        rows.append((name, on_train["r2"], on_test["r2"], on_test["mse"], on_test["rmse"], on_test["mae"], gap, gap > OVERFIT))
    for frame in (train, test):
        frame.unpersist()
    return sorted(rows, key=lambda r: -r[2]), fitted


def comparison_table(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        rows, "model string, r2_train double, r2_test double, mse double, rmse double, mae double, overfit double, "
        "is_overfit boolean")


def next_week(data: Prepared, model, level: DataFrame) -> DataFrame:
    """Prediction for the week after the last one and its deviation from the mean of the series."""
    raw = model.transform(data.last)
    value = F.expm1("prediction") if data.use_log else F.col("prediction")
    stats = grouping.with_row(raw.select("contract_week", value.alias("predicted")), level.agg(
        F.avg("total_amount").alias("mean"), F.median("total_amount").alias("median")), "_s")
    return stats.select(F.col("contract_week").alias("last_week"), "predicted", F.col("_s.mean").alias("mean"),
                        F.col("_s.median").alias("median"),
                        ((F.col("predicted") - F.col("_s.mean")) / F.col("_s.mean") * 100).alias("deviation_percent"))


def next_week_by_project(contracts: DataFrame, projects: list[str] | None = None, trees: int = 200, rounds: int = 200) -> DataFrame:
    """One prediction for each of the ``projects``; without them one for all contracts together."""
    groups = [("all", contracts)] if projects is None else [(p, contracts.where(F.col("project_name") == p)) for p in projects]
    out = []
    for name, rows in groups:
        weekly = checkpointed(series.weekly_base(rows))
        data = prepared(series.features_of_weeks(weekly))
        ranked, fitted = compared_models(data, trees, rounds)
        out.append(next_week(data, fitted[ranked[0][0]], weekly).select(
            F.lit(name).alias("project"), F.lit(ranked[0][0]).alias("model"), "*"))
    return grouping.stacked(*out)

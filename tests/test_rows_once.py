"""Queries that read contracts in several ways put them together once, and shuffle few of their values."""

import datetime

import pytest
from pyspark.sql import functions as F

from tendermill.operators.quantiles import exact_quantiles
from tendermill.plans import prices, regression, series

DAY = datetime.date(2001, 1, 1)


def _counted(spark, n=300):
    """Contracts whose amount is computed by a function that counts its calls."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    rows = [(i // 3, f"s{i % 4}", float(i + 1), 2.0 + i, 1.0, 2.0 + i, DAY, DAY + datetime.timedelta(days=i % 200), f"c{i % 250}", "URGENT" if i % 2 else None, "p")
            for i in range(n)]
    df = spark.createDataFrame(rows, "lot_number long, counterparty_name string, amount double, unit_price double, quantity double, product_amount double, "
                               "lot_end_date date, contract_signing_date date, contract_number string, payment_conditions string, project_name string")
    return df.withColumn("total_contract_amount_eur", counted("amount")).withColumn("unit_price_eur", F.col("unit_price")), seen


def test_risk_score_puts_contracts_together_once(spark):
    contracts, seen = _counted(spark)
    found = prices.risk_score(contracts, prepaid="URGENT").first()
    assert seen.value == 300
    assert found["priority_value"] == pytest.approx(225.25) and found["prepaid_share"] == 0.5 and found["errors"] == 0
    assert found["mean_suppliers"] == 3.0 and found["single_share"] == 0.0


def test_weeks_put_contracts_together_once(spark):
    contracts, seen = _counted(spark)
    weeks = series.weekly_base(contracts).toPandas().set_index("contract_week").sort_index()
    assert seen.value == 300
    own = contracts.select("contract_signing_date", "amount", "contract_number", "counterparty_name").toPandas()
    own["week"] = own["contract_signing_date"].map(lambda x: x - datetime.timedelta(days=x.weekday()))
    by = own.groupby("week")
    assert list(weeks["median_contract"]) == list(by["amount"].median()) and list(weeks["total_amount"]) == list(by["amount"].sum())
    assert list(weeks["contract_count"]) == list(by["contract_number"].nunique())
    assert list(weeks["unique_counterparties"]) == list(by["counterparty_name"].nunique())


def test_next_week_folds_contracts_once(spark, monkeypatch):
    contracts, seen = _counted(spark)
    monkeypatch.setattr(regression, "compared_models", lambda data, *_: ([("none",)], {"none": None}))
    monkeypatch.setattr(regression, "next_week", lambda data, model, level: level.agg(F.count("*").alias("weeks")))
    assert regression.next_week_by_project(contracts).first()["weeks"] == 29
    assert seen.value == 300


def test_values_do_not_leave_tasks_for_a_few_bands(spark):
    df = spark.range(20000).select((F.col("id") * 1.0 + 1).alias("v"))
    found = exact_quantiles(df, [], "v", {"q": 0.75}, reread=True)
    assert found.first()["q"] == 15000.25
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan

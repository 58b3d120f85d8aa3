"""Properties of the analyses that no SQL states."""

import os
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tendermill.catalog import load
from tendermill.operators import outliers
from tendermill.plans import alternatives, clusters, series, trend


def months(totals):
    start = pd.Timestamp("2020-01-01")
    return pd.DataFrame({"g": "x", "month": [(start + pd.DateOffset(months=i)).date() for i in range(len(totals))],
                         "total": totals})


def test_smoothing_keeps_the_sum(spark):
    frame = months([10.0, 0.0, 12.0, 100.0, 0.0, 11.0, 0.0])
    got = trend.smoothed(spark.createDataFrame(frame), ["g"]).orderBy("month").toPandas()
    assert len(got) == 6  # the trailing empty month is cut
    assert got["smooth"].sum() == pytest.approx(frame["total"].sum())
    assert (got["smooth"] > 0).all()
    whole = months([10.0, 12.0, 100.0, 11.0])
    kept = trend.smoothed(spark.createDataFrame(whole), ["g"]).toPandas()
    assert kept["smooth"].sum() == pytest.approx(133.0)


def test_forecast_continues_a_clean_trend(spark):
    frame = months(list(np.exp(2 + 0.05 * np.arange(36))))
    logged = trend.log_series(spark.createDataFrame(frame).withColumn("smooth", F.col("total")), ["g"])
    got = trend.forecast(logged, ["g"]).orderBy("month").toPandas()
    assert np.allclose(got["forecast"], np.exp(2 + 0.05 * np.arange(36, 48)), rtol=1e-6)
    assert got["month"].iloc[0] == date(2023, 1, 1) and len(got) == 12


def test_first_window_rows_are_null(spark):
    got = series.moving_mean(spark.createDataFrame(months([1.0, 2.0, 3.0, 4.0])), "total", "month").orderBy("month").toPandas()
    assert got["moving_mean"].isna().tolist() == [True, True, False, False]


def test_about_one_row_in_twenty_is_anomalous(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(rng.normal(size=(1000, 3)), columns=["a", "b", "c"])
    frame.loc[0, "a"] = 50.0
    got = outliers.mahalanobis(spark.createDataFrame(frame), ["a", "b", "c"]).toPandas()
    assert 45 <= got["is_anomaly"].sum() <= 55
    centred = frame - frame.mean()
    want = np.einsum("ij,jk,ik->i", centred, np.linalg.inv(frame.cov()), centred)
    assert np.allclose(np.sort(got["distance"]), np.sort(want))


def test_alternative_scores_stay_in_bounds(spark, tiny):
    scores = load()["alternative_suppliers"].run(spark, tiny).select("recommendation_score").toPandas()
    assert scores.iloc[:, 0].between(0, 100).all() and len(scores)


def test_supplier_with_one_contract(spark):
    rows = [("d", "p", "new", date(2020, 1, 1), 100.0, 10.0, "q"), ("d", "p", "old", date(2020, 1, 1), 100.0, 20.0, "q"),
            ("d", "p", "old", date(2024, 1, 1), 100.0, 20.0, "r")]
    df = spark.createDataFrame(rows, "discipline string, product_name string, counterparty_name string, "
                               "contract_signing_date date, total_contract_amount_eur double, unit_price_eur double, "
                               "project_name string")
    profiles = alternatives.supplier_profiles(df)
    found = alternatives.alternatives(profiles, df.where("project_name = 'r'"), date(2024, 6, 1)).collect()
    assert [r["counterparty_name"] for r in found] == ["new"]
    assert found[0]["recommendation"] == alternatives.NOT_RECOMMENDED
    assert "Малое количество контрактов" in found[0]["risks"] and "Длительный перерыв в работе" in found[0]["risks"]
    assert found[0]["price_vs_current"] == pytest.approx(-50.0)


def test_clusters_cover_every_supplier(spark, tiny):
    got = load()["supplier_clusters"].run(spark, tiny)
    assert got.count() == got.select("counterparty_name").distinct().count()
    assert got.where("is_giant").select("cluster").distinct().count() == got.where("is_giant").count()


def test_seeds_found_their_clusters(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({
        "discipline": ["a"] * 20 + ["b"] * 20, "actor_name": [f"p{i}" for i in range(40)],
        "total_lots": np.r_[rng.normal(10, 1, 20), rng.normal(100, 1, 20)], "avg_time_to_close": 5.0, "avg_lot_value": 1.0,
        "sum_lot_value": np.r_[rng.normal(10, 1, 20), rng.normal(100, 1, 20)], "kpi_score": rng.random(40)})
    df = spark.createDataFrame(frame)
    seeds = df.where(F.col("actor_name").isin("p0", "p20"))
    got = clusters.seeded_clusters(df, seeds).toPandas()
    assert len(got) == 40 and got.groupby("discipline")["cluster"].nunique().tolist() == [1, 1]


def test_actors_lie_nearest_to_their_own_centre(spark):
    rng = np.random.default_rng(5)
    rows = [(f"d{g}", f"p{g}-{i}", f"s{g}-{rng.integers(6)}", float(rng.normal(100 * g + 50, 3))) for g in range(4) for i in range(12) for _ in range(9)]
    lots = spark.createDataFrame(rows, "discipline string, actor_name string, winner_name string, total_price_eur double")
    got = clusters.actor_clusters(lots).toPandas()
    frame = pd.DataFrame(rows, columns=lots.columns)
    uses = (frame.pivot_table(index="actor_name", columns="winner_name", values="total_price_eur", aggfunc="size") > 0).astype(float)
    sums = got.set_index("actor_name").loc[uses.index]
    wide = np.c_[sums[["total_eur", "total_lots", "suppliers_count"]].to_numpy(float), uses.to_numpy()]
    deviation = wide.std(axis=0, ddof=1)
    wide = wide[:, deviation > 0] / deviation[deviation > 0]
    label = sums["cluster"].to_numpy()
    centres = {c: wide[label == c].mean(axis=0) for c in set(label)}
    gaps = {c: ((wide - x) ** 2).sum(axis=1) for c, x in centres.items()}
    own = np.array([gaps[c][i] for i, c in enumerate(label)])
    assert len(got) == 48 and (own <= np.min(list(gaps.values()), axis=0) + 1e-6).all()


# model fits and reports over the same matches take minutes: all of them only when asked for
QUICK = {"shape_attributes", "name_dimensions", "name_features", "quick_name_scores", "comparable_offers",
         "cluster_profile", "actor_clusters", "efficiency_groups"}
ROWS_ONLY = sorted(n for n, q in load().items() if q.sql is None and (n in QUICK or os.environ.get("RUN_SLOW")))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_queries_run(spark, tiny, name):
    assert load()[name].run(spark, tiny).limit(1).count() == 1

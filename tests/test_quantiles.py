import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tendermill.operators.grouping import exact_sum
from tendermill.operators.quantiles import band_of, exact_quantiles, percentile_rank, running_totals


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    n = 3000
    # one key holds most rows and repeats values; negative, zero and huge values occur
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    value = np.round(rng.lognormal(4, 3, n) * rng.choice([1, -1], n), 2)
    value[rng.random(n) < 0.2] = 17.5
    value[rng.random(n) < 0.05] = 0.0
    return pd.DataFrame({"key": key, "value": value, "id": range(n)})


def test_grouped_quantiles_are_exact(spark, frame):
    got = exact_quantiles(spark.createDataFrame(frame), ["key"], "value", {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99})
    want = frame.groupby("key")["value"]
    for r in got.collect():
        g = want.get_group(r["key"])
        assert [r["p0"], r["p25"], r["p50"], r["p99"]] == pytest.approx(
            [g.quantile(0), g.quantile(0.25), g.quantile(0.5), g.quantile(0.99)])


def test_quantile_of_everything_and_of_nothing(spark, frame):
    df = spark.createDataFrame(frame)
    assert exact_quantiles(df, [], "value", {"m": 0.5}).first()["m"] == pytest.approx(frame["value"].median())
    empty = exact_quantiles(df.where("id < 0"), [], "value", {"m": 0.5}).collect()
    assert len(empty) == 1 and empty[0]["m"] is None
    assert exact_quantiles(df.where("id < 0"), ["key"], "value", {"m": 0.5}).count() == 0


def test_small_values_spread_over_bands(spark):
    rng = np.random.default_rng(1)
    value = rng.random(2000) * 0.01 * rng.choice([1, -1], 2000)
    df = spark.createDataFrame(pd.DataFrame({"value": value}))
    assert df.groupBy(band_of(F.col("value")).alias("b")).count().agg(F.max("count")).first()[0] < 2000 * 0.02
    ordered = [r["b"] for r in df.orderBy("value").select(band_of(F.col("value")).alias("b")).collect()]
    assert ordered == sorted(ordered)
    edges = [float("-inf"), -1e300, -1.0, -5e-324, 0.0, 5e-324, 1e-9, 1.0, 1e300, float("inf"), float("nan")]
    bands = [r["b"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(edges)], "i int, v double").orderBy("i").select(band_of(F.col("v")).alias("b")).collect()]
    assert bands == sorted(bands) and len(set(bands[1:9])) == 8
    assert exact_quantiles(df, [], "value", {"m": 0.5}).first()["m"] == pytest.approx(np.median(value))


def test_null_key_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None)], "key string, value double")
    assert [tuple(r) for r in exact_quantiles(df, ["key"], "value", {"m": 0.5}).collect()] == [(None, 2.0)]


def test_bands_keep_the_order(spark):
    values = [-1e12, -5.5, -0.01, 0.0, 0.01, 1.0, 1.5, 1e3, 1e18]
    bands = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(band_of(F.col("v"))).collect()]
    assert bands == sorted(bands)


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals_equal_a_window(spark, frame, descending):
    got = running_totals(spark.createDataFrame(frame), ["key"], "value", ["id"], descending=descending).toPandas()
    ordered = frame.sort_values(["key", "value", "id"], ascending=[True, not descending, True])
    ordered["running"] = ordered.groupby("key")["value"].cumsum()
    ordered["position"] = ordered.groupby("key").cumcount() + 1
    both = got.merge(ordered, on="id", suffixes=("", "_want"))
    assert len(both) == len(frame)
    assert (both["position"] == both["position_want"]).all()
    assert np.allclose(both["running"], both["running_want"])


def test_percentile_rank_shares_ties(spark, frame):
    got = percentile_rank(spark.createDataFrame(frame), "value", "r").toPandas().set_index("id")["r"].sort_index()
    assert np.allclose(got, frame["value"].rank(pct=True))


def test_exact_sum_ignores_row_order(spark):
    df = spark.createDataFrame([(0.1,)] * 10 + [(1e10,), (-1e10,)], "x double")
    for order in ("x", F.desc("x")):
        assert df.orderBy(order).agg(exact_sum("x")).first()[0] == 1.0

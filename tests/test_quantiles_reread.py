import pytest

from tendermill.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_bands_counted_first_give_the_same(spark, keys):
    rows = [(None if i % 3 else "a", None if i % 11 == 0 else (-1.0) ** i * 1.07 ** (i % 90)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = {"low": 0.05, "middle": 0.5, "high": 0.95}
    plain, reread = (sorted(map(str, exact_quantiles(df, keys, "v", wanted, **more).collect())) for more in ({}, {"reread": True}))
    assert plain == reread and len(plain) == (2 if keys else 1)
    assert exact_quantiles(df.limit(0), [], "v", {"q": 0.5}, reread=True).first()["q"] is None

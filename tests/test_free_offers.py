"""Offers at a price of 0 or below in the figures over all comparable offers."""

import pytest

from tendermill.plans import comparables


def test_offers_without_a_positive_price_count(spark):
    name = "Швеллер 20П"
    prices = {"s0": 0.0, "s1": 100.0, "s2": 105.0, "s3": -10.0, "s4": None}
    contracts = spark.createDataFrame([(name, s, p) for s, p in prices.items()], "product_name string, counterparty_name string, unit_price_eur double")
    statistics = comparables.match_statistics(contracts)
    got = {r["supplier1"]: [r[c] for c in ("matches", "within10", "within20", "within30", "dearer", "cheaper", "more", "less")] for r in statistics.collect()}
    assert got == {"s0": [3, 3, 3, 3, 2, 1, 205.0, 10.0], "s1": [3, 1, 1, 1, 1, 2, 5.0, 210.0], "s2": [3, 1, 1, 1, 0, 3, 0.0, 225.0],
                   "s3": [3, 3, 3, 3, 3, 0, 235.0, 0.0]}
    report = comparables.category_report(statistics, comparables.comparable_offers(contracts)).first()
    assert report["matches"] == 12
    assert report["mean_gap"] == pytest.approx((215 / 100 + 225 / 105) * 100 / 12)
    rated = {(r["supplier"], r["side"]): r["mean_gap"] for r in comparables.supplier_ratings(statistics).collect()}
    assert rated["s0", "cheaper"] == 0.0 and rated["s1", "expensive"] == pytest.approx(105.0)
    assert {r["bucket"]: r["matches"] for r in comparables.gap_buckets(statistics).collect()} == {"0-10": 8, "10-20": 0, "20-30": 0, ">30": 4}
    gaps = comparables.critical_gaps(statistics).first()
    assert (gaps["matches"], gaps["critical"]) == (12, 4)

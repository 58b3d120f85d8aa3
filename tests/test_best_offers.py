"""Every offer against the best of other suppliers, without grouping every offer."""

from tendermill.plans import comparables


def _offers(spark):
    rows = [(f"Круг {20 + n} Ст45", f"s{s}", float(10 + (7 * s + 5 * n) % 11)) for n in range(4) for s in range(5) if (n + s) % 4]
    rows += [("Круг 20 Ст45", "alone", 1.0), ("Круг 21 Ст45", "alone", 99.0)]
    return spark.createDataFrame(rows, "product_name string, counterparty_name string, unit_price_eur double")


def test_comparable_offers_join_without_grouping_offers(spark):
    """The first's own supplier meets the second; no aggregate has the offers' suppliers as keys."""
    contracts = _offers(spark)
    found = comparables.comparable_offers(contracts)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [" in x and "supplier1#" in x.split("], [")[0]]
    related = comparables.related_names(contracts, 0.85, "product_name").collect()
    prices = [(r["name"], r["supplier"], r["price"]) for r in comparables.offers(contracts).collect()]
    expected = {}
    for name1, supplier1, _ in prices:
        others = [(p, n, s) for r in related if r["name1"] == name1 for n, s, p in prices if n == r["name2"] and s != supplier1]
        expected[name1, supplier1, "cheapest"] = min(others)
        expected[name1, supplier1, "dearest"] = min(others, key=lambda o: (-o[0], o[1], o[2]))
    assert {(r["name1"], r["supplier1"], r["side"]): (r["price2"], r["name2"], r["supplier2"]) for r in found.collect()} == expected

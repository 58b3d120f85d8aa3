"""Offers of two names meet in blocks: figures do not depend on the blocks, and no table of one row an edge is shuffled."""

from tendermill.plans import comparables, gaps


def _contracts(spark):
    rows = [("Круг 20 Ст45" if i % 2 else "Круг 21 Ст45", f"s{i % 37}", float(1 + (i * i) % 53)) for i in range(150)]
    return spark.createDataFrame([*rows, ("Круг 20 Ст45", None, 7.0)], "product_name string, counterparty_name string, unit_price_eur double")


def test_blocks_of_any_size_give_the_same_statistics(spark):
    contracts = _contracts(spark)
    found = []
    for block in (5, 1000):
        rows = comparables.match_statistics(contracts, block=block).collect()
        found.append({(r["name1"], r["supplier1"], r["name2"]): (*r[6:12], round(r["more"], 6), round(r["less"], 6)) for r in rows})
    assert found[0] == found[1] and len(found[0]) > 70
    prices = [(r["name"], r["supplier"], r["price"]) for r in comparables.offers(contracts).collect()]
    for (name1, supplier1, name2), got in found[0].items():
        p = next(x[2] for x in prices if x[:2] == (name1, supplier1))
        others = [x[2] for x in prices if x[0] == name2 and (x[1] is None or x[1] != supplier1 or supplier1 is None)]
        assert got[0] == len(others) and got[4:6] == (sum(q > p for q in others), sum(q < p for q in others))


def test_medians_do_not_depend_on_blocks(spark):
    contracts = _contracts(spark)
    related = comparables.related_names(contracts, 0.85, "product_name").cache()
    per_offer = comparables.offers(contracts)
    found = [{r["category"]: (r["matches"], r["median_gap"]) for r in gaps.median_gaps(related, per_offer, listed, block).collect()}
             for listed, block in ((20, 7), (1_000_000, 1000))]
    assert found[0] == found[1] and found[0]

"""Figures over all comparable offers against every pair of them."""

import numpy as np
import pandas as pd
import pytest

from tendermill.plans import comparables

NAMES = ["Труба 42х4 ГОСТ 8732-78 Ст20", "Труба 42х4 ГОСТ 8732-78 сталь Ст20", "Швеллер 20П", "Круг 20 Ст45"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    prices = rng.choice([50.0, 64.0, 100.0, 110.0, 128.0, 200.0], 120)
    return [(NAMES[rng.integers(4)], f"s{rng.integers(9)}", float(x)) for x in prices]


def test_statistics_match_all_pairs(spark, rows):
    contracts = spark.createDataFrame(rows, "product_name string, counterparty_name string, unit_price_eur double")
    related = {(r["name1"], r["name2"]) for r in comparables.related_names(contracts, 0.85, "product_name").collect()}
    assert len(related) > 4
    offer = pd.DataFrame(rows, columns=["name", "supplier", "price"]).groupby(["name", "supplier"], as_index=False)["price"].mean()
    want = {}
    for a in offer.itertuples():
        for b in offer.itertuples():
            if (a.name, b.name) in related and a.supplier != b.supplier:
                w = want.setdefault((a.name, a.supplier, b.name), np.zeros(8))
                inside = [a.price * (1 - x) <= b.price <= a.price * (1 + x) for x in (0.1, 0.2, 0.3)]
                w += [1, *inside, b.price > a.price, b.price < a.price, max(b.price - a.price, 0), max(a.price - b.price, 0)]
    found = comparables.match_statistics(contracts).collect()
    figures = ["matches", "within10", "within20", "within30", "dearer", "cheaper", "more", "less"]
    got = {(r["name1"], r["supplier1"], r["name2"]): [r[c] for c in figures] for r in found}
    assert got.keys() == want.keys() and len(found) == len(got)
    assert all(np.allclose(got[k], want[k]) for k in want)

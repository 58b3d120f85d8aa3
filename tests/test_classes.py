"""Blocks of hot groups, classes of names, and the gaps of all pairs of offers, each against all pairs."""

import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tendermill.operators import blocks
from tendermill.plans import comparables, gaps

NAMES = ["Труба 57х3 ГОСТ 8732-78 Ст20", "Труба 57х4 ГОСТ 8732-78 Ст20", "Труба 58х3 ГОСТ 8732-78 Ст20", "Труба 219х6 Ст20", "Труба ГОСТ 8732-78 Ст20",
         "Лист 5 Ст3", "Лист 6 Ст3", "Лист 5 Ст3 рифленый", "Круг 20 Ст45", "Круг 21 Ст45", "Уголок 50х50х5", "Уголок 50х50х4", "Уголок 57х57х5", "Уголок 41х41х5",
         "Плита 600х300х50", "Плита 600х300х51", "Плита 900х200х10", "Плита минеральная", "Плита минеральная мягкая", "Нечто 5", "Нечто 6",
         *(f"Кабель ВВГ 3х2,5 {x}" for x in ("", "мм", "черный", "белый для наружной прокладки в земле", "черный негорючий")),
         "Болт М8 длинный оцинкованный", "Болт М8 длинный", "болт м8  длинный", "Болт М10 короткий черный", "Болт ГОСТ 7798-70 М12"]


def test_hot_cell_is_spread(spark):
    """Half of all rows in one group: every pair once, and no cell holds more than two blocks."""
    rows = [("hot", f"n{k}", k) for k in range(400)] + [(f"g{k % 40}", f"m{k}", k) for k in range(400)] + [(None, "x", 1), (None, "y", 2)]
    df = spark.createDataFrame(rows, "g string, name string, v int")
    got = blocks.pairs(df, ["g"], "name", ["v"], block=50)
    want = {(g, *sorted((a, b))) for (g, a, _), (h, b, _) in itertools.combinations(rows, 2) if g == h and g}
    found = [(r.g, r.name1, r.name2) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
    left, right = df.where("v % 3 = 0"), df.where("v % 2 = 0")
    both = {(g, a, b) for g, a, v in rows for h, b, w in rows if g == h and g and v % 3 == 0 and w % 2 == 0}
    found = [(r.g, r.name1, r.name2) for r in blocks.between(left, right, ["g"], ["name", "v"], block=30).collect()]
    assert len(found) == len(both) and set(found) == both
    large = blocks._block_counts(df, ["g"], "b", 50)
    assert {r._g: r.b for r in large.collect()} == {"hot": 8}


@pytest.fixture(scope="module")
def features(spark):
    return comparables.named_features(spark.createDataFrame([(n,) for n in NAMES], "product_name string"), "product_name")


@pytest.mark.parametrize("threshold", [0.75, 0.81])
@pytest.mark.parametrize("block", [2, 2048])
def test_classes_hold_all_pairs(spark, features, threshold, block):
    every = spark.createDataFrame(list(itertools.combinations(sorted(NAMES), 2)), "name1 string, name2 string")
    for i in (1, 2):
        every = every.join(features.select(*(F.col(c).alias(f"{c}{i}") for c in ("name", "f", "critical", "flat"))), f"name{i}")
    scored = comparables.any_pair_similarity(every.where("f1.category = f2.category and f1.type = f2.type"))
    found, members = comparables.similar_classes(features, threshold, block)
    of = {r["name"]: r["class"] for r in members.collect()}
    assert set(of) == {r["name"] for r in features.where("f.category is not null and f.type is not null").collect()}
    want = {}
    for r in scored.where(F.col("similarity") >= threshold).collect():
        key = tuple(sorted((of[r["name1"]], of[r["name2"]])))
        want[key] = want.get(key, 0) + 1
    rows = found.collect()
    assert {(r["class1"], r["class2"]): r["pairs"] for r in rows} == want and len(rows) == len(want)
    assert len(set(of.values())) < len(of)


def test_classes_need_a_threshold(features):
    with pytest.raises(ValueError):
        comparables.similar_classes(features, 0.7)


@pytest.fixture(scope="module")
def offers(spark):
    draw = random.Random(4)
    rows = [(f"n{k}", f"s{s}", float(draw.choice([0, -1, 3, 3, 5, 8, 8.5, 9, 12, 40, 400]) + draw.choice([0, 0, draw.random()])))
            for k in range(12) for s in range(25) if draw.random() < 0.8]
    rows += [("n1", "none", None), ("alone", "s1", 5.0)]
    names = [f"n{k}" for k in range(12)] + ["alone"]
    related = [("c" + str(i % 3), "t", a, b) for i, a in enumerate(names) for b in names if a == b or (a != "alone" and b != "alone" and abs(names.index(a) - names.index(b)) % 3 == 0)]
    return spark.createDataFrame(rows, "name string, supplier string, price double"), spark.createDataFrame(related, "category string, type string, name1 string, name2 string"), rows, related


def _all_pairs(rows, related):
    of = {}
    for n, s, p in rows:
        if p is not None:
            of.setdefault(n, []).append((s, p))
    for c, _, a, b in related:
        for s, p in of.get(a, []):
            for z, q in of.get(b, []):
                if s != z:
                    yield c, a, b, s, z, p, q, abs(q - p) / p if p > 0 else 0.0


@pytest.mark.parametrize("listed", [150, 1_000_000])
def test_median_gap_over_all_pairs(offers, listed):
    per_offer, related, rows, links = offers
    every = {}
    for c, *_, gap in _all_pairs(rows, links):
        every.setdefault(c, []).append(gap)
    got = {r["category"]: (r["matches"], r["median_gap"]) for r in gaps.median_gaps(related, per_offer, listed).collect()}
    assert got.keys() == every.keys()
    for c, own in every.items():
        assert got[c][0] == len(own)
        assert got[c][1] == pytest.approx(statistics.median(own) * 100, abs=1e-9)


def test_median_of_equal_prices_and_of_nothing(spark, offers):
    _, related, _, _ = offers
    same = spark.createDataFrame([(f"n{k}", f"s{s}", 7.0) for k in range(12) for s in range(4)], "name string, supplier string, price double")
    assert {r["median_gap"] for r in gaps.median_gaps(related, same, 1).collect()} == {0.0}
    assert gaps.median_gaps(related, same.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_largest_gaps_of_names(offers, k):
    per_offer, related, rows, links = offers
    every = {}
    for _, a, b, s, z, p, q, gap in _all_pairs(rows, links):
        if gap * 100 > 30:
            every.setdefault((a, b), []).append((-gap, s, z))
    got = {}
    for r in gaps.largest_of_names(related, per_offer, k).collect():
        got.setdefault((r["name1"], r["name2"]), []).append((r["place"], -r["gap_pct"] / 100, r["supplier1"], r["supplier2"]))
    assert got.keys() == every.keys()
    for key, own in every.items():
        want, have = sorted(own)[:k], sorted(got[key])
        assert [x[0] for x in have] == list(range(1, len(want) + 1))
        assert [x[1] for x in have] == pytest.approx([x[0] for x in want])
        assert [x[2:] for x in have] == [x[1:] for x in want]

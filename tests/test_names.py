"""Name attributes, similarity and comparable offers; complete results against brute force."""

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tendermill.functions import attributes, pairs
from tendermill.functions.penalties import critical_attributes, critical_penalty
from tendermill.plans import comparables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def penalty(spark, a, b):
    return one(spark, critical_penalty(critical_attributes(F.lit(a)), critical_attributes(F.lit(b))))


@pytest.mark.parametrize("name, category, kind", [
    ("Электрод МР-3 ф4", "сварочное_оборудование", "электрод"), ("Бур SDS 10х160", "инструмент", "бур"),
    ("Кольцо уплотнительное резиновое", "расходные_материалы", "кольцо"), ("Кольцо стопорное", "крепеж", "кольцо"),
    ("Кольцо стеновое КС 10.9", "строительные_материалы", "кольцо стеновое"), ("Флянец Ду50", "трубы_фитинги", "фланец"),
    ("Труба стальная 57х3", "трубы_фитинги", "труба"), ("Таль ручная 1т", "грузоподъемное_оборудование", "таль"),
    ("Балка стальная", "металлопрокат", "балка"), ("Нечто особое", None, "нечто")])
def test_categories(spark, name, category, kind):
    assert tuple(one(spark, attributes.category_and_type(F.lit(name)))) == (category, kind)


def test_dimensions(spark):
    d = one(spark, attributes.dimensions(F.lit("Труба 57х3,5 ГОСТ 8732")))
    assert (d["diameter"], d["thickness"], d["length"]) == (57.0, 3.0, None)
    d = one(spark, attributes.dimensions(F.lit("Плита 600х300х50")))
    assert (d["length"], d["width"], d["height"]) == (600.0, 300.0, 50.0)
    assert one(spark, attributes.dimensions(F.lit("Утеплитель t=100мм")))["thickness"] == 100.0
    assert one(spark, attributes.dimensions(F.lit("Швеллер 14П")))["number"] == 14.0


@pytest.mark.parametrize("a, b, low", [
    ("Швеллер 10", "Швеллер 20", 0.30), ("Арматура 12 А500С", "Арматура 16 А500С", 0.30),
    ("Труба 57х3 ст20", "Труба 108х4 ст20", 0.30), ("Рулетка 5 м", "Рулетка 10 м", 0.40),
    ("Розетка открытая 16А", "Розетка скрытая 16А", 0.25), ("Кабель ВВГ 3х2,5", "Кабель ВВГ 3х1,5", 0.40)])
def test_critical_parameters_differ(spark, a, b, low):
    assert penalty(spark, a, b) == pytest.approx(low)
    assert penalty(spark, b, a) == pytest.approx(low)
    assert penalty(spark, a, a) == 1.0


FAMILIES = [
    ("Фланец 150-16-01", "Фланец 65-16-01", 0.30), ("Фланец 65-16", "Фланец 150-16", 0.30),
    ("Фланец 1-150-16", "Фланец 2-150-16", 0.85), ("Фланец 1-800-0.3", "Фланец 1-800-1.6", 0.40), ("Фланец 1-150-16", "Фланец 1-155-16", 1.0),
    ("Строп СТП 2,0", "Строп СТП 5,0", 0.45), ("Строп СТП 2,0/3000", "Строп СТП 2,0/6000", 0.65),
    ("Строп СКП 2т", "Строп СТП 2т", 0.30), ("Строп цепной 2т", "Строп текстильный 2т", 0.30), ("Строп 2тн 6м", "Строп 2тн/6000", 1.0),
    ("Лист 5 Ст3", "Лист 5 С345", 0.40), ("Лист рифленый 5х1500х6000", "Лист рифленый 6х1500х6000", 0.30), ("Лист 5 С345", "Лист 5 С355", 1.0),
    ("Труба 108*4", "Труба 159*4", 0.30), ("Труба 108х4", "Труба 114", 0.30), ("Труба 159,4", "Труба 163", 1.0), ("Труба 159", "Труба 166", 0.30),
    ("Труба 57х3 ст20", "Труба 57х4 ст20", 0.30), ("Труба ПВХ 110х3", "Труба ПВХ 110х6", 0.40), ("Труба ПВХ 110х3", "Труба ПВХ 110х4", 1.0),
    ("Труба ПНД 63", "Труба ППР 63", 0.30), ("Труба ПНД 63 ХВС", "Труба ПНД 63 газ", 0.30),
    ("Отвод 90 76х5", "Отвод 45 76х5", 0.3), ("Отвод 90 76*5", "Отвод 90 108*5", 0.3), ("Отвод крутоизогнутый 76х5", "Отвод 76х5", 0.4),
    ("Отвод 90 76х5", "Отвод 90 76х5,5", 1.0), ("Отвод 90 76х5", "Отвод 90 78х5", 1.0), ("Отвод П 90 114×5-20", "Отвод 90 114×5", 0.4),
    ("Розетка скрытая IP54", "Розетка скрытая IP65", 0.3), ("Розетка скрытая IP44", "Розетка скрытая IP54", 1.0),
    ("Розетка скрытая IP20", "Розетка скрытая IP44", 0.3), ("Розетка скрытая двойная", "Розетка скрытая тройная", 0.3),
    ("Розетка скрытая 2 места", "Розетка скрытая двойная", 1.0), ("Розетка скрытая двойная", "Розетка скрытая", 0.4),
    ("Розетка кабельная 16А", "Розетка переносная 16А", 1.0), ("Розетка накладная", "Розетка встраиваемая", 0.25),
    ("Розетка скрытая 220В 16А 2", "Розетка скрытая 16А 220В 1", 0.3), ("Клапан 15мм", "Клапан 20мм", 0.3),
    ("Клапан DN4\"", "Клапан Ду100", 0.3), ("Клапан DN3/4", "Клапан DN3", 0.3), ("Клапан CL300", "Клапан CL150", 0.3),
    ("Кран PN4", "Кран PN16", 0.3), ("Кран полнопроходной", "Кран водоразборный", 0.3),
    ("Клапан запорный A216-WCB", "Клапан запорный A351-CF3A", 0.7), ("Клапан обратный", "Клапан запорный", 0.3),
    ("Клапан регулирующий", "Дроссель-клапан", 1.0), ("Уголок 63*6", "Уголок 63*5", 0.3), ("Уголок 63х63х5", "Уголок 75х75х5", 0.3),
    ("Уголок 63х63х5", "Уголок 70х70х5", 1.0), ("Уголок наружный 20", "Уголок внутренний 20", 0.3),
    ("Задвижка клиновая Ду100", "Задвижка шиберная Ду100", 1.0), ("Задвижка Ду100", "Задвижка Ду80", 0.3),
    ("Муфта обжимная 20", "Муфта соединительная 20", 1.0), ("Муфта кабельная", "Муфта концевая", 0.35), ("Муфта Ø50", "Муфта Ø32", 0.528),
    ("Муфта Ø32", "Муфта Ø40", 1.0),]


def test_penalties_of_families(spark):
    both = [(a, b, x) for a, b, x in FAMILIES] + [(b, a, x) for a, b, x in FAMILIES]
    frame = spark.createDataFrame(both, "a string, b string, expected double")
    frame = frame.select("*", critical_attributes("a").alias("x"), critical_attributes("b").alias("y"))
    got = frame.select("a", "b", "expected", critical_penalty(F.col("x"), F.col("y")).alias("penalty")).collect()
    assert [r for r in got if abs(r["penalty"] - r["expected"]) > 1e-9] == []


def test_gate_words_are_whole(spark):
    assert penalty(spark, "Проволока стальная 2 м", "Проволока стальная 9 м") == 1.0


def test_text_scores(spark):
    a, b = F.lit("martha"), F.lit("marhta")
    assert one(spark, pairs.jaro_similarity(a, b)) == pytest.approx(0.9444, abs=1e-4)
    assert one(spark, pairs.jaro_winkler_similarity(a, b)) == pytest.approx(0.9611, abs=1e-4)
    assert one(spark, pairs.levenshtein_similarity(F.lit("кот"), F.lit("код"))) == pytest.approx(2 / 3)
    assert one(spark, pairs.token_similarity(F.lit("a b c"), F.lit("b c d"))) == 0.5
    assert one(spark, pairs.blocks_similarity(F.lit("abcd"), F.lit("bcde"))) == 0.75


def test_text_scores_of_many_pairs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("абвг ") for _ in range(rng.choice([0, 1, 3, 9, 40, 250]))) for _ in range(60)]
    cases = [(a, b) for a in words[:20] for b in words[20:]] + [("", ""), (None, "а"), ("а", None)]
    got = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string").select(
        "i", pairs.blocks_similarity(F.col("a"), F.col("b")).alias("x"), pairs.jaro_similarity(F.col("a"), F.col("b")).alias("j")).collect()
    assert len(got) == len(cases)
    for r in got:
        a, b = cases[r["i"]]
        if a is None or b is None:
            assert r["x"] is None and r["j"] is None
        else:
            assert r["x"] == pytest.approx(SequenceMatcher(None, a, b, autojunk=False).ratio())
            assert 0 <= r["j"] <= 1 and (r["j"] == 1.0 or a != b)
    hand = [("dixon", "dicksonx", 0.766667), ("dwayne", "duane", 0.822222), ("jellyfish", "smellyfish", 0.896296), ("crate", "trace", 0.733333)]
    for a, b, expected in hand:
        assert one(spark, pairs.jaro_similarity(F.lit(a), F.lit(b))) == pytest.approx(expected, abs=1e-5)


def test_quick_score_of_two_spellings(spark):
    df = spark.createDataFrame([("Швеллер 14П ГОСТ 8240-97 С245", "Швеллер 14 С245 ГОСТ 8240-97"),
                                ("Швеллер 14", "Труба 14")], "name1 string, name2 string")
    got = {r["name2"]: r["score"] for r in comparables.quick_scores(df).collect()}
    assert 0.85 < got["Швеллер 14 С245 ГОСТ 8240-97"] <= 1.0
    assert got["Труба 14"] == 0.0


NAMES = ["Труба 57х3 ГОСТ 8732-78 Ст20", "Труба 57х4 ГОСТ 8732-78 Ст20", "Труба 58х3 ГОСТ 8732-78 Ст20", "Труба 219х6 Ст20",
         "Лист 5 Ст3", "Лист 6 Ст3", "Лист 5 Ст3 рифленый", "Круг 20 Ст45", "Круг 21 Ст45", "Круг 40 Ст45", "Уголок 50х50х5",
         "Уголок 50х50х4", "Плита 600х300х50", "Плита 600х300х51", "Плита минеральная", "Плита минеральная мягкая",
         "Нечто 5", "Нечто 6", "Кабель ВВГ 3х2,5", "Кабель ВВГ 3х2,5 мм"]


def test_similar_names_are_complete(spark):
    """The candidate sets lose no pair that scores high enough."""
    frame = spark.createDataFrame([(n,) for n in NAMES], "product_name string")
    features = comparables.named_features(frame, "product_name")
    for threshold in (0.81,):
        got = {(r["name1"], r["name2"]): r["similarity"] for r in comparables.similar_names(features, threshold).collect()}
        every = spark.createDataFrame(list(itertools.combinations(sorted(NAMES), 2)), "name1 string, name2 string")
        for i in (1, 2):
            every = every.join(features.select(*(F.col(c).alias(f"{c}{i}") for c in ("name", "f", "critical", "flat"))), f"name{i}")
        scored = comparables.any_pair_similarity(every.where("f1.category = f2.category and f1.type = f2.type"))
        want = {(r["name1"], r["name2"]): r["similarity"] for r in scored.where(F.col("similarity") >= threshold).collect()}
        assert got.keys() == want.keys() and got
        assert all(got[k] == pytest.approx(want[k]) for k in got)
    with pytest.raises(ValueError):
        comparables.similar_names(features, 0.7)


def test_comparable_offers_hold_the_extremes_of_all_pairs(spark):
    rows = [(n, f"S{s}", 10.0 + (7 * i + 3 * s) % 11) for i, n in enumerate(NAMES) for s in range(3) if (i + s) % 4]
    df = spark.createDataFrame(rows, "product_name string, counterparty_name string, unit_price_eur double")
    pairs_found = comparables.comparable_pairs(df).select("name1", "supplier1", "price1", "name2", "supplier2", "price2").collect()
    best = {}
    for r in pairs_found:
        for a, b in ((1, 2), (2, 1)):
            key = (r[f"name{a}"], r[f"supplier{a}"])
            best.setdefault(key, []).append(r[f"price{b}"])
    offers = comparables.comparable_offers(df).collect()
    low = {(r["name1"], r["supplier1"]): r["price2"] for r in offers if r["side"] == "cheapest"}
    high = {(r["name1"], r["supplier1"]): r["price2"] for r in offers if r["side"] == "dearest"}
    assert low == {k: min(v) for k, v in best.items()}
    assert high == {k: max(v) for k, v in best.items()}
    assert all(r["supplier1"] != r["supplier2"] for r in offers)


def test_target_and_detailed_comparison(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "product_name string")
    found = comparables.matches_of("Уголок 50х50х5", df, "product_name", 0.25)
    described = comparables.compared(found.drop("penalty", "ratio", "similarity")).collect()
    row = next(r for r in described if r["name2"] == "Уголок 50х50х4")
    assert row["matches"]["type"] == "уголок" and row["differences"]["height"]["product2"] == "4.0"
    assert row["similarity"] == pytest.approx(0.30)


def test_shape_attributes(spark):
    df = spark.createDataFrame([("Швеллер 14П гнутый ГОСТ 8240-97",), ("Арматура 12 А500С ГОСТ 34028",)], "n string")
    a, b = df.select(*attributes.shape_attributes("n")).collect()
    assert (a["shape"], a["type_size"], a["flange"], a["kind"]) == ("швеллер", "14П", "с параллельными полками", "гнутый")
    assert (b["shape"], b["diameter"], b["class"]) == ("арматура", "12", "А500")

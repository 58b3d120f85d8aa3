"""Nulls, unknown currencies, zeros and duplicates, which the given tables lack."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tendermill.functions import money, text, values
from tendermill.operators import cleaning
from tendermill.plans import reconciliation, spend


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("raw, want", [
    ("31.12.2024", date(2024, 12, 31)), ("2024-12-31", date(2024, 12, 31)), ("31.02.2024", None), ("", None), (None, None)])
def test_dates(spark, raw, want):
    assert one(spark, values.parsed_date(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw, want", [("1 234,50", 1234.5), ("1 000", 1000.0), ("нет", None), ("7", 7.0)])
def test_local_numbers(spark, raw, want):
    assert one(spark, values.parsed_local_number(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [
    ("не использовать дубль М5 ГРУПП", "М5-ЭКСПОРТ ООО"), ("[Удалено]  ООО  Ромашка", "ООО Ромашка"),
    ("Daromad Munira Fayz Textile<не использовать>", "Daromad Munira Fayz"), ("Point Vision ПИИ", "POINT VISION СП ООО"),
    ("Альфа", "Альфа")])
def test_supplier_names(spark, raw, want):
    assert one(spark, text.canonical_supplier(F.lit(raw))) == want


def test_name_cut_at_bracket(spark):
    assert one(spark, text.before_bracket(F.lit("Иванов И. (отдел 5)"))) == "Иванов И."
    assert one(spark, text.before_bracket(F.lit("Иванов"))) == "Иванов"


def test_three_policies_for_unknown_currencies(spark):
    df = spark.createDataFrame([(100.0, "USD"), (100.0, "XXX"), (100.0, None)], "v double, c string")
    convert = [("v", "c", "eur")]
    assert [r["eur"] for r in cleaning.in_eur(df, convert).collect()] == [83.0]
    assert sorted(r["eur"] for r in cleaning.in_eur(df, convert, unknown="one").collect()) == [83.0, 100.0, 100.0]
    assert [r["eur"] for r in cleaning.in_eur(df, convert, unknown="null").collect()] == [83.0, None, None]
    assert {r[0] for r in cleaning.currencies_without_rate(df, "c").collect()} == {"XXX", None}
    changed = money.updated_rates({"XXX": 2.0})
    assert cleaning.in_eur(df, convert, rates=changed).count() == 2
    with pytest.raises(ValueError):
        cleaning.in_eur(df, convert, unknown="guess")


def test_rows_with_gaps_zeros_and_copies(spark):
    rows = [(1, "a", 10.0), (1, "a", 10.0), (None, "a", 5.0), (2, "b", 0.0), (3, None, 4.0), (4, "c", -1.0)]
    df = spark.createDataFrame(rows, "lot_number long, name string, price double")
    assert cleaning.unique_rows(df).count() == 5
    assert cleaning.unique_rows_in_lots(df).count() == 4
    assert {r["lot_number"] for r in cleaning.complete(df, ["lot_number", "name"], positive=["price"]).collect()} == {1}
    assert cleaning.numbers(df.withColumn("price", F.lit("x")), ["price"], "drop").count() == 0
    assert cleaning.numbers(df.withColumn("price", F.lit("x")), ["price"], "zero").first()["price"] == 0.0


def test_median_fill(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "p double")
    assert sorted(r[0] for r in cleaning.median_filled(df, "p").collect()) == [1.0, 2.0, 3.0]


def test_unique_by_keeps_the_smallest(spark):
    df = spark.createDataFrame([("a", 3, "z"), ("a", 1, "y"), ("b", 2, "x")], "k string, rowid int, v string")
    assert sorted(tuple(r) for r in cleaning.unique_by(df, ["k"], "rowid").collect()) == [("a", 1, "y"), ("b", 2, "x")]


def test_range_is_inclusive_and_checked(spark):
    df = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 2, 3)], "d date")
    assert cleaning.between_dates(df, "d", date(2024, 1, 1), date(2024, 1, 2)).count() == 2
    with pytest.raises(ValueError):
        cleaning.between_dates(df, "d", date(2024, 1, 2), date(2024, 1, 1))
    assert cleaning.is_empty_range(df.where("d > '2025-01-01'"))


def test_null_lot_numbers_do_not_empty_the_anti_join(spark):
    contracts = spark.createDataFrame([(1,), (2,), (None,)], "lot_number long")
    lots = spark.createDataFrame([(1,), (None,)], "lot_number long")
    assert {r[0] for r in reconciliation.without_lot(contracts, lots).collect()} == {2, None}


def test_lot_status_cases(spark):
    lots = spark.createDataFrame(
        [(1, 1.0, 10.0, 10.0), (2, 1.0, 10.0, 10.0), (2, 2.0, 5.0, 10.0), (3, 1.0, 7.0, 7.0), (4, 1.0, 9.0, 9.0),
         (5, 1.0, 9.0, 9.0), (5, 1.0, 9.0, 9.0)],
        "lot_number long, good_count double, unit_price double, total_price double")
    contracts = spark.createDataFrame(
        [(1, 1.0, 10.0, 10.0), (2, 1.0, 10.0, 10.0), (2, 2.0, 6.0, 12.0), (3, 1.0, 7.0, 8.0), (4, 1.0, 9.0, 8.0),
         (4, 1.0, 9.0, 8.0), (5, 1.0, 9.0, 9.0)],
        "lot_number long, quantity double, unit_price double, total_contract_amount double")
    got = {r["lot_number"]: r["status"] for r in reconciliation.lot_status(lots, contracts).collect()}
    assert got == {1: "sums equal", 2: "rows differ", 3: "rows equal", 4: "rows grew", 5: "rows fell"}


def test_abc_classes(spark):
    df = spark.createDataFrame([("d", "s1", "EUR", 70.0), ("d", "s2", "EUR", 20.0), ("d", "s3", "EUR", 10.0)],
                               "discipline string, winner_name string, currency string, total_price double")
    assert {r["winner_name"]: r["abc"] for r in spend.abc_classes(df).collect()} == {"s1": "A", "s2": "B", "s3": "C"}

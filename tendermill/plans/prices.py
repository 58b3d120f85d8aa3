"""Prices: by supplier and good, by discipline, competition, signing speed and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.functions import values
from tendermill.operators import cleaning, grouping
from tendermill.operators.describing import column_summary
from tendermill.operators.quantiles import exact_quantiles
from tendermill.session import stored


def supplier_prices(lots: DataFrame) -> DataFrame:
    """Per good and supplier: price statistics, distinct lots, quantity and last date in one pass.

    The exact median is its own grouped quantile, so no price list of a hot good is
    ever held by one task.
    """
    keys = ["good_name", "winner_name"]
    plain = lots.groupBy(*keys).agg(
        F.avg("unit_price_eur").alias("mean_price"), F.min("unit_price_eur").alias("min_price"),
        F.max("unit_price_eur").alias("max_price"), F.stddev_samp("unit_price_eur").alias("std_price"),
        F.countDistinct("lot_number").alias("lots"), F.sum("supplier_qty").alias("quantity"),
        F.max("close_date").alias("last_date"))
    medians = exact_quantiles(lots, keys, "unit_price_eur", {"median_price": 0.5})
    return grouping.null_safe_join(plain, medians, keys, "left")


def supplier_price_lots(lots: DataFrame) -> DataFrame:
    """The lots behind each (good, supplier), one row each."""
    return lots.select("good_name", "winner_name", "lot_number").distinct()


def goods_stats(lots: DataFrame) -> DataFrame:
    """Suppliers and lots per good; a good with one supplier is flagged."""
    return lots.groupBy("good_name").agg(
        F.countDistinct("winner_name").alias("suppliers"), F.countDistinct("lot_number").alias("lots")
    ).withColumn("single_supplier", F.col("suppliers") == 1)


def discipline_price_stats(lots: DataFrame) -> DataFrame:
    """Median, mean and deviation of unit price, total and quantity per discipline, one row per measure."""
    measures = ["unit_price_eur", "total_price_eur", "supplier_qty"]
    long = lots.select("discipline", F.explode(F.array(*(
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures))).alias("e")
    ).select("discipline", "e.*")
    return column_summary(long, "value", ["discipline", "measure"]).select(
        "discipline", "measure", F.col("q50").alias("median"), "mean", "std")


def anomaly_counts(anomalies: DataFrame, key: str, k: int = 20) -> DataFrame:
    return grouping.value_counts(anomalies, key).limit(k)


def price_spread(contracts: DataFrame, name: str = "product_type", flag: float = 30.0) -> DataFrame:
    """Gap between supplier mean prices of one product type, for types with at least two suppliers."""
    means = contracts.groupBy(name, "counterparty_name").agg(F.avg("unit_price_eur").alias("mean"))
    spread = means.groupBy(name).agg(F.count("*").alias("suppliers"), F.min("mean").alias("lowest"),
                                     F.max("mean").alias("highest"))
    gap = F.try_divide(F.col("highest") - F.col("lowest"), F.col("lowest")) * 100
    return spread.where(F.col("suppliers") >= 2).withColumn("gap_percent", gap).withColumn(
        "flagged", F.col("gap_percent") > flag)


def lot_competition(contracts: DataFrame) -> DataFrame:
    """Suppliers and value per lot."""
    per_supplier = contracts.groupBy("lot_number", "counterparty_name").agg(
        F.sum("total_contract_amount_eur").alias("amount"))
    return per_supplier.groupBy("lot_number").agg(F.count("*").alias("suppliers"), F.sum("amount").alias("amount"))


def competition_distribution(competition: DataFrame) -> DataFrame:
    counts = competition.groupBy("suppliers").agg(F.count("*").alias("lots"), F.sum("amount").alias("amount"))
    return grouping.with_share(counts, "lots", result="percent")


def single_supplier_lots(competition: DataFrame, k: int | None = None) -> DataFrame:
    single = competition.where(F.col("suppliers") == 1)
    return single if k is None else grouping.top(single, k, F.desc("amount"), "lot_number")


def supplier_wins(contracts: DataFrame) -> DataFrame:
    """Distinct lots, value and the disciplines of each supplier.

    The list holds distinct disciplines only, a small vocabulary.
    """
    per_lot = contracts.groupBy("counterparty_name", "lot_number", "discipline").agg(
        F.sum("total_contract_amount_eur").alias("amount"))
    lots = per_lot.groupBy("counterparty_name").agg(
        F.countDistinct("lot_number").alias("lots"), F.sum("amount").alias("amount"))
    names = contracts.select("counterparty_name", "discipline").distinct().groupBy("counterparty_name").agg(
        F.array_join(F.sort_array(F.collect_list("discipline")), ", ").alias("disciplines"))
    return lots.join(names, "counterparty_name")


def dominance(contracts: DataFrame, least: float = 50.0) -> DataFrame:
    """Suppliers holding more than ``least`` percent of a discipline."""
    totals = contracts.groupBy("discipline", "counterparty_name").agg(
        F.sum("total_contract_amount_eur").alias("amount"))
    return grouping.with_share(totals, "amount", ["discipline"]).where(F.col("share") > least)


def signing_speed(contracts: DataFrame) -> DataFrame:
    """Days from the end of the lot to signing; earlier signings are left out.

    Day counts take few distinct values, so a plain exact median stays small.
    """
    days = contracts.select(values.days_between("lot_end_date", "contract_signing_date").alias("days")).where("days >= 0")
    return days.agg(F.count("*").alias("contracts"), F.avg("days").alias("mean"), F.median("days").alias("median"),
                    F.min("days").alias("least"), F.max("days").alias("most"),
                    F.count_if(F.col("days") == 0).alias("same_day"))


def monthly_activity(contracts: DataFrame) -> DataFrame:
    return contracts.groupBy(values.month_start("contract_signing_date").alias("month")).agg(
        F.count("*").alias("contracts"), F.sum("total_contract_amount_eur").alias("amount"))


def value_by_terms(contracts: DataFrame, k: int = 5) -> DataFrame:
    totals = contracts.groupBy("payment_conditions").agg(grouping.exact_sum("total_contract_amount_eur").alias("amount"))
    return grouping.top(totals, k, F.desc("amount"), "payment_conditions")


def delivery_by_discipline(contracts: DataFrame) -> DataFrame:
    return contracts.groupBy("discipline").agg(
        F.avg(values.parsed_number("delivery_time_days")).alias("mean_days"))


def price_by_type(contracts: DataFrame, name: str = "product_type", k: int = 8) -> DataFrame:
    means = contracts.groupBy(name).agg(F.avg("unit_price_eur").alias("mean_price"))
    return grouping.top(means, k, F.desc("mean_price"), name)


def risk_score(contracts: DataFrame, prepaid: str = "100%") -> DataFrame:
    """One row: the five risk factors, the points they give, the level and the priority value.

    What the factors need of a contract is put together and written once.
    """
    checked = stored(cleaning.amount_check(contracts, "quantity", "unit_price", "product_amount").select(
        "lot_number", "counterparty_name", "total_contract_amount_eur", "is_error",
        F.col("payment_conditions").contains(prepaid).alias("is_prepaid"),
        values.days_between("lot_end_date", "contract_signing_date").alias("days")))
    competition = lot_competition(checked).agg(
        F.count("*").alias("lots"), F.count_if(F.col("suppliers") == 1).alias("single"),
        F.avg("suppliers").alias("mean_suppliers"))
    totals = checked.groupBy("counterparty_name").agg(grouping.exact_sum("total_contract_amount_eur").alias("amount"))
    top3 = grouping.top(totals, 3, F.desc("amount"), "counterparty_name").agg(F.sum("amount")).scalar()
    rows = checked.agg(
        F.sum("total_contract_amount_eur").alias("total"), F.count("*").alias("contracts"),
        F.count_if("is_prepaid").alias("prepaid"), F.count_if("is_error").alias("errors"),
        F.count_if(F.col("days") >= 0).alias("valid_days"), F.count_if(F.col("days") == 0).alias("same_day"))
    p75 = exact_quantiles(checked, [], "total_contract_amount_eur", {"q": 0.75}, reread=True).select("q").scalar()
    factors = grouping.with_row(rows, competition, "_lot").select(
        F.try_divide(F.col("_lot.single"), F.col("_lot.lots")).alias("single_share"), F.try_divide(top3, F.col("total")).alias("top3_share"),
        F.try_divide("prepaid", "contracts").alias("prepaid_share"), "errors",
        F.try_divide("same_day", "valid_days").alias("same_day_share"), F.col("_lot.mean_suppliers").alias("mean_suppliers"),
        p75.alias("priority_value"))
    points = (
        F.when(F.col("single_share") > 0.3, 3).when(F.col("single_share") > 0.1, 1).otherwise(0)
        + F.when(F.col("top3_share") > 0.6, 3).when(F.col("top3_share") > 0.4, 1).otherwise(0)
        + F.when(F.col("prepaid_share") > 0.5, 2).otherwise(0)
        + F.when(F.col("errors") > 0, 2).otherwise(0)
        + F.when(F.col("same_day_share") > 0.3, 1).otherwise(0)
    )
    level = (F.when(F.col("score") == 0, "none").when(F.col("score") <= 3, "low")
             .when(F.col("score") <= 6, "medium").otherwise("high"))
    return factors.withColumn("score", points).withColumn("level", level)


def over_price(offers: DataFrame, group: str, price: str) -> DataFrame:
    """Percent above the group's lowest price with a marker."""
    out = grouping.with_group_stats(offers, [group], lowest=F.min(price))
    percent = F.try_divide(F.col(price) - F.col("lowest"), F.col("lowest")) * 100
    marker = (F.when(F.col("over_percent") == 0, "best").when(F.col("over_percent") > 50, ">50")
              .when(F.col("over_percent") > 30, ">30").otherwise(""))
    return out.withColumn("over_percent", percent).withColumn("marker", marker)


# ---------------------------------------------------------------- warehouse stock


def warehouse_counts(stock: DataFrame) -> DataFrame:
    """Warehouses in all and distinct items on the latest date."""
    latest = stock.agg(F.max("date_column")).scalar()
    return stock.agg(F.countDistinct("warehouse").alias("warehouses")).select(
        "warehouses",
        stock.where(F.col("date_column") == latest).agg(F.countDistinct("nomenclature")).scalar().alias("items"),
        latest.alias("latest"))


def latest_stock_value(stock: DataFrame) -> DataFrame:
    latest = stock.agg(F.max("date_column")).scalar()
    return stock.where(F.col("date_column") == latest).groupBy("warehouse", "currency").agg(
        F.sum("total_price_currency").alias("value"))

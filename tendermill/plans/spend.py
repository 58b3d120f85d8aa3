"""Spend analyses over lots."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendermill.functions import values
from tendermill.operators import grouping
from tendermill.operators.quantiles import running_totals

OTHERS = "Другие"


def price_bounds(lots: DataFrame) -> DataFrame:
    kept = lots.where(F.col("currency").isNotNull() & (F.col("total_price") != 0))
    return kept.groupBy("discipline", "currency").agg(
        F.sum("total_price").alias("total"), F.min("total_price").alias("least"), F.max("total_price").alias("most"))


def distinct_lots(lots: DataFrame, *keys: str) -> DataFrame:
    return lots.groupBy(*keys).agg(F.countDistinct("lot_number").alias("lots"))


def monthly_totals(df: DataFrame, date_column: str, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys, values.month_start(date_column).alias("month")).agg(F.sum(value).alias("total"))


def half_year_totals(df: DataFrame, date_column: str, value: str) -> DataFrame:
    """Calendar halves."""
    half = F.ceil(F.month(date_column) / 6)
    return df.groupBy(F.year(date_column).alias("year"), half.alias("half")).agg(F.sum(value).alias("total"))


def month_by_discipline(lots: DataFrame, disciplines: Iterable[str]) -> DataFrame:
    monthly = lots.withColumn("month", values.month_start("close_date"))
    return grouping.pivoted(monthly, ["month"], "discipline", disciplines, F.sum("total_price_eur"))


def significant_disciplines(lots: DataFrame, least_percent: float = 2.0) -> DataFrame:
    """Totals of disciplines with a noticeable share; the rest is one line."""
    totals = lots.groupBy("discipline").agg(F.sum("total_price_eur").alias("total"))
    shared = grouping.with_share(totals, "total")
    label = F.when(F.col("share") >= least_percent, F.col("discipline")).otherwise(OTHERS)
    return shared.groupBy(label.alias("discipline")).agg(F.sum("total").alias("total"), F.sum("share").alias("share"))


def discipline_summary(lots: DataFrame) -> DataFrame:
    summary = lots.groupBy("discipline").agg(
        F.sum("total_price_eur").alias("total_eur"), F.avg("total_price_eur").alias("mean_eur"),
        F.count("total_price_eur").alias("purchases"), F.sum("total_price").alias("total_original"))
    return grouping.with_share(summary, "total_eur")


def series_stats(monthly: DataFrame) -> DataFrame:
    """One row about a monthly series (one row per month, so a plain median is small)."""
    return monthly.agg(
        F.avg("total").alias("mean"), F.median("total").alias("median"), F.stddev_samp("total").alias("std"),
        F.try_divide(F.stddev_samp("total"), F.avg("total")).alias("cv"),
        F.min("total").alias("least"), F.max("total").alias("most"))


def cv_by_discipline(lots: DataFrame) -> DataFrame:
    mean, std = F.avg("total_price_eur"), F.stddev_samp("total_price_eur")
    return lots.groupBy("discipline").agg(F.when(mean != 0, std / mean).otherwise(0.0).alias("cv"))


def cost_control(lots: DataFrame) -> DataFrame:
    return discipline_summary(lots).select("discipline", "share").join(cv_by_discipline(lots), "discipline")


def forecast_candidates(lots: DataFrame, least_share: float = 2.0, most_cv: float = 20.0) -> DataFrame:
    return cost_control(lots).where((F.col("share") >= least_share) & (F.col("cv") < most_cv))


def supplier_stats(lots: DataFrame) -> DataFrame:
    return lots.groupBy("winner_name").agg(
        F.sum("total_price_eur").alias("total"), F.count("total_price_eur").alias("purchases"),
        F.avg("total_price_eur").alias("mean"))


def overall_supplier_stats(lots: DataFrame) -> DataFrame:
    """Two levels, so the distinct count needs no expansion of the rows."""
    return supplier_stats(lots).agg(
        F.count("*").alias("suppliers"), F.sum("purchases").alias("purchases"), F.sum("total").alias("total"),
        (F.sum("total") / F.sum("purchases")).alias("mean"))


def top_suppliers(df: DataFrame, supplier: str, value: str, k: int = 10) -> DataFrame:
    totals = df.groupBy(supplier).agg(grouping.exact_sum(value).alias("total"))
    return grouping.top(totals, k, F.desc("total"), supplier)


def supplier_by_currency(lots: DataFrame, currencies: Iterable[str], k: int = 10) -> DataFrame:
    kept = grouping.keep_keys_of(lots, top_suppliers(lots, "winner_name", "total_price_eur", k), "winner_name")
    return grouping.pivoted(kept, ["winner_name"], "currency", currencies, F.sum("total_price"))


def supplier_by_month(lots: DataFrame, start: date, end: date, k: int = 10) -> DataFrame:
    kept = grouping.keep_keys_of(lots, top_suppliers(lots, "winner_name", "total_price_eur", k), "winner_name")
    ranged = kept.where(F.col("close_date").between(F.lit(start), F.lit(end)))
    labelled = ranged.withColumn("month", F.date_format("close_date", "yyyy-MM"))
    return grouping.pivoted(labelled, ["winner_name"], "month", grouping.months_between(start, end),
                            F.sum("total_price_eur"))


def supplier_months(lots: DataFrame, k: int = 10) -> DataFrame:
    """The k largest suppliers' totals of every month they have, as rows."""
    kept = grouping.keep_keys_of(lots, top_suppliers(lots, "winner_name", "total_price_eur", k), "winner_name")
    return kept.groupBy("winner_name", F.date_format("close_date", "yyyy-MM").alias("month")).agg(F.sum("total_price_eur").alias("total"))


def top_supplier_quarters(contracts: DataFrame, k: int = 10) -> DataFrame:
    best = top_suppliers(contracts, "counterparty_name", "total_contract_amount_eur", k)
    kept = grouping.keep_keys_of(contracts, best, "counterparty_name")
    return kept.groupBy("counterparty_name", F.trunc("contract_signing_date", "quarter").alias("quarter")).agg(
        F.sum("total_contract_amount_eur").alias("total"))


def top_supplier_products(contracts: DataFrame, k: int = 10) -> DataFrame:
    best = top_suppliers(contracts, "counterparty_name", "total_contract_amount_eur", k)
    kept = grouping.keep_keys_of(contracts, best, "counterparty_name")
    return kept.groupBy("counterparty_name", "product_name").agg(F.avg("total_contract_amount_eur").alias("mean"))


def top_supplier_range(contracts: DataFrame, k: int = 10) -> DataFrame:
    best = top_suppliers(contracts, "counterparty_name", "total_contract_amount_eur", k)
    kept = grouping.keep_keys_of(contracts, best, "counterparty_name")
    return kept.groupBy("counterparty_name").agg(
        F.countDistinct("product_name").alias("unique_products"),
        F.countDistinct("discipline").alias("unique_disciplines"))


def top_share_gini(contracts: DataFrame, k: int = 10) -> DataFrame:
    """Share of the k largest suppliers and the Gini figure of their shares.

    The Lorenz points are k rows; their window has a bound.
    """
    totals = contracts.groupBy("counterparty_name").agg(
        grouping.exact_sum("total_contract_amount_eur").alias("total"))
    everything = totals.agg(F.sum("total")).scalar()
    best = grouping.top(totals, k, F.desc("total"), "counterparty_name")
    shares = best.withColumn("share", F.col("total") / everything)
    w = Window.orderBy("share", F.desc("counterparty_name"))
    points = shares.withColumn("cumulative", F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    points = points.withColumn("previous", F.lag("cumulative").over(w))
    area = F.sum((F.col("cumulative") + F.col("previous")) / 2)
    return points.agg(F.sum("share").alias("top_share"),
                      (1 - 2 * area / F.count("*")).alias("gini"))


def win_frequency(lots: DataFrame) -> DataFrame:
    """Wins per project, discipline, person and supplier with their percent among the person's wins."""
    wins = lots.groupBy("project_name", "discipline", "actor_name", "winner_name").agg(F.count("*").alias("win_count"))
    shared = grouping.with_share(wins, "win_count", ["project_name", "discipline", "actor_name"], "win_percentage")
    return shared.withColumn("win_percentage", F.round("win_percentage", 2))


def favourite_suppliers(lots: DataFrame, k: int = 3) -> DataFrame:
    """Most frequent winners of each person."""
    return grouping.top_in_group(win_frequency(lots), ["project_name", "discipline", "actor_name"], k,
                                 F.desc("win_count"), "winner_name")


def bidding_duration(lots: DataFrame) -> DataFrame:
    """Mean days from opening to closing per person and supplier, against the discipline's mean."""
    days = values.days_between("open_date", "close_date")
    parts = lots.groupBy("discipline", "actor_name", "winner_name").agg(
        F.count(days).alias("win_count"), F.avg(days).alias("average_duration"), F.sum(days).alias("_days"))
    out = grouping.with_group_stats(parts, ["discipline"],
                                    overall_avg_duration=F.sum("_days") / F.sum("win_count"))
    return out.withColumn("duration_difference", F.col("average_duration") - F.col("overall_avg_duration")).drop("_days")


def lots_by_quarter(lots: DataFrame) -> DataFrame:
    """Lots per discipline and quarter of the year, columns ``q1`` to ``q4``."""
    pairs = lots.groupBy("discipline", F.quarter("close_date").alias("quarter")).agg(
        F.countDistinct("lot_number").alias("lots"))
    return grouping.pivoted(pairs, ["discipline"], "quarter", [1, 2, 3, 4], F.sum("lots"), fill=0, prefix="q")


def lot_list_by_quarter(lots: DataFrame) -> DataFrame:
    """The lot numbers behind :func:`lots_by_quarter`, one row each.

    Long form on purpose: a joined text of all lots of a group grows without bound.
    """
    return lots.select("discipline", F.quarter("close_date").alias("quarter"), "lot_number").distinct()


def currency_months(lots: DataFrame) -> DataFrame:
    return monthly_totals(lots, "close_date", "total_price", "currency")


def currency_leaders(lots: DataFrame, k: int = 5) -> DataFrame:
    totals = lots.groupBy("currency", "winner_name").agg(grouping.exact_sum("total_price").alias("total"))
    return grouping.top_in_group(totals, ["currency"], k, F.desc("total"), "winner_name")


def percent_of_peak(monthly: DataFrame, key: str) -> DataFrame:
    """Each monthly value as percent of its series' maximum."""
    out = grouping.with_group_stats(monthly, [key], peak=F.max("total"))
    return out.withColumn("percent_of_peak", F.try_divide(F.col("total"), F.col("peak")) * 100).drop("peak")


def abc_classes(lots: DataFrame, a: float = 70.0, b: float = 90.0) -> DataFrame:
    """Spend per discipline, supplier and currency with cumulative percent and class inside each currency."""
    spend = lots.groupBy("discipline", "winner_name", "currency").agg(grouping.exact_sum("total_price").alias("total"))
    run = running_totals(spend, ["currency"], "total", ["discipline", "winner_name"])
    cumulative = F.col("running") / F.col("group_total") * 100
    kind = F.when(cumulative <= a, "A").when(cumulative <= b, "B").otherwise("C")
    return run.select("discipline", "winner_name", "currency", "total",
                      (F.col("total") / F.col("group_total") * 100).alias("share"),
                      cumulative.alias("cumulative"), kind.alias("abc"))

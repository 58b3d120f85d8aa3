"""How concentrated the supplier market of each discipline is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.operators import grouping

# Bounds and names of the concentration bands, share that makes a supplier major.
BANDS = [(1500.0, "Конкурентный рынок"), (2500.0, "Умеренная концентрация")]
HIGH_BAND = "Высокая концентрация"
MAJOR_SHARE = 8.0

AMOUNT = "total_contract_amount_eur"


def supplier_shares(contracts: DataFrame) -> DataFrame:
    """Percent of each supplier in its discipline."""
    totals = contracts.groupBy("discipline", "counterparty_name").agg(F.sum(AMOUNT).alias("amount"))
    return grouping.with_share(totals, "amount", ["discipline"], "supp_share")


def hhi(contracts: DataFrame) -> DataFrame:
    """Sum of squared percent shares. Both sums come from one pass over supplier totals, without a join."""
    totals = contracts.groupBy("discipline", "counterparty_name").agg(F.sum(AMOUNT).alias("amount"))
    return totals.groupBy("discipline").agg(
        (F.sum(F.col("amount") * F.col("amount")) / (F.sum("amount") * F.sum("amount")) * 10000.0).alias("hhi_index"),
        F.count("*").alias("suppliers"), F.sum("amount").alias("total_eur"))


def hhi_bands(index: DataFrame, bands=None, high: str = HIGH_BAND) -> DataFrame:
    bands = BANDS if bands is None else bands
    band = None
    for bound, name in bands:
        band = F.when(F.col("hhi_index") < bound, name) if band is None else band.when(F.col("hhi_index") < bound, name)
    return index.withColumn("band", band.otherwise(high))


def major_suppliers(shares: DataFrame, least: float = MAJOR_SHARE) -> DataFrame:
    return shares.where(F.col("supp_share") >= least)


def major_and_others(shares: DataFrame, least: float = MAJOR_SHARE, others: str = "Другие") -> DataFrame:
    """Major suppliers by name and one line for all others of the discipline."""
    label = F.when(F.col("supp_share") >= least, F.col("counterparty_name")).otherwise(others)
    return shares.groupBy("discipline", label.alias("label")).agg(F.sum("supp_share").alias("share"))

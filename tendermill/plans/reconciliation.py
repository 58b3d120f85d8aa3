"""Lots against contracts, and suppliers shared between disciplines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendermill.operators import cleaning, grouping

SUSPICIOUS = "Нетипично для честной закупки. Проверить"


def reconciled(lots: DataFrame, contracts: DataFrame) -> DataFrame:
    """Inner join of both sides, each aggregated first, on lot, currency and supplier."""
    left = lots.groupBy("lot_number", "currency", "winner_name", "actor_name", "discipline").agg(
        F.sum("total_price").alias("total_price_kp"), F.sum("supplier_qty").alias("supplier_qty_kp"),
        F.avg("unit_price").alias("unit_average_kp"))
    right = contracts.where(F.col("contract_signing_date").isNotNull()).groupBy(
        "lot_number", F.col("contract_currency").alias("currency"), F.col("counterparty_name").alias("winner_name"),
        "executor_dak").agg(
        F.sum("total_contract_amount").alias("total_contract_amount"), F.sum("quantity").alias("quantity_contract"),
        F.avg("unit_price").alias("unit_average_contract"))
    return left.join(right, ["lot_number", "currency", "winner_name"])


def contracts_of_lots(contracts: DataFrame, lots: DataFrame, start, end) -> DataFrame:
    """Contracts of the range whose lot is among the given lots."""
    ranged = cleaning.between_dates(contracts, "contract_signing_date", start, end)
    return ranged.join(lots.select("lot_number"), "lot_number", "left_semi")


def discrepancies(pairs: DataFrame, tolerance: float = 0.01, growth: float = 3.0) -> DataFrame:
    """Pairs whose sums differ and whose unit price grew by ``growth`` percent or more."""
    percent = F.try_divide(F.col("unit_average_contract") - F.col("unit_average_kp"), F.col("unit_average_kp")) * 100
    differing = pairs.where(F.abs(F.col("total_price_kp") - F.col("total_contract_amount")) > tolerance)
    return differing.withColumn("discr_percent", percent).where(F.col("discr_percent") >= growth).withColumn(
        "status", F.lit(SUSPICIOUS))


def with_lot_project(contracts: DataFrame, lots: DataFrame) -> DataFrame:
    """Project of the lot's first line; a contract without a lot keeps its row."""
    first = cleaning.first_in_lot(lots.select("lot_number", "project_name"), "project_name")
    return contracts.drop("project_name").join(first, "lot_number", "left")


def with_lot_projects(contracts: DataFrame, lots: DataFrame) -> DataFrame:
    """One row per contract and project of its lot."""
    return contracts.drop("project_name").join(lots.select("lot_number", "project_name").distinct(), "lot_number", "left")


def without_lot(contracts: DataFrame, lots: DataFrame) -> DataFrame:
    """Contracts whose lot the lots do not know. Null lot numbers of the lots cannot empty the result."""
    known = lots.where(F.col("lot_number").isNotNull()).select("lot_number")
    return contracts.join(known, "lot_number", "left_anti")


def without_lot_summary(contracts: DataFrame, lots: DataFrame) -> DataFrame:
    return without_lot(contracts, lots).groupBy("lot_number", "counterparty_name", "contract_currency").agg(
        F.min("product_name").alias("first_product"), F.sum("total_contract_amount").alias("amount"),
        F.count("*").alias("lines"))


def executors_with_early_contracts(contracts: DataFrame, k: int | None = None) -> DataFrame:
    """Executors by the number of contracts signed before the lot ended."""
    counts = grouping.value_counts(cleaning.signed_before_lot_end(contracts), "executor_dak", "contracts")
    return counts if k is None else counts.limit(k)


def lot_status(lots: DataFrame, contracts: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per lot: sums equal, rows equal or differing, rows grown or fallen.

    With the same number of rows on both sides, rows sorted alike differ exactly when
    the counts per (quantity, price) differ, so no rows are lined up by position.
    """
    left = lots.groupBy("lot_number", F.col("good_count").alias("quantity"), "unit_price").agg(
        F.count("*").alias("n"), F.sum("total_price").alias("amount"))
    right = contracts.groupBy("lot_number", "quantity", "unit_price").agg(
        F.count("*").alias("n"), F.sum("total_contract_amount").alias("amount"))
    zero = F.lit(0)
    sides = left.select("*", F.lit(1).alias("side")).unionByName(right.select("*", F.lit(-1).alias("side")))
    kinds = sides.groupBy("lot_number", "quantity", "unit_price").agg(
        F.sum(F.col("n") * F.col("side")).alias("gap"),
        F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(zero)).alias("n_lot"),
        F.sum(F.when(F.col("side") == -1, F.col("n")).otherwise(zero)).alias("n_contract"),
        F.sum(F.when(F.col("side") == 1, F.col("amount")).otherwise(0.0)).alias("lot_sum"),
        F.sum(F.when(F.col("side") == -1, F.col("amount")).otherwise(0.0)).alias("contract_sum"))
    per_lot = kinds.groupBy("lot_number").agg(
        F.sum("n_lot").alias("lot_rows"), F.sum("n_contract").alias("contract_rows"),
        F.sum("lot_sum").alias("lot_sum"), F.sum("contract_sum").alias("contract_sum"),
        F.sum(F.abs("gap")).alias("differing"))
    both = per_lot.where((F.col("contract_rows") > 0) & (F.col("lot_rows") > 0))
    status = (
        F.when(F.abs(F.col("lot_sum") - F.col("contract_sum")) <= tolerance, "sums equal")
        .when((F.col("lot_rows") == F.col("contract_rows")) & (F.col("differing") == 0), "rows equal")
        .when(F.col("lot_rows") == F.col("contract_rows"), "rows differ")
        .when(F.col("lot_rows") < F.col("contract_rows"), "rows grew")
        .otherwise("rows fell")
    )
    return both.select("lot_number", "lot_rows", "contract_rows", "lot_sum", "contract_sum", status.alias("status"))


def lined_up(lots: DataFrame, contracts: DataFrame, *order: str) -> DataFrame:
    """Lines of both sides paired by their place inside the lot, in the stated order."""
    left = cleaning.ranked_once(lots, ["lot_number"], *order)
    right = cleaning.ranked_once(contracts, ["lot_number"], *order)
    return left.join(right, ["lot_number", "rn"])


# ---------------------------------------------------------------- suppliers across disciplines


def shared_suppliers(lots: DataFrame) -> DataFrame:
    """Discipline pairs with each supplier they share, one row per supplier.

    The join works on distinct (discipline, supplier): a supplier meets itself once per
    discipline, however many lots it won.
    """
    pairs = lots.select("discipline", "winner_name").distinct()
    return (
        pairs.withColumnRenamed("discipline", "discipline1")
        .join(pairs.withColumnRenamed("discipline", "discipline2"), "winner_name")
        .where(F.col("discipline1") < F.col("discipline2"))
    )


def shared_supplier_counts(shared: DataFrame) -> DataFrame:
    return shared.groupBy("discipline1", "discipline2").agg(F.count("*").alias("suppliers"))


def cross_discipline_prices(lots: DataFrame, least_gap: float = 10.0) -> DataFrame:
    """Price of the same good from the same supplier in two disciplines, gap above ``least_gap`` percent."""
    prices = lots.groupBy("discipline", "winner_name", "good_name").agg(
        F.avg("unit_price_eur").alias("price"), F.countDistinct("lot_number").alias("lots"))
    sides = [
        prices.select("winner_name", "good_name", *(F.col(c).alias(f"{c}{i}") for c in ("discipline", "price", "lots")))
        for i in (1, 2)
    ]
    pairs = sides[0].join(sides[1], ["winner_name", "good_name"]).where(F.col("discipline1") < F.col("discipline2"))
    gap = F.try_divide((F.col("price1") - F.col("price2")) * 100, F.col("price1") + F.col("price2"))
    return pairs.withColumn("percent_of_diff", gap).where(F.abs("percent_of_diff") > least_gap)


def cross_discipline_lots(lots: DataFrame, gaps: DataFrame) -> DataFrame:
    """The lot numbers behind the gaps, one row each."""
    keys = stacked_keys(gaps)
    return lots.join(keys, ["discipline", "winner_name", "good_name"], "left_semi").select(
        "discipline", "winner_name", "good_name", "lot_number").distinct()


def stacked_keys(gaps: DataFrame) -> DataFrame:
    sides = [gaps.select(F.col(f"discipline{i}").alias("discipline"), "winner_name", "good_name") for i in (1, 2)]
    return grouping.stacked(*sides)


def gap_statistics(gaps: DataFrame) -> DataFrame:
    return gaps.agg(F.count("*").alias("matches"), F.countDistinct("winner_name").alias("suppliers"),
                    F.avg("percent_of_diff").alias("mean_gap"))


def gap_matrix(gaps: DataFrame, disciplines) -> DataFrame:
    """Symmetric discipline x discipline counts."""
    sides = [gaps.select(F.col(f"discipline{i}").alias("discipline"), F.col(f"discipline{3 - i}").alias("other"))
             for i in (1, 2)]
    return grouping.pivoted(grouping.stacked(*sides), ["discipline"], "other", disciplines, F.count(F.lit(1)), fill=0)


# ---------------------------------------------------------------- graph tables


def edges(lots: DataFrame, *keys: str) -> DataFrame:
    """Project-discipline and discipline-supplier edges, optionally per currency."""
    first = lots.select(*keys, F.col("project_name").alias("source"), F.col("discipline").alias("target"),
                        F.lit("project-discipline").alias("kind")).distinct()
    second = lots.select(*keys, F.col("discipline").alias("source"), F.col("winner_name").alias("target"),
                         F.lit("discipline-supplier").alias("kind")).distinct()
    return first.unionByName(second)


def vertices(lots: DataFrame) -> DataFrame:
    kinds = {"project": "project_name", "discipline": "discipline", "supplier": "winner_name"}
    return grouping.stacked(*(lots.select(F.col(c).alias("name"), F.lit(k).alias("kind")).distinct()
                              for k, c in kinds.items()))


def common_suppliers(lots: DataFrame) -> DataFrame:
    """Suppliers of several disciplines of a project, with the largest price variation over currencies."""
    mean, std = F.avg("total_price"), F.coalesce(F.stddev_samp("total_price"), F.lit(0.0))
    cv: Column = F.when(mean != 0, std / mean).otherwise(0.0)
    volatility = lots.groupBy("project_name", "winner_name", "currency").agg(cv.alias("cv"))
    volatility = volatility.groupBy("project_name", "winner_name").agg(F.max("cv").alias("cv"))
    # disciplines are a small vocabulary and distinct before they are listed
    spread = lots.select("project_name", "winner_name", "discipline").distinct().groupBy(
        "project_name", "winner_name").agg(
        F.count("*").alias("disciplines"), F.array_join(F.sort_array(F.collect_list("discipline")), ", ").alias("names"))
    return spread.where(F.col("disciplines") > 1).join(volatility, ["project_name", "winner_name"])


def common_supplier_graph(lots: DataFrame, cap: float = 0.5) -> DataFrame:
    """Discipline-supplier edges of common suppliers, weighted by variation up to ``cap``."""
    weights = common_suppliers(lots).select("project_name", "winner_name", F.least("cv", F.lit(cap)).alias("weight"))
    links = lots.select("project_name", "discipline", "winner_name").distinct()
    return links.join(weights, ["project_name", "winner_name"])

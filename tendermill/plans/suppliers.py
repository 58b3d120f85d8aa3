"""Feature tables of suppliers and people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.functions import values
from tendermill.operators import grouping
from tendermill.operators.quantiles import exact_quantiles, percentile_rank
from tendermill.session import checkpointed, stored

SUPPLIER = "counterparty_name"
AMOUNT = "total_contract_amount_eur"
READ = [SUPPLIER, AMOUNT, "unit_price_eur", "contract_signing_date", "delivery_time_days", "quantity", "product_amount",
        "additional_expenses", "project_name", "product_name", "unit", "discipline", "contract_currency"]


def supplier_aggregates(contracts: DataFrame) -> DataFrame:
    """Aggregates of the five measures and the distinct counts per supplier."""
    days = F.coalesce(values.parsed_number("delivery_time_days"), F.lit(0.0))
    rows = contracts.withColumn("_days", days).fillna(
        0.0, subset=[AMOUNT, "unit_price_eur", "quantity", "product_amount", "additional_expenses"])

    def of(column: str, **named):
        return [getattr(F, function)(column).alias(name) for name, function in named.items()]

    stats = rows.groupBy(SUPPLIER).agg(
        # volume orders the ranks below, so its sum must not depend on the order of the rows
        grouping.exact_sum(AMOUNT).alias("total_volume"),
        *of(AMOUNT, avg_contract_value="avg", amount_std="stddev_samp", contracts_count="count", min_contract_value="min",
            max_contract_value="max"),
        *of("unit_price_eur", avg_unit_price="avg", price_std="stddev_samp", min_unit_price="min", max_unit_price="max"),
        *of("contract_signing_date", first_contract="min", last_contract="max"),
        *of("_days", avg_delivery_time="avg", delivery_std="stddev_samp", min_delivery_time="min", max_delivery_time="max"),
        *of("quantity", total_quantity="sum", avg_quantity="avg", quantity_std="stddev_samp", min_quantity="min",
            max_quantity="max"),
        *of("product_amount", product_sum="sum", product_mean="avg", product_std="stddev_samp"),
        *of("additional_expenses", expenses_sum="sum", expenses_mean="avg"),
    )
    counts = contracts.groupBy(SUPPLIER).agg(
        F.countDistinct("project_name").alias("projects_count"), F.countDistinct("product_name").alias("products_count"),
        F.countDistinct("unit").alias("units_count"), F.countDistinct("discipline").alias("disciplines_count"),
        F.countDistinct("contract_currency").alias("currencies_count"))
    return stats.join(counts, SUPPLIER)


def seasonal_variance(contracts: DataFrame) -> DataFrame:
    """Variance of a supplier's contract counts over the months of the year seen anywhere; absent months count 0.

    Absent months add nothing to the sums, so no spine of months is joined.
    """
    month = F.month("contract_signing_date")
    seen = contracts.agg(F.countDistinct(month)).scalar()
    counts = contracts.groupBy(SUPPLIER, month.alias("moy")).agg(F.count("*").alias("n"))
    squares, total = F.sum(F.col("n") * F.col("n")), F.sum("n")
    summed = counts.groupBy(SUPPLIER).agg(squares.alias("_sq"), total.alias("_n"))
    variance = F.try_divide(F.col("_sq") - F.col("_n") * F.col("_n") / seen, seen - 1)
    return summed.select(SUPPLIER, variance.alias("seasonal_variance"))


def supplier_features(contracts: DataFrame) -> DataFrame:
    """The full feature table: aggregates plus derived ratios, volatilities, ranks and indices; nulls become 0.

    Statistics, distinct counts and seasons read the contracts anew, so they are put together once; the ranks read the aggregates again.
    """
    contracts = stored(contracts.select(*READ))
    base = checkpointed(supplier_aggregates(contracts))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    first = base.withColumns({
        "years_active": F.greatest(F.datediff("last_contract", "first_contract") / 365.25, F.lit(0.1)),
        "price_volatility": ratio("price_std", "avg_unit_price"),
        "contract_size_volatility": ratio("amount_std", "total_volume"),
        "quantity_volatility": ratio("quantity_std", "avg_quantity"),
        "delivery_volatility": ratio("delivery_std", "avg_delivery_time"),
        "contract_size_range": F.col("max_contract_value") - F.col("min_contract_value"),
        "price_range": F.col("max_unit_price") - F.col("min_unit_price"),
        "diversification_index": F.pow(
            F.log1p("projects_count") * F.log1p("products_count") * F.log1p("units_count") * F.log1p("disciplines_count"),
            F.lit(0.25)),
        "specialization_ratio": F.col("contracts_count") / F.greatest("products_count", F.lit(1)),
        "delivery_efficiency": 1 / (F.col("avg_delivery_time") + 1),
        "additional_expenses_ratio": ratio("expenses_sum", "total_volume"),
        "avg_quantity_per_contract": ratio("total_quantity", "contracts_count"),
        "revenue_per_project": F.col("total_volume") / F.greatest("projects_count", F.lit(1)),
        "single_client_dependency": F.coalesce(F.try_divide(F.lit(1.0), "projects_count"), F.lit(0.0)),
    })
    second = first.withColumns({
        "avg_contracts_per_year": F.col("contracts_count") / (F.col("years_active") + 1),
        "contract_consistency": 1 / (F.col("contract_size_volatility") + 0.1),
        "price_stability_score": 1 / (F.col("price_volatility") + 0.1),
    })
    ranked = percentile_rank(second, "total_volume", "total_volume_rank").withColumn(
        "avg_contract_size_rank", F.col("total_volume_rank"))
    full = ranked.join(seasonal_variance(contracts), SUPPLIER, "left")
    return full.fillna(0.0).fillna(0)


def clustering_columns(features: DataFrame) -> list[str]:
    """All numeric features."""
    return [f.name for f in features.schema.fields if f.dataType.typeName() in ("double", "long", "integer")]


def simple_supplier_features(deals: DataFrame, supplier: str, amount: str) -> DataFrame:
    """Count, mean, median, spread, logs and quartile width per supplier; the total is the sum of its deals."""
    plain = deals.groupBy(supplier).agg(
        F.sum(amount).alias("total_amount"), F.count("*").alias("contract_count"), F.avg(amount).alias("avg_amount"),
        F.coalesce(F.stddev_samp(amount), F.lit(0.0)).alias("amount_std"))
    q = exact_quantiles(deals, [supplier], amount, {"median_amount": 0.5, "_q1": 0.25, "_q3": 0.75})
    return grouping.null_safe_join(plain, q, [supplier], "left").withColumns({
        "amount_cv": F.coalesce(F.try_divide("amount_std", "avg_amount"), F.lit(0.0)),
        "log_total_amount": F.log1p("total_amount"), "log_avg_amount": F.log1p("avg_amount"),
        "log_contract_count": F.log1p("contract_count"),
        "amount_percentile": F.coalesce(F.col("_q3") - F.col("_q1"), F.lit(0.0))}).drop("_q1", "_q3")


def actor_supplier_spend(lots: DataFrame) -> DataFrame:
    """Lots and money of each person with each supplier per discipline: the full sum of the pair."""
    return lots.groupBy("discipline", "actor_name", "winner_name").agg(
        F.count("*").alias("lot_count"), F.sum("total_price_eur").alias("total"))


def actor_profiles(lots: DataFrame) -> DataFrame:
    per_lot = lots.groupBy("actor_name", "lot_number").agg(F.count("*").alias("n"), F.sum("total_price_eur").alias("total"))
    totals = per_lot.groupBy("actor_name").agg(
        F.sum("total").alias("total"), F.sum("n").alias("lot_lines"), F.count("*").alias("lots"))
    suppliers = lots.groupBy("actor_name").agg(F.countDistinct("winner_name").alias("suppliers"))
    return totals.join(suppliers, "actor_name")


def actor_supplier_flags(lots: DataFrame) -> DataFrame:
    """Person x supplier matrix in its sparse form: one row for each 1."""
    return lots.select("actor_name", "winner_name").distinct()

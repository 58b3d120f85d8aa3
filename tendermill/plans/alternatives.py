"""Who else could supply a product."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendermill.operators import grouping

PRODUCT = ["discipline", "product_name"]
OFFER = [*PRODUCT, "counterparty_name"]

# Recommendation texts.
RECOMMENDED = "⭐ РЕКОМЕНДУЕТСЯ: Опытный поставщик с привлекательными ценами"
SUITABLE = "✅ ПОДХОДИТ: Надежный поставщик с хорошей репутацией"
CAREFUL = "⚠️ ОСТОРОЖНО: Ограниченный опыт, требует дополнительной проверки"
NOT_RECOMMENDED = "❌ НЕ РЕКОМЕНДУЕТСЯ: Недостаточный опыт работы"


def supplier_profiles(contracts: DataFrame) -> DataFrame:
    """Record of each supplier of each product in one pass over the contracts."""
    first, last = F.min("contract_signing_date"), F.max("contract_signing_date")
    return contracts.groupBy(*OFFER).agg(
        F.count("*").alias("contracts_count"), F.sum("total_contract_amount_eur").alias("total_value"),
        F.avg("unit_price_eur").alias("avg_price"), F.stddev_samp("unit_price_eur").alias("price_std"),
        first.alias("first_contract"), last.alias("last_contract"),
        F.greatest(F.datediff(last, first) / 365.25, F.lit(1.0)).alias("years_experience"),
        F.countDistinct("project_name").alias("projects_count"))


def _score(current: Column) -> Column:
    price, std = F.col("avg_price"), F.col("price_std")
    cheaper = (current - price) / F.when(current > 0, current)
    price_part = F.when((current > 0) & (price > 0), F.when(cheaper > 0, F.least(cheaper * 100, F.lit(20.0)))
                        .otherwise(F.greatest(cheaper * 50, F.lit(-10.0)))).otherwise(0.0)
    stability = F.when(std > 0, F.greatest(10 - F.try_divide(std, price) * 100, F.lit(0.0))).otherwise(0.0)
    total = (
        F.lit(50.0) + F.least(F.col("years_experience") * 5, F.lit(25.0)) + F.least(F.col("contracts_count") * 2, F.lit(15))
        + price_part + stability + F.least(F.col("projects_count") * 2, F.lit(10))
    )
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0))


def _texts(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(condition, text) for condition, text in pairs)))


def assessed(alternatives: DataFrame, now: date) -> DataFrame:
    """Score, strong points, risks and advice for rows that carry ``current_avg_price``."""
    current = F.col("current_avg_price")
    variation = F.try_divide(F.col("price_std"), F.col("avg_price"))
    years, number, projects = F.col("years_experience"), F.col("contracts_count"), F.col("projects_count")
    one = lambda c: F.format_number(c, 1)
    advantages = _texts(
        (years >= 3, F.concat(F.lit("Большой опыт работы ("), one(years), F.lit(" лет)"))),
        (number >= 10, F.concat(F.lit("Высокая контрактная активность ("), number, F.lit(" контрактов)"))),
        ((current > 0) & (F.col("avg_price") < current * 0.9),
         F.concat(F.lit("Ценовое преимущество (экономия "), one((1 - F.try_divide(F.col("avg_price"), current)) * 100),
                  F.lit("%)"))),
        (projects > 1, F.concat(F.lit("Работа на разных проектах ("), projects, F.lit(" проектов)"))),
        (variation < 0.15, F.lit("Стабильные цены")),
    )
    risks = _texts(
        (years < 1, F.lit("Недостаточный опыт работы")), (number < 3, F.lit("Малое количество контрактов")),
        (variation > 0.3, F.lit("Нестабильные цены")),
        (F.datediff(F.lit(now), F.col("last_contract")) > 365, F.lit("Длительный перерыв в работе")),
    )
    advice = (
        F.when((number >= 5) & (years >= 2) & (current > 0) & (F.col("avg_price") < current), RECOMMENDED)
        .when((number >= 5) & (years >= 2), SUITABLE).when(number >= 2, CAREFUL).otherwise(NOT_RECOMMENDED)
    )
    versus = F.when(current > 0, (F.col("avg_price") - current) / current * 100).otherwise(0.0)
    return alternatives.withColumns({
        "recommendation_score": _score(current), "price_vs_current": versus, "advantages": advantages, "risks": risks,
        "recommendation": advice})


def current_offers(current: DataFrame) -> DataFrame:
    """Suppliers now used for each product of the project."""
    return current.select(*OFFER).distinct()


def current_prices(current: DataFrame) -> DataFrame:
    return current.groupBy(*PRODUCT).agg(F.avg("unit_price_eur").alias("current_avg_price"))


def alternatives(profiles: DataFrame, current: DataFrame, now: date, target: str | None = None) -> DataFrame:
    """Suppliers of the current products other than those used now (or than one target supplier)."""
    candidates = profiles.join(current_prices(current), PRODUCT)
    if target is None:
        others = candidates.join(current_offers(current), OFFER, "left_anti")
    else:
        others = candidates.where(F.col("counterparty_name") != target)
    return assessed(others, now)


def best_alternatives(found: DataFrame, k: int = 3) -> DataFrame:
    return grouping.top_in_group(found, PRODUCT, k, F.desc("recommendation_score"), "counterparty_name")


def market_position(profiles: DataFrame, current: DataFrame) -> DataFrame:
    """Supplier counts, share of the current ones, room for diversification and advice per product."""
    used = current_offers(current).withColumn("used", F.lit(1))
    products = current.select(*PRODUCT).distinct()
    market = profiles.join(products, PRODUCT, "left_semi").join(used, OFFER, "left").groupBy(*PRODUCT).agg(
        F.count("*").alias("total_suppliers"), F.count("used").alias("current_suppliers"),
        F.try_divide(F.sum(F.when(F.col("used") == 1, F.col("contracts_count")).otherwise(0)),
                     F.sum("contracts_count")).alias("market_coverage"))
    other = F.col("total_suppliers") - F.col("current_suppliers")
    n = F.col("alternative_suppliers")
    summary = (
        F.when(n == 0, "Критический риск: альтернативы не найдены. Требуется расширение поиска поставщиков.")
        .when(n <= 2, F.concat(F.lit("Ограниченный выбор: "), n, F.lit(
            " альтернатив. Рекомендуется активный поиск новых поставщиков.")))
        .otherwise(F.concat(F.lit("Хорошие возможности диверсификации: "), n, F.lit(" альтернатив доступно.")))
    )
    return market.withColumn("alternative_suppliers", other).withColumns({
        "diversification": F.try_divide(n, F.col("total_suppliers")),
        "competitiveness": F.when(n > F.col("current_suppliers"), "Высокая").when(n > 0, "Средняя").otherwise("Низкая"),
        "summary": summary})


def alternatives_for_major(profiles: DataFrame, contracts: DataFrame, major: DataFrame, now: date) -> DataFrame:
    """Alternatives to every major supplier of a discipline, in one join instead of one search each.

    One row per product, major supplier and other supplier of the product.
    """
    held = contracts.join(major.select("discipline", "counterparty_name"), ["discipline", "counterparty_name"], "left_semi")
    current = held.groupBy(*OFFER).agg(F.avg("unit_price_eur").alias("current_avg_price")).withColumnRenamed(
        "counterparty_name", "major_supplier")
    others = profiles.join(current, PRODUCT).where(F.col("counterparty_name") != F.col("major_supplier"))
    return assessed(others, now)


def major_totals(found: DataFrame) -> DataFrame:
    """Products and distinct alternatives found for each major supplier."""
    return found.groupBy("discipline", "major_supplier").agg(
        F.countDistinct("product_name").alias("products"), F.countDistinct("counterparty_name").alias("alternatives"),
        F.avg("recommendation_score").alias("mean_score"), F.max("recommendation_score").alias("best_score"))


def current_and_other_prices(contracts: DataFrame, project: str) -> DataFrame:
    """Older form: per product mean price and suppliers inside the project and outside it."""
    inside = F.col("project_name") == project
    per_supplier = contracts.groupBy(*OFFER).agg(
        F.sum(F.when(inside, F.col("unit_price_eur"))).alias("in_sum"), F.count_if(inside).alias("in_n"),
        F.sum(F.when(~inside, F.col("unit_price_eur"))).alias("out_sum"), F.count_if(~inside).alias("out_n"))
    return per_supplier.groupBy(*PRODUCT).agg(
        F.try_divide(F.sum("in_sum"), F.sum("in_n")).alias("current_mean"),
        F.try_divide(F.sum("out_sum"), F.sum("out_n")).alias("other_mean"),
        F.count_if(F.col("in_n") > 0).alias("current_suppliers"),
        F.count_if((F.col("in_n") == 0) & (F.col("out_n") > 0)).alias("other_suppliers"))


def other_suppliers(contracts: DataFrame, project: str) -> DataFrame:
    """The suppliers behind :func:`current_and_other_prices` that the project does not use, one row each."""
    inside = F.col("project_name") == project
    sides = contracts.groupBy(*OFFER).agg(F.count_if(inside).alias("n"))
    return sides.where(F.col("n") == 0).drop("n")

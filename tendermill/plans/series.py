"""Weekly features of the contract flow and diagnostics of the series.

Rows are first folded to one row per week. From there on the data is bounded by the
calendar (52 rows a year), so windows over the whole series are small by nature.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendermill.functions import values
from tendermill.operators import grouping
from tendermill.operators.quantiles import exact_quantiles
from tendermill.session import stored

LAGGED = ["total_amount", "contract_count", "avg_contract_size", "unique_counterparties", "amount_ma3", "max_concentration",
          "week_sin", "week_cos"]
AMOUNT = "total_contract_amount_eur"


def weekly_base(contracts: DataFrame, *keys: str) -> DataFrame:
    """Sums, means, distinct counts and spread per week with contracts; empty weeks have no row.

    The contracts' own columns are written once and read by each aggregate; an aggregate with two distinct counts would
    shuffle every contract twice, with all its sums.
    """
    group = [*keys, "contract_week"]
    weekly = stored(contracts.select(*keys, values.week_start("contract_signing_date").alias("contract_week"), AMOUNT, "unit_price_eur",
                                     "contract_number", "counterparty_name"))
    out = weekly.groupBy(*group).agg(
        F.sum(AMOUNT).alias("total_amount"), F.avg("unit_price_eur").alias("avg_unit_price"),
        F.max(AMOUNT).alias("max_contract"), F.min(AMOUNT).alias("min_contract"),
        F.stddev_samp(AMOUNT).alias("std_contract"))
    for name, count in (("contract_number", "contract_count"), ("counterparty_name", "unique_counterparties")):
        out = grouping.null_safe_join(out, weekly.groupBy(*group).agg(F.countDistinct(name).alias(count)), group)
    medians = exact_quantiles(weekly, group, AMOUNT, {"median_contract": 0.5}, reread=True)
    return grouping.null_safe_join(out, medians, group)


#: Lags of a weekly series and its last share kept for testing; callers with short series pass smaller ones.
LAGS, TEST_SHARE = 4, 0.3


def with_shape(weekly: DataFrame, *keys: str) -> DataFrame:
    """Season, structure and activity columns of the weekly series."""
    order = Window.partitionBy(*keys).orderBy("contract_week")
    week = F.weekofyear("contract_week")
    total, before = F.col("total_amount"), F.lag("total_amount").over(order)
    change = total - before
    q75 = weekly.groupBy(*keys).agg(F.percentile("max_contract", F.lit(0.75)).alias("_large"))
    joined = grouping.null_safe_join(weekly, q75, keys) if keys else weekly.withColumn("_large", q75.scalar())
    out = joined.withColumns({
        "week": week,
        "week_sin": F.sin(2 * math.pi * week / 52),
        "week_cos": F.cos(2 * math.pi * week / 52),
        "month": F.month("contract_week"),
        "quarter": F.quarter("contract_week"),
        "week_number": F.row_number().over(order) - 1,
        "avg_contract_size": F.try_divide(total, F.col("contract_count")),
        "max_concentration": F.try_divide(F.col("max_contract"), F.when(total == 0, 1.0).otherwise(total)),
        "has_large_contract": (F.col("max_contract") > F.col("_large")).cast("int"),
        "amount_ma3": F.avg(total).over(order.rowsBetween(-2, 0)),
        "amount_ma4": F.avg(total).over(order.rowsBetween(-3, 0)),
        "amount_change": change,
        "amount_pct_change": F.coalesce(F.try_divide(change, before), F.lit(0.0)),
        "amount_volatility": F.stddev_samp(total).over(order.rowsBetween(-3, 0)),
        "is_growing": F.coalesce((change > 0).cast("int"), F.lit(0)),
        "amount_per_counterparty": F.try_divide(total, F.col("unique_counterparties")),
        "counterparties_change": F.col("unique_counterparties") - F.lag("unique_counterparties").over(order),
    })
    return out.withColumns({
        "contract_cv": F.try_divide(F.col("std_contract"), F.col("avg_contract_size")),
        "amount_acceleration": F.col("amount_change") - F.lag("amount_change").over(order),
    }).drop("_large")


def top_discipline_counts(contracts: DataFrame, k: int = 5) -> DataFrame:
    """Distinct contracts per week of the k most frequent disciplines, columns by rank; 0 where absent."""
    weekly = contracts.withColumn("contract_week", values.week_start("contract_signing_date"))
    leaders = grouping.value_counts(contracts, "discipline").limit(k)
    ranked = leaders.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "discipline")))
    counts = weekly.groupBy("contract_week", "discipline").agg(F.countDistinct("contract_number").alias("n_contracts"))
    placed = counts.join(ranked.select("discipline", "place"), "discipline")
    pivot = grouping.pivoted(placed, ["contract_week"], "place", range(1, k + 1), F.sum("n_contracts"), fill=0,
                             prefix="top")
    weeks = weekly.select("contract_week").distinct()
    return weeks.join(pivot, "contract_week", "left").fillna(0)


def with_lags(features: DataFrame, columns, lags: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("contract_week")
    return features.withColumns(
        {f"{c}_lag_{i}": F.lag(c, i).over(order) for c in columns for i in range(1, lags + 1)})


def with_target(features: DataFrame, use_log: bool, *keys: str) -> DataFrame:
    """Next week's smoothed amount, on a log scale if asked for."""
    order = Window.partitionBy(*keys).orderBy("contract_week")
    target = F.lead("amount_ma3").over(order)
    return features.withColumn("target", F.log1p(F.greatest(target, F.when(target.isNotNull(), 1.0))) if use_log else target)


def weekly_features(contracts: DataFrame, *keys: str, lags: int = LAGS, use_log: bool = True) -> DataFrame:
    """The full feature table."""
    return features_of_weeks(weekly_base(contracts, *keys), *keys, lags=lags, use_log=use_log)


def features_of_weeks(weekly: DataFrame, *keys: str, lags: int = LAGS, use_log: bool = True) -> DataFrame:
    """The full feature table of weeks that :func:`weekly_base` has folded."""
    return with_target(with_lags(with_shape(weekly, *keys), LAGGED, lags, *keys), use_log, *keys)


def chronological_split(features: DataFrame, share: float, order: str = "contract_week") -> DataFrame:
    """Mark the last ``share`` of the rows as test rows, by time and never at random."""
    total = features.agg(F.count("*")).scalar()
    place = F.row_number().over(Window.orderBy(order))
    return features.withColumn("is_test", place > total - F.ceil(total * share))


def diagnosis(weekly: DataFrame) -> DataFrame:
    """One row: size, level, spread and what the size allows."""
    total = F.col("total_amount")
    stats = weekly.agg(
        F.count("*").alias("weeks"), F.avg(total).alias("mean"), F.median(total).alias("median"),
        F.stddev_samp(total).alias("std"), F.min(total).alias("least"), F.max(total).alias("most"))
    n = F.col("weeks")
    verdict = (F.when(n < 20, "too few for a regression").when(n < 40, "simple model").when(n < 80, "standard model")
               .otherwise("full model"))
    return stats.withColumn("cv", F.try_divide("std", "mean")).withColumns(
        {"is_volatile": F.col("cv") > 1.0, "below_30": n < 30, "verdict": verdict})


def autocorrelation(series: DataFrame, value: str, order: str, lags: int = 4) -> DataFrame:
    """Correlation of the series with its own past, one row per lag, with a word for its strength."""
    w = Window.orderBy(order)
    shifted = series.select(F.col(value).alias("x"), *(F.lag(value, i).over(w).alias(f"x{i}") for i in range(1, lags + 1)))
    row = shifted.agg(*(F.corr("x", f"x{i}").alias(f"r{i}") for i in range(1, lags + 1)))
    long = row.select(F.explode(F.array(*(F.struct(F.lit(i).alias("lag"), F.col(f"r{i}").alias("correlation"))
                                          for i in range(1, lags + 1)))).alias("e")).select("e.*")
    size = F.abs("correlation")
    return long.withColumn("strength", F.when(size < 0.3, "weak").when(size < 0.7, "medium").otherwise("strong"))


def acf(series: DataFrame, value: str, order: str, lags: int = 20) -> DataFrame:
    """Autocorrelation function: lagged products about the series mean over the sum of squares."""
    mean = series.agg(F.avg(value)).scalar()
    w = Window.orderBy(order)
    centred = series.select(order, (F.col(value) - mean).alias("x"))
    shifted = centred.select("x", *(F.lag("x", i).over(w).alias(f"x{i}") for i in range(1, lags + 1)))
    square = F.sum(F.col("x") * F.col("x"))
    row = shifted.agg(*((F.sum(F.col("x") * F.col(f"x{i}")) / square).alias(f"r{i}") for i in range(1, lags + 1)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(i).alias("lag"), F.col(f"r{i}").alias("acf"))
                                          for i in range(1, lags + 1)))).alias("e")).select("e.*")


def moving_mean(series: DataFrame, value: str, order: str, width: int = 3) -> DataFrame:
    """Mean of the last ``width`` points, null until there are that many."""
    w = Window.orderBy(order)
    full: Column = F.row_number().over(w) >= width
    return series.withColumn("moving_mean", F.when(full, F.avg(value).over(w.rowsBetween(1 - width, 0))))

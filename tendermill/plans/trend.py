"""Trends, smoothing and forecasts of monthly series, for all groups in one job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendermill.functions import values
from tendermill.operators import cleaning, grouping, outliers
from tendermill.plans import reconciliation


def series_fence(series: DataFrame, value: str, width: float = 1.5) -> DataFrame:
    """Mark points of a calendar series outside the quartile fence.

    One row per month: plain exact percentiles hold the whole series easily.
    """
    q = grouping.with_whole_stats(series, "_q", q1=F.percentile(value, F.lit(0.25)), q3=F.percentile(value, F.lit(0.75)))
    low, high = F.col("_q.q1"), F.col("_q.q3")
    step = (high - low) * width
    outside = (F.col(value) < low - step) | (F.col(value) > high + step)
    return q.withColumn("is_outlier", outside).drop("_q")


def cleaned_months(series: DataFrame, value: str = "total") -> DataFrame:
    """The series without its outlier months."""
    months = series_fence(series, value).where("is_outlier").select("month")
    return series.join(months, "month", "left_anti")


def outlier_months(series: DataFrame, value: str = "total", least: float = 2.0) -> DataFrame:
    return outliers.z_scored(series, value, least)


def linear_trend(series: DataFrame, value: str = "total", order: str = "month") -> DataFrame:
    """Slope, intercept and R2 over the place in the series."""
    placed = series.withColumn("x", (F.row_number().over(Window.orderBy(order)) - 1).cast("double"))
    return placed.agg(
        F.regr_slope(value, "x").alias("slope"), F.regr_intercept(value, "x").alias("intercept"),
        F.regr_r2(value, "x").alias("r2"), F.count("*").alias("points"))


def filled_months(df: DataFrame, keys: Iterable[str], date_column: str, value: str) -> DataFrame:
    """Monthly totals per group from its first to its last month, empty months 0.

    The months come from each group's own bounds, so no cross join is needed.
    """
    keys = list(keys)
    totals = df.groupBy(*keys, values.month_start(date_column).alias("month")).agg(F.sum(value).alias("total"))
    spine = totals.groupBy(*keys).agg(F.min("month").alias("a"), F.max("month").alias("b")).select(
        *keys, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return spine.join(totals, [*keys, "month"], "left").fillna(0.0, subset=["total"])


def _per_group(keys: list[str]) -> Window:
    """A group of a monthly series is bounded by the calendar, so its window is small.

    All windows of this module share the partitioning by ``keys``: one shuffle serves them.
    """
    return Window.partitionBy(*keys)


def _placed(series: DataFrame, keys: list[str]) -> DataFrame:
    months = F.months_between(F.col("month"), F.min("month").over(_per_group(keys)))
    return series.withColumn("x", F.round(months).cast("double"))


def group_trends(df: DataFrame, keys: Iterable[str], date_column: str, value: str) -> DataFrame:
    """Linear trend of the zero-filled monthly totals of every group with at least two months."""
    keys = list(keys)
    placed = _placed(filled_months(df, keys, date_column, value), keys)
    fits = placed.groupBy(*keys).agg(
        F.count("*").alias("months"), F.regr_slope("total", "x").alias("slope"),
        F.regr_intercept("total", "x").alias("intercept"), F.regr_r2("total", "x").alias("r2"))
    return fits.where(F.col("months") >= 2)


def prepared_for_trend(contracts: DataFrame, lots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contracts with their lot's project, ready for trends, and the contracts without a lot.

    Kept rows are distinct, complete, positive and in EUR, with month columns.
    """
    joined = reconciliation.with_lot_projects(contracts, lots)
    orphans = reconciliation.without_lot(contracts, lots)
    kept = joined.where(F.col("project_name").isNotNull()).distinct()
    kept = cleaning.complete(kept, ["contract_signing_date"], positive=["total_contract_amount", "unit_price", "quantity"])
    eur = cleaning.in_eur(kept, [("total_contract_amount", "contract_currency", "total_contract_amount_eur"),
                                 ("unit_price", "contract_currency", "unit_price_eur")])
    return eur.withColumns({
        "year": F.year("contract_signing_date"), "month": F.month("contract_signing_date"),
        "year_month": values.month_start("contract_signing_date")}), orphans


def smoothed(series: DataFrame, keys: Iterable[str], peak: float = 2.0) -> DataFrame:
    """Months above ``peak`` medians come down to the median; the excess fills the empty months evenly.

    Trailing empty months are cut first. The sum of each series stays the same: a series
    without an empty month keeps its peaks, because their excess would have no place.
    """
    keys = list(keys)
    group = _per_group(keys)
    alive = F.col("total") != 0
    trimmed = series.withColumn("_last", F.max(F.when(alive, F.col("month"))).over(group)).where("month <= _last")
    stats = trimmed.withColumns({"_target": F.median(F.when(alive, F.col("total"))).over(group),
                                 "_empty": F.count_if(~alive).over(group)})
    is_peak = (F.col("total") > peak * F.col("_target")) & (F.col("_empty") > 0)
    excess = F.when(is_peak, F.col("total") - F.col("_target")).otherwise(0.0)
    pooled = stats.withColumn("_pool", F.sum(excess).over(group))
    value = (F.when(is_peak, F.col("_target"))
             .when(F.col("total") == 0, F.col("_pool") / F.col("_empty")).otherwise(F.col("total")))
    return pooled.select(*keys, "month", "total", value.alias("smooth"))


def log_series(series: DataFrame, keys: Iterable[str], value: str = "smooth", most: float = 3.0) -> DataFrame:
    """Log of the series; points more than ``most`` population deviations off take the median of the rest."""
    keys = list(keys)
    group = _per_group(keys)
    logged = series.withColumn("y", F.log(F.when(F.col(value) == 0, 1.0).otherwise(F.col(value))))
    stats = logged.withColumns({"_mean": F.avg("y").over(group), "_std": F.stddev_pop("y").over(group)})
    off = F.coalesce(F.abs(F.try_divide(F.col("y") - F.col("_mean"), F.col("_std"))) > most, F.lit(False))
    marked = stats.withColumn("_off", off)
    medians = marked.withColumn("_median", F.median(F.when(~F.col("_off"), F.col("y"))).over(group))
    return medians.withColumn("y", F.when(F.col("_off"), F.col("_median")).otherwise(F.col("y"))).drop(
        "_mean", "_std", "_off", "_median")


def forecast(series: DataFrame, keys: Iterable[str], horizon: int = 12, band: float = 1.96) -> DataFrame:
    """Next ``horizon`` months of every group: log-linear trend plus month-of-year effect, with a 95 % band."""
    keys = list(keys)
    group = _per_group(keys)
    placed = _placed(series, keys).withColumns({
        "a": F.regr_intercept("y", "x").over(group), "b": F.regr_slope("y", "x").over(group), "moy": F.month("month")})
    residuals = placed.withColumn("residual", F.col("y") - F.col("a") - F.col("b") * F.col("x"))
    seasonal = residuals.withColumn("effect", F.avg("residual").over(Window.partitionBy(*keys, "moy")))
    fits = seasonal.groupBy(*keys).agg(
        F.max("a").alias("a"), F.max("b").alias("b"), F.max("x").alias("last_x"), F.max("month").alias("last_month"),
        F.stddev_samp(F.col("residual") - F.col("effect")).alias("sigma"),
        # at most twelve entries: one effect per month of the year
        F.map_from_entries(F.collect_set(F.struct("moy", "effect"))).alias("effects"))
    ahead = fits.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")).withColumn(
        "month", F.add_months("last_month", F.col("step")))
    effect = F.coalesce(F.col("effects")[F.month("month")], F.lit(0.0))
    level = F.col("a") + F.col("b") * (F.col("last_x") + F.col("step")) + effect
    return ahead.select(*keys, "month", F.exp(level).alias("forecast"),
                        F.exp(level - band * F.col("sigma")).alias("low"), F.exp(level + band * F.col("sigma")).alias("high"))

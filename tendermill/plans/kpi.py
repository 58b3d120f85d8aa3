"""Performance of the people who run the lots."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendermill.functions import values
from tendermill.operators import cleaning, grouping

# Weights of the score and the statuses that count as success.
WEIGHTS = {"lots": 0.5, "value": 0.3, "time": 0.2}
MONTHLY_WEIGHTS = {"lots": 0.4, "value": 0.2, "time": 0.2, "success": 0.2}
SUCCESSFUL = ["Завершен", "Исполнен"]
LOT_EUR = [("total_price", "currency", "total_price_eur")]


def _z_scores(df: DataFrame, columns: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Sample z-scores over the whole result; null (no spread, no value) counts as 0."""
    stats = {}
    for c, _ in columns.values():
        stats[f"{c}_mean"], stats[f"{c}_std"] = F.avg(c), F.stddev_samp(c)
    whole = grouping.with_whole_stats(df, "_whole", **stats)

    def z(c: str, sign: int) -> Column:
        score = F.try_divide(F.col(c) - F.col(f"_whole.{c}_mean"), F.col(f"_whole.{c}_std")) * sign
        return F.coalesce(score, F.lit(0.0))

    return whole.withColumns({name: z(c, sign) for name, (c, sign) in columns.items()}).drop("_whole")


def kpi_scores(lots: DataFrame, by_project: bool = True, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Lots, value and speed per person, scored against all persons and scaled to 0-1.

    A lot in a currency without a rate stays counted, without a value.
    """
    weights = WEIGHTS if weights is None else weights
    keys = (["project_name"] if by_project else []) + ["discipline", "actor_name"]
    valued = cleaning.in_eur(lots, LOT_EUR, unknown="null")
    days = values.days_between("open_date", "close_date")
    kpi = valued.groupBy(*keys).agg(
        F.count("lot_number").alias("total_lots"),
        F.coalesce(F.sum("total_price_eur"), F.lit(0.0)).alias("sum_lot_value"),
        F.avg("total_price_eur").alias("avg_lot_value"),
        F.avg(days).alias("avg_time_to_close"),
        F.min("close_date").alias("close_date"))
    kpi = _z_scores(kpi, {"normalized_lots": ("total_lots", 1), "normalized_value": ("sum_lot_value", 1),
                          "normalized_time": ("avg_time_to_close", -1)})
    score = (weights.get("lots", 0) * F.col("normalized_lots") + weights.get("value", 0) * F.col("normalized_value")
             + weights.get("time", 0) * F.col("normalized_time"))
    kpi = kpi.withColumn("kpi_score", score)
    ends = grouping.with_whole_stats(kpi, "_ends", low=F.min("kpi_score"), high=F.max("kpi_score"))
    scaled = F.try_divide(F.col("kpi_score") - F.col("_ends.low"), F.col("_ends.high") - F.col("_ends.low"))
    return ends.withColumn("kpi_score_normalized", F.coalesce(scaled, F.lit(0.0))).drop("_ends")


def monthly_kpi(lots: DataFrame, successful: Iterable[str] = SUCCESSFUL, by_project: bool = True,
                weights: Mapping[str, float] | None = None) -> DataFrame:
    """The score per month with the share of successful lots."""
    weights = MONTHLY_WEIGHTS if weights is None else weights
    keys = (["project_name"] if by_project else []) + ["discipline", "actor_name"]
    valued = cleaning.in_eur(lots, LOT_EUR, unknown="null")
    kpi = valued.groupBy(F.date_format("close_date", "yyyy-MM").alias("month"), *keys).agg(
        F.count("lot_number").alias("total_lots"),
        F.avg("total_price_eur").alias("avg_lot_value"),
        F.avg(values.days_between("open_date", "close_date")).alias("avg_time_to_close"),
        F.avg(F.col("lot_status").isin(list(successful)).cast("double")).alias("lot_success_rate"))
    kpi = _z_scores(kpi, {"normalized_lots": ("total_lots", 1), "normalized_value": ("avg_lot_value", 1),
                          "normalized_time": ("avg_time_to_close", -1),
                          "normalized_success": ("lot_success_rate", 1)})
    parts = [weights.get(w, 0) * F.col(f"normalized_{w}") for w in ("lots", "value", "time", "success")]
    return kpi.fillna(0.0, subset=["avg_lot_value", "avg_time_to_close"]).withColumn("kpi_score", sum(parts, F.lit(0.0)))


def actor_workload(lots: DataFrame) -> DataFrame:
    """Lots and mean processing days per discipline and person."""
    return lots.groupBy("discipline", "actor_name").agg(
        F.count("lot_number").alias("lots"),
        F.avg(values.days_between("open_date", "close_date")).alias("mean_days"))


def raw_kpi(lots: DataFrame, rates: Mapping[str, float]) -> DataFrame:
    """Older unscaled score; an unknown currency counts one to one."""
    valued = cleaning.in_eur(lots, [("total_price", "currency", "value")], unknown="one", rates=rates)
    per_actor = valued.groupBy("discipline", "actor_name").agg(
        F.count("lot_number").alias("lots"), F.avg("value").alias("avg_value"), F.sum("value").alias("sum_value"),
        F.avg(values.days_between("open_date", "close_date")).alias("mean_days"))
    score = 0.5 * F.col("lots") + 0.1 * F.col("avg_value") + 0.1 * F.col("sum_value") - 0.3 * F.col("mean_days")
    return per_actor.withColumn("kpi", score)


def best_in_discipline(kpi: DataFrame) -> DataFrame:
    """Row with the highest score of each discipline."""
    keys = [c for c in ("project_name", "actor_name") if c in kpi.columns]
    return grouping.top_in_group(kpi, ["discipline"], 1, F.desc("kpi_score"), *keys).drop("rank")


def kpi_by_discipline(kpi: DataFrame, disciplines: Iterable[str], value: str = "kpi_score_normalized") -> DataFrame:
    return grouping.pivoted(kpi, ["actor_name"], "discipline", disciplines, F.avg(value), fill=None)

"""Performance and concentration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendermill.catalog.registry import query, rate_sql, usd_rate_sql, with_views
from tendermill.catalog.spend import DISCIPLINES, contracts_eur
from tendermill.functions import money
from tendermill.functions.text import before_bracket
from tendermill.operators import grouping
from tendermill.plans import concentration, kpi
from tendermill.sources import views

_COLUMNS = ["lot_number", "discipline", "project_name", "actor_name", "open_date", "close_date", "total_price", "currency"]


def named_lots(spark, d, *more):
    return views.lots(spark, d, *_COLUMNS, *more).withColumn("actor_name", before_bracket("actor_name"))


_PEOPLE = f"""t AS (SELECT *, trim(split_part(actor_name, '(', 1)) AS person, total_price * {rate_sql('currency')} AS eur,
              date_diff('day', open_date, close_date) AS days FROM lots)"""

_KPI = f"""
    WITH {_PEOPLE},
    k AS (SELECT project_name, discipline, person AS actor_name, count(lot_number) AS total_lots,
                 coalesce(sum(eur), 0.0) AS sum_lot_value, avg(days) AS avg_time_to_close, min(close_date) AS close_date
          FROM t GROUP BY ALL),
    z AS (SELECT *, coalesce((total_lots - avg(total_lots) OVER ()) / stddev_samp(total_lots) OVER (), 0) AS normalized_lots,
                 coalesce((sum_lot_value - avg(sum_lot_value) OVER ()) / stddev_samp(sum_lot_value) OVER (), 0) AS normalized_value,
                 coalesce(-(avg_time_to_close - avg(avg_time_to_close) OVER ()) / stddev_samp(avg_time_to_close) OVER (), 0)
                 AS normalized_time FROM k),
    s AS (SELECT *, 0.5 * normalized_lots + 0.3 * normalized_value + 0.2 * normalized_time AS kpi_score FROM z),
    n AS (SELECT *, (kpi_score - min(kpi_score) OVER ()) / (max(kpi_score) OVER () - min(kpi_score) OVER ())
                 AS kpi_score_normalized FROM s)"""


@query("kpi_scores", "A19 A20", with_views("lots", _KPI + " SELECT * FROM n"),
       doubles="sum_lot_value:2 avg_time_to_close:6 normalized_lots:6 normalized_value:6 normalized_time:6 kpi_score:6 "
               "kpi_score_normalized:6", dates="close_date")
def kpi_scores(spark, d):
    return kpi.kpi_scores(named_lots(spark, d)).drop("avg_lot_value")


@query("monthly_kpi", "A21", with_views("lots", f"""
    WITH {_PEOPLE},
    k AS (SELECT strftime(close_date, '%Y-%m') AS month, discipline, person AS actor_name, count(lot_number) AS total_lots,
                 avg(eur) AS v, avg(days) AS avg_time_to_close,
                 avg(CASE WHEN lot_status = 'F' THEN 1.0 ELSE 0.0 END) AS lot_success_rate FROM t GROUP BY ALL),
    z AS (SELECT *, coalesce((total_lots - avg(total_lots) OVER ()) / stddev_samp(total_lots) OVER (), 0) AS a,
                 coalesce((v - avg(v) OVER ()) / stddev_samp(v) OVER (), 0) AS b,
                 coalesce(-(avg_time_to_close - avg(avg_time_to_close) OVER ()) / stddev_samp(avg_time_to_close) OVER (), 0) AS c,
                 coalesce((lot_success_rate - avg(lot_success_rate) OVER ()) / stddev_samp(lot_success_rate) OVER (), 0) AS e
          FROM k)
    SELECT month, discipline, actor_name, total_lots, coalesce(v, 0.0) AS avg_lot_value, avg_time_to_close, lot_success_rate,
           0.4 * a + 0.2 * b + 0.2 * c + 0.2 * e AS kpi_score FROM z"""),
    doubles="avg_lot_value:3 avg_time_to_close:6 lot_success_rate:6 kpi_score:6")
def monthly_kpi(spark, d):
    return kpi.monthly_kpi(named_lots(spark, d, "lot_status"), ["F"], by_project=False).drop(
        "normalized_lots", "normalized_value", "normalized_time", "normalized_success")


@query("actor_workload", "A22", with_views("lots", f"""
    WITH {_PEOPLE} SELECT discipline, person AS actor_name, count(lot_number) AS lots, avg(days) AS mean_days
    FROM t GROUP BY ALL"""), doubles="mean_days:6")
def actor_workload(spark, d):
    return kpi.actor_workload(named_lots(spark, d))


@query("raw_kpi", "A23 P17", with_views("lots", f"""
    WITH {_PEOPLE}, u AS (SELECT *, total_price * coalesce({usd_rate_sql('currency')}, 1.0) AS v FROM t)
    SELECT discipline, person AS actor_name, count(*) AS lots, avg(v) AS avg_value, sum(v) AS sum_value, avg(days) AS mean_days,
           0.5 * count(*) + 0.1 * avg(v) + 0.1 * sum(v) - 0.3 * avg(days) AS kpi FROM u GROUP BY ALL"""),
    doubles="avg_value:3 sum_value:2 mean_days:6 kpi:2")
def raw_kpi(spark, d):
    return kpi.raw_kpi(named_lots(spark, d), money.USD_RATES)


@query("best_actor_of_discipline", "W10", with_views("lots", _KPI + """
    SELECT discipline, project_name, actor_name, kpi_score FROM (SELECT *, row_number() OVER (
        PARTITION BY discipline ORDER BY kpi_score DESC, project_name, actor_name) AS rn FROM n) r WHERE rn = 1"""),
    doubles="kpi_score:6")
def best_actor_of_discipline(spark, d):
    return kpi.best_in_discipline(kpi.kpi_scores(named_lots(spark, d))).select(
        "discipline", "project_name", "actor_name", "kpi_score")


@query("kpi_by_discipline", "A64", with_views("lots", _KPI + " SELECT actor_name, " + ", ".join(
    f"avg(CASE WHEN discipline = '{x}' THEN kpi_score_normalized END) AS \"{x}\"" for x in DISCIPLINES)
    + " FROM n GROUP BY actor_name"), doubles=" ".join(f"{x}:6" for x in DISCIPLINES))
def kpi_by_discipline(spark, d):
    return kpi.kpi_by_discipline(kpi.kpi_scores(named_lots(spark, d)), DISCIPLINES)


@query("hhi_by_discipline", "A24 A25", with_views("contracts_eur", """
    WITH s AS (SELECT discipline, counterparty_name, sum(total_contract_amount_eur) AS amount FROM contracts_eur GROUP BY 1, 2),
         p AS (SELECT discipline, amount, amount / sum(amount) OVER (PARTITION BY discipline) * 100 AS share FROM s)
    SELECT discipline, sum(share * share) AS hhi_index, count(*) AS suppliers, sum(amount) AS total_eur,
           CASE WHEN sum(share * share) < 176.0 THEN 'Конкурентный рынок'
                WHEN sum(share * share) < 177.0 THEN 'Умеренная концентрация' ELSE 'Высокая концентрация' END AS band
    FROM p GROUP BY discipline"""), doubles="hhi_index:6 total_eur:1")
def hhi_by_discipline(spark, d):
    index = concentration.hhi(contracts_eur(spark, d, "discipline", "counterparty_name"))
    return concentration.hhi_bands(index, [(176.0, "Конкурентный рынок"), (177.0, "Умеренная концентрация")])


@query("supplier_shares", "A24 W11", with_views("contracts_eur", """
    SELECT discipline, counterparty_name, amount, amount / sum(amount) OVER (PARTITION BY discipline) * 100 AS supp_share
    FROM (SELECT discipline, counterparty_name, sum(total_contract_amount_eur) AS amount FROM contracts_eur GROUP BY 1, 2) s"""),
    doubles="amount:2 supp_share:6")
def supplier_shares(spark, d):
    return concentration.supplier_shares(contracts_eur(spark, d, "discipline", "counterparty_name"))


@query("major_suppliers_and_others", "A25", with_views("contracts_eur", """
    WITH s AS (SELECT discipline, counterparty_name, sum(total_contract_amount_eur) AS amount FROM contracts_eur GROUP BY 1, 2),
         p AS (SELECT discipline, counterparty_name, amount / sum(amount) OVER (PARTITION BY discipline) * 100 AS share FROM s)
    SELECT discipline, CASE WHEN share >= 2.0 THEN counterparty_name ELSE 'Другие' END AS label, sum(share) AS share
    FROM p GROUP BY 1, 2"""), doubles="share:6")
def major_suppliers_and_others(spark, d):
    shares = concentration.supplier_shares(contracts_eur(spark, d, "discipline", "counterparty_name"))
    return concentration.major_and_others(shares, 2.0)


@query("kpi_column_summary", "A65", with_views("lots", _KPI + """
    SELECT count(kpi_score) AS n, avg(kpi_score) AS mean, stddev_samp(kpi_score) AS std, min(kpi_score) AS least,
           quantile_cont(kpi_score, 0.25) AS q25, quantile_cont(kpi_score, 0.5) AS q50,
           quantile_cont(kpi_score, 0.75) AS q75, max(kpi_score) AS most FROM n"""),
    doubles="mean:6 std:6 least:6 q25:6 q50:6 q75:6 most:6")
def kpi_column_summary(spark, d):
    from tendermill.operators.describing import column_summary
    return column_summary(kpi.kpi_scores(named_lots(spark, d)), "kpi_score")

"""Supplier and people feature queries, outliers among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendermill.catalog.pricing import contracts_eur, lots_eur
from tendermill.catalog.registry import query, with_views
from tendermill.functions.text import before_bracket
from tendermill.operators import outliers, robust
from tendermill.operators.describing import column_summaries
from tendermill.operators.quantiles import percentile_rank
from tendermill.plans import suppliers
from tendermill.sources import views

_COLUMNS = ["counterparty_name", "contract_signing_date", "delivery_time_days", "quantity", "project_name", "product_name",
            "unit", "product_amount", "additional_expenses", "discipline"]


def supplier_contracts(spark, d):
    return contracts_eur(spark, d, *_COLUMNS)


_AGG = """
    g AS (SELECT counterparty_name, sum(total_contract_amount_eur) AS total_volume,
        avg(total_contract_amount_eur) AS avg_contract_value, stddev_samp(total_contract_amount_eur) AS amount_std,
        count(*) AS contracts_count, min(total_contract_amount_eur) AS min_contract_value,
        max(total_contract_amount_eur) AS max_contract_value, avg(unit_price_eur) AS avg_unit_price,
        stddev_samp(unit_price_eur) AS price_std, min(unit_price_eur) AS min_unit_price, max(unit_price_eur) AS max_unit_price,
        min(contract_signing_date) AS first_contract, max(contract_signing_date) AS last_contract,
        avg(delivery_time_days) AS avg_delivery_time, stddev_samp(delivery_time_days) AS delivery_std,
        CAST(min(delivery_time_days) AS DOUBLE) AS min_delivery_time, CAST(max(delivery_time_days) AS DOUBLE) AS max_delivery_time,
        sum(quantity) AS total_quantity, avg(quantity) AS avg_quantity, stddev_samp(quantity) AS quantity_std,
        min(quantity) AS min_quantity, max(quantity) AS max_quantity, sum(product_amount) AS product_sum,
        avg(product_amount) AS product_mean, stddev_samp(product_amount) AS product_std, sum(additional_expenses) AS expenses_sum,
        avg(additional_expenses) AS expenses_mean, count(DISTINCT project_name) AS projects_count,
        count(DISTINCT product_name) AS products_count, count(DISTINCT unit) AS units_count,
        count(DISTINCT discipline) AS disciplines_count, count(DISTINCT contract_currency) AS currencies_count
      FROM contracts_eur GROUP BY 1)"""
_AGG_DOUBLES = ("total_volume:1 avg_contract_value amount_std min_contract_value max_contract_value avg_unit_price price_std "
                "min_unit_price max_unit_price avg_delivery_time delivery_std min_delivery_time max_delivery_time "
                "total_quantity avg_quantity quantity_std min_quantity max_quantity product_sum:1 product_mean:3 product_std:3 "
                "expenses_sum:1 expenses_mean:3")
_DATES = "first_contract last_contract"


@query("supplier_aggregates", "A42", with_views("contracts_eur", f"WITH {_AGG} SELECT * FROM g"), doubles=_AGG_DOUBLES,
       dates=_DATES)
def supplier_aggregates(spark, d):
    return suppliers.supplier_aggregates(supplier_contracts(spark, d))


_SEASON = """
    mm AS (SELECT counterparty_name, month(contract_signing_date) AS moy, count(*) AS n FROM contracts_eur GROUP BY 1, 2),
    sp AS (SELECT s.counterparty_name, m.moy FROM (SELECT DISTINCT counterparty_name FROM mm) s,
                  (SELECT DISTINCT moy FROM mm) m),
    sv AS (SELECT sp.counterparty_name, var_samp(coalesce(n, 0)) AS seasonal_variance FROM sp LEFT JOIN mm
           ON mm.counterparty_name = sp.counterparty_name AND mm.moy = sp.moy GROUP BY 1)"""


@query("seasonal_variance", "A44", with_views("contracts_eur", f"WITH {_SEASON} SELECT * FROM sv"),
       doubles="seasonal_variance")
def seasonal_variance(spark, d):
    return suppliers.seasonal_variance(contracts_eur(spark, d, "counterparty_name", "contract_signing_date"))


_FEATURES = f"""{_AGG}, {_SEASON},
    h AS (SELECT g.*, greatest(date_diff('day', first_contract, last_contract) / 365.25, 0.1) AS years_active,
        coalesce(price_std / avg_unit_price, 0) AS price_volatility, coalesce(amount_std / total_volume, 0) AS contract_size_volatility,
        coalesce(quantity_std / avg_quantity, 0) AS quantity_volatility,
        coalesce(delivery_std / avg_delivery_time, 0) AS delivery_volatility,
        max_contract_value - min_contract_value AS contract_size_range, max_unit_price - min_unit_price AS price_range,
        pow(ln(1 + projects_count) * ln(1 + products_count) * ln(1 + units_count) * ln(1 + disciplines_count), 0.25)
        AS diversification_index, contracts_count / products_count AS specialization_ratio,
        1 / (avg_delivery_time + 1) AS delivery_efficiency, expenses_sum / total_volume AS additional_expenses_ratio,
        total_quantity / contracts_count AS avg_quantity_per_contract, total_volume / projects_count AS revenue_per_project,
        1.0 / projects_count AS single_client_dependency FROM g),
    f AS (SELECT h.*, contracts_count / (years_active + 1) AS avg_contracts_per_year,
        1 / (contract_size_volatility + 0.1) AS contract_consistency, 1 / (price_volatility + 0.1) AS price_stability_score,
        CAST(rank() OVER (ORDER BY total_volume) AS DOUBLE) / count(*) OVER () AS total_volume_rank,
        CAST(rank() OVER (ORDER BY total_volume) AS DOUBLE) / count(*) OVER () AS avg_contract_size_rank,
        seasonal_variance FROM h JOIN sv ON sv.counterparty_name = h.counterparty_name)"""
_DERIVED = ("years_active:6 price_volatility:6 contract_size_volatility:6 quantity_volatility:6 delivery_volatility:6 "
            "contract_size_range price_range diversification_index:6 specialization_ratio:6 delivery_efficiency:6 "
            "additional_expenses_ratio:6 avg_quantity_per_contract:6 revenue_per_project:2 single_client_dependency:6 "
            "avg_contracts_per_year:6 contract_consistency:5 price_stability_score:5 total_volume_rank:6 "
            "avg_contract_size_rank:6 seasonal_variance")


@query("supplier_features", "A43 W9 J12", with_views("contracts_eur", f"WITH {_FEATURES} SELECT * FROM f"),
       doubles=f"{_AGG_DOUBLES} {_DERIVED}", dates=_DATES)
def supplier_features(spark, d):
    return suppliers.supplier_features(supplier_contracts(spark, d))


@query("quantity_percentile_rank", "W9", with_views("contracts", """
    WITH q AS (SELECT DISTINCT counterparty_name, discipline, quantity FROM contracts),
         r AS (SELECT *, rank() OVER (ORDER BY quantity) AS r, count(*) OVER (PARTITION BY quantity) AS ties,
                      count(*) OVER () AS n FROM q)
    SELECT counterparty_name, discipline, quantity, (r + (ties - 1) / 2) / n AS percentile FROM r"""),
    doubles="quantity percentile:8")
def quantity_percentile_rank(spark, d):
    rows = views.contracts(spark, d, "counterparty_name", "discipline", "quantity").distinct()
    return percentile_rank(rows, "quantity", "percentile")


@query("simple_supplier_features", "A45", with_views("contracts_eur", """
    WITH t AS (SELECT counterparty_name, sum(total_contract_amount_eur) AS total_amount, count(*) AS contract_count,
                      avg(total_contract_amount_eur) AS avg_amount, coalesce(stddev_samp(total_contract_amount_eur), 0) AS amount_std,
                      median(total_contract_amount_eur) AS median_amount,
                      quantile_cont(total_contract_amount_eur, 0.75) - quantile_cont(total_contract_amount_eur, 0.25)
                      AS amount_percentile FROM contracts_eur GROUP BY 1)
    SELECT *, amount_std / avg_amount AS amount_cv, ln(1 + total_amount) AS log_total_amount,
           ln(1 + avg_amount) AS log_avg_amount, ln(1 + contract_count) AS log_contract_count FROM t"""),
    doubles="total_amount:1 avg_amount amount_std median_amount amount_percentile amount_cv:6 log_total_amount:6 "
            "log_avg_amount:6 log_contract_count:6")
def simple_supplier_features(spark, d):
    return suppliers.simple_supplier_features(contracts_eur(spark, d, "counterparty_name"), "counterparty_name",
                                              "total_contract_amount_eur")


def _people(spark, d, *more):
    return lots_eur(spark, d, "discipline", "actor_name", "winner_name", *more).withColumn(
        "actor_name", before_bracket("actor_name"))


@query("actor_supplier_spend", "A46", with_views("lots_eur", """
    SELECT discipline, trim(split_part(actor_name, '(', 1)) AS actor_name, winner_name, count(*) AS lot_count,
           sum(total_price_eur) AS total FROM lots_eur GROUP BY ALL"""), doubles="total:3")
def actor_supplier_spend(spark, d):
    return suppliers.actor_supplier_spend(_people(spark, d))


@query("actor_profiles", "A46", with_views("lots_eur", """
    SELECT trim(split_part(actor_name, '(', 1)) AS actor_name, sum(total_price_eur) AS total, count(*) AS lot_lines,
           count(DISTINCT lot_number) AS lots, count(DISTINCT winner_name) AS suppliers FROM lots_eur GROUP BY 1"""),
    doubles="total:1")
def actor_profiles(spark, d):
    return suppliers.actor_profiles(_people(spark, d, "lot_number"))


@query("actor_supplier_flags", "A47", with_views("lots_eur", """
    SELECT DISTINCT trim(split_part(actor_name, '(', 1)) AS actor_name, winner_name FROM lots_eur"""))
def actor_supplier_flags(spark, d):
    return suppliers.actor_supplier_flags(_people(spark, d))


@query("supplier_column_summaries", "A65", with_views("contracts_eur", f"""WITH {_AGG},
    l AS (SELECT 'avg_contract_value' AS feature, avg_contract_value AS v FROM g UNION ALL
          SELECT 'contracts_count', contracts_count FROM g UNION ALL SELECT 'price_std', price_std FROM g)
    SELECT feature, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS least, quantile_cont(v, 0.25) AS q25,
           quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75, max(v) AS most FROM l GROUP BY 1"""),
    doubles="mean std least q25 q50 q75 most")
def supplier_column_summaries(spark, d):
    return column_summaries(suppliers.supplier_aggregates(supplier_contracts(spark, d)),
                            ["avg_contract_value", "contracts_count", "price_std"])


@query("fenced_suppliers", "O3", with_views("contracts_eur", f"""WITH {_AGG},
    q AS (SELECT quantile_cont(total_volume, 0.25) AS a1, quantile_cont(total_volume, 0.75) AS a3,
                 quantile_cont(contracts_count, 0.25) AS b1, quantile_cont(contracts_count, 0.75) AS b3 FROM g)
    SELECT counterparty_name, total_volume, contracts_count,
           total_volume < a1 - 1.0 * (a3 - a1) OR total_volume > a3 + 1.0 * (a3 - a1)
           OR contracts_count < b1 - 1.0 * (b3 - b1) OR contracts_count > b3 + 1.0 * (b3 - b1) AS is_outlier FROM g, q"""),
    doubles="total_volume:1")
def fenced_suppliers(spark, d):
    features = suppliers.supplier_aggregates(supplier_contracts(spark, d))
    return outliers.fenced(features, ["total_volume", "contracts_count"], 1.0).select(
        "counterparty_name", "total_volume", "contracts_count", "is_outlier")


@query("super_suppliers", "O5", with_views("contracts_eur", """
    WITH v AS (SELECT counterparty_name, sum(total_contract_amount_eur) AS total_volume FROM contracts_eur GROUP BY 1)
    SELECT counterparty_name, total_volume, row_number() OVER (ORDER BY total_volume DESC, counterparty_name) AS position
    FROM v WHERE total_volume > (SELECT quantile_cont(total_volume, 0.9) FROM v)"""), doubles="total_volume:1")
def super_suppliers(spark, d):
    from tendermill.operators.grouping import exact_sum
    volumes = contracts_eur(spark, d, "counterparty_name").groupBy("counterparty_name").agg(
        exact_sum("total_contract_amount_eur").alias("total_volume"))
    return outliers.above_quantile(volumes, "total_volume", 0.9, "counterparty_name")


_DISTANCE = """
    m AS (SELECT avg(unit_price_eur) AS m0, avg(total_price_eur) AS m1, avg(supplier_qty) AS m2,
        covar_samp(unit_price_eur, unit_price_eur) AS c00, covar_samp(unit_price_eur, total_price_eur) AS c01,
        covar_samp(unit_price_eur, supplier_qty) AS c02, covar_samp(total_price_eur, total_price_eur) AS c11,
        covar_samp(total_price_eur, supplier_qty) AS c12, covar_samp(supplier_qty, supplier_qty) AS c22 FROM lots_eur),
    i AS (SELECT *, c00 * (c11 * c22 - c12 * c12) - c01 * (c01 * c22 - c12 * c02) + c02 * (c01 * c12 - c11 * c02) AS det FROM m),
    x AS (SELECT row_key, actor_name, winner_name, total_price_eur, unit_price_eur - m0 AS x0, total_price_eur - m1 AS x1,
                 supplier_qty - m2 AS x2, i.* FROM lots_eur, i),
    s AS (SELECT row_key, actor_name, winner_name, total_price_eur,
        (x0 * x0 * (c11 * c22 - c12 * c12) + x1 * x1 * (c00 * c22 - c02 * c02) + x2 * x2 * (c00 * c11 - c01 * c01)
         + 2 * x0 * x1 * (c02 * c12 - c01 * c22) + 2 * x0 * x2 * (c01 * c12 - c02 * c11)
         + 2 * x1 * x2 * (c01 * c02 - c00 * c12)) / det AS distance FROM x),
    a AS (SELECT * FROM s WHERE distance > (SELECT quantile_cont(distance, 0.95) FROM s))"""


def _anomalies(spark, d):
    lots = lots_eur(spark, d, "row_key", "actor_name", "winner_name", "supplier_qty")
    return outliers.mahalanobis(lots, ["unit_price_eur", "total_price_eur", "supplier_qty"])


@query("price_anomalies", "O6 O7", with_views("lots_eur", f"""WITH {_DISTANCE}
    SELECT row_key, winner_name, total_price_eur, distance FROM a"""), doubles="total_price_eur distance:5")
def price_anomalies(spark, d):
    return _anomalies(spark, d).where("is_anomaly").select("row_key", "winner_name", "total_price_eur", "distance").orderBy(
        F.desc("total_price_eur"), "row_key")


@query("anomalies_by_actor", "A37", with_views("lots_eur", f"""WITH {_DISTANCE}
    SELECT trim(split_part(actor_name, '(', 1)) AS actor_name, count(*) AS n FROM a GROUP BY 1
    ORDER BY n DESC, actor_name LIMIT 20"""))
def anomalies_by_actor(spark, d):
    from tendermill.plans.prices import anomaly_counts
    found = _anomalies(spark, d).where("is_anomaly").withColumn("actor_name", before_bracket("actor_name"))
    return anomaly_counts(found, "actor_name")


@query("robust_price_anomalies", "O6 O7", doubles="total_price_eur robust_distance:5")
def robust_price_anomalies(spark, d):
    lots = lots_eur(spark, d, "row_key", "actor_name", "winner_name", "supplier_qty")
    found = robust.trimmed_distance(lots, ["unit_price_eur", "total_price_eur", "supplier_qty"])
    return found.where("is_anomaly").select("row_key", "winner_name", "total_price_eur", "robust_distance").orderBy(
        F.desc("total_price_eur"), "row_key")

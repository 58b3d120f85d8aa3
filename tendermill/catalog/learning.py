"""Clustering and regression queries: checked by rows and properties, since no SQL states them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendermill.catalog.kpi import named_lots
from tendermill.catalog.pricing import contracts_eur, lots_eur
from tendermill.catalog.registry import query
from tendermill.catalog.suppliers import supplier_contracts
from tendermill.functions.text import before_bracket
from tendermill.operators import grouping
from tendermill.plans import clusters, density, group_regression, kpi, regression, series, suppliers
from tendermill.session import checkpointed
from tendermill.sources import views


def _features(spark, d):
    return suppliers.supplier_features(supplier_contracts(spark, d))


def _vectors(spark, d):
    table = checkpointed(_features(spark, d))
    columns = suppliers.clustering_columns(table)
    return checkpointed(clusters.scaled(table, columns)), columns


@query("supplier_clusters", "K1 O5")
def supplier_clusters(spark, d):
    return clusters.supplier_clusters(_features(spark, d), top_share=0.95).select(
        "counterparty_name", "total_volume", "contracts_count", "cluster", "is_giant")


@query("cluster_profile", "A57")
def cluster_profile(spark, d):
    return clusters.cluster_profile(clusters.supplier_clusters(_features(spark, d), 6, 0.95))


@query("scaler_choice", "K2")
def scaler_choice(spark, d):
    table = checkpointed(suppliers.simple_supplier_features(contracts_eur(spark, d, "counterparty_name"), "counterparty_name",
                                                            "total_contract_amount_eur"))
    rows = clusters.best_scaler(table, suppliers.clustering_columns(table))
    return spark.createDataFrame(rows, "scaler string, k int, silhouette double")


@query("principal_components", "K3")
def principal_components(spark, d):
    vectors, columns = _vectors(spark, d)
    projected, explained = clusters.principal_components(vectors, len(columns))
    from pyspark.ml.functions import vector_to_array
    return projected.select("counterparty_name", F.posexplode(vector_to_array("components")).alias("component", "value"))


@query("cluster_count_sweep", "K4")
def cluster_count_sweep(spark, d):
    vectors, _ = _vectors(spark, d)
    return clusters.sweep_table(spark, clusters.k_sweep(vectors, range(2, 9)))


@query("bisecting_supplier_clusters", "K5")
def bisecting_supplier_clusters(spark, d):
    sums = lots_eur(spark, d, "winner_name", "supplier_qty", "good_count").groupBy("winner_name").agg(
        *(F.sum(c).alias(c) for c in ("total_price_eur", "unit_price", "supplier_qty", "good_count")))
    return clusters.bisecting_clusters(checkpointed(sums), ["total_price_eur", "unit_price", "supplier_qty", "good_count"])


def _seeded(spark, d):
    scores = checkpointed(kpi.kpi_scores(named_lots(spark, d)))
    return clusters.seeded_clusters(scores, kpi.best_in_discipline(scores))


@query("seeded_actor_clusters", "K7 T8")
def seeded_actor_clusters(spark, d):
    return _seeded(spark, d).select("project_name", "discipline", "actor_name", "total_lots", "sum_lot_value", "cluster")


@query("efficiency_groups", "K8 J11")
def efficiency_groups(spark, d):
    return clusters.efficiency_groups(_seeded(spark, d))


@query("actors_per_efficiency_group", "A58")
def actors_per_efficiency_group(spark, d):
    found = checkpointed(_seeded(spark, d))
    return clusters.actors_per_group(found, clusters.efficiency_groups(found))


def _people(spark, d):
    return lots_eur(spark, d, "discipline", "actor_name", "winner_name").withColumn("actor_name", before_bracket("actor_name"))


@query("actor_clusters", "K9 A47")
def actor_clusters(spark, d):
    return clusters.actor_clusters(_people(spark, d))


@query("actor_cluster_stats", "K9")
def actor_cluster_stats(spark, d):
    return clusters.actor_cluster_stats(checkpointed(clusters.actor_clusters(_people(spark, d))))


def _deals(spark, d):
    from tendermill.functions.values import mass_quantity
    rows = views.contracts(spark, d, "row_key", "quantity", "unit", "unit_price", "total_contract_amount")
    quantity, unit = mass_quantity("quantity", "unit")
    return rows.withColumns({"quantity": quantity, "unit": unit})


@query("density_clusters", "K6 P24")
def density_clusters(spark, d):
    found = density.density_clusters(_deals(spark, d), "row_key", ["quantity", "unit_price", "total_contract_amount"])
    return density.cluster_means(found, ["quantity", "unit_price", "total_contract_amount"])


@query("k_distance_curve", "K6", doubles="distance:9")
def k_distance_curve(spark, d):
    return density.k_distance_curve(_deals(spark, d), "row_key", ["quantity", "unit_price", "total_contract_amount"])


@query("density_grid", "K6")
def density_grid(spark, d):
    return density.density_grid(_deals(spark, d), "row_key", ["quantity", "unit_price", "total_contract_amount"],
                                [0.1, 0.15], [5, 50])


def _prepared(spark, d):
    contracts = contracts_eur(spark, d, "contract_signing_date", "contract_number", "counterparty_name")
    weekly = checkpointed(series.weekly_base(contracts))
    return regression.prepared(series.features_of_weeks(weekly)), weekly


@query("feature_ranking", "K11 J11")
def feature_ranking(spark, d):
    data, _ = _prepared(spark, d)
    ranked = regression.feature_ranking(data.train, data.columns)
    return grouping.ranked_rows(ranked, F.desc("score"), "feature")


@query("model_comparison", "K12")
def model_comparison(spark, d):
    data, _ = _prepared(spark, d)
    rows, _ = regression.compared_models(data)
    return regression.comparison_table(data.train, rows)


@query("next_week_prediction", "K13")
def next_week_prediction(spark, d):
    contracts = contracts_eur(spark, d, "contract_signing_date", "contract_number", "counterparty_name", "project_name")
    return regression.next_week_by_project(contracts)


@query("next_week_by_project", "K13")
def next_week_by_project(spark, d):
    contracts = contracts_eur(spark, d, "contract_signing_date", "contract_number", "counterparty_name", "project_name")
    return group_regression.next_week_by_group(contracts)

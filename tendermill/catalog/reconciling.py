"""Lots against contracts, shared suppliers and graph tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tendermill.catalog.registry import query, with_views
from tendermill.catalog.spend import DISCIPLINES
from tendermill.functions.text import before_bracket
from tendermill.operators import cleaning, grouping
from tendermill.plans import reconciliation as rec
from tendermill.sources import views

_PAIRS = """
    l AS (SELECT lot_number, currency, winner_name, trim(split_part(actor_name, '(', 1)) AS actor_name, discipline,
                 sum(total_price) AS total_price_kp, sum(supplier_qty) AS supplier_qty_kp, avg(unit_price) AS unit_average_kp
          FROM lots GROUP BY ALL),
    c AS (SELECT lot_number, contract_currency, counterparty_name, executor_dak,
                 sum(total_contract_amount) AS total_contract_amount, sum(quantity) AS quantity_contract,
                 avg(unit_price) AS unit_average_contract FROM contracts GROUP BY ALL),
    p AS (SELECT l.*, executor_dak, total_contract_amount, quantity_contract, unit_average_contract
          FROM l JOIN c ON l.lot_number = c.lot_number AND l.currency = c.contract_currency
                       AND l.winner_name = c.counterparty_name)"""
_PAIR_DOUBLES = ("total_price_kp supplier_qty_kp unit_average_kp total_contract_amount quantity_contract "
                 "unit_average_contract")


def _pairs(spark, d):
    lots = views.lots(spark, d, "lot_number", "currency", "winner_name", "actor_name", "discipline", "total_price",
                      "supplier_qty", "unit_price").withColumn("actor_name", before_bracket("actor_name"))
    contracts = views.contracts(spark, d, "lot_number", "contract_currency", "counterparty_name", "executor_dak",
                                "contract_signing_date", "total_contract_amount", "quantity", "unit_price")
    # both sides by the columns they are joined on, so that neither grouping nor join deals them again
    return rec.reconciled(views.spread(spark, d, lots, "lot_number", "currency", "winner_name"),
                          views.spread(spark, d, contracts, "lot_number", "contract_currency", "counterparty_name"))


@query("lots_with_contracts", "J1", with_views("lots contracts", f"WITH {_PAIRS} SELECT * FROM p"), doubles=_PAIR_DOUBLES)
def lots_with_contracts(spark, d):
    return _pairs(spark, d)


@query("price_discrepancies", "A27", with_views("lots contracts", f"""WITH {_PAIRS}
    SELECT *, (unit_average_contract - unit_average_kp) / unit_average_kp * 100 AS discr_percent,
           'Нетипично для честной закупки. Проверить' AS status FROM p
    WHERE abs(total_price_kp - total_contract_amount) > 0.01
      AND (unit_average_contract - unit_average_kp) / unit_average_kp * 100 >= 3.5"""), doubles=_PAIR_DOUBLES + " discr_percent")
def price_discrepancies(spark, d):
    return rec.discrepancies(_pairs(spark, d), growth=3.5)


@query("contracts_with_lot_project", "J2 P10", with_views("lots contracts", """
    WITH f AS (SELECT lot_number, min(project_name) AS project_name FROM lots GROUP BY lot_number)
    SELECT c.row_key, c.lot_number, f.project_name FROM contracts c LEFT JOIN f ON c.lot_number = f.lot_number"""))
def contracts_with_lot_project(spark, d):
    return rec.with_lot_project(views.contracts(spark, d, "row_key", "lot_number"),
                                views.lots(spark, d, "lot_number", "project_name"))


@query("contracts_with_lot_projects", "J3", with_views("lots contracts", """
    SELECT c.row_key, c.lot_number, f.project_name FROM contracts c
    LEFT JOIN (SELECT DISTINCT lot_number, project_name FROM lots) f ON c.lot_number = f.lot_number"""))
def contracts_with_lot_projects(spark, d):
    return rec.with_lot_projects(views.contracts(spark, d, "row_key", "lot_number"),
                                 views.lots(spark, d, "lot_number", "project_name"))


@query("contracts_without_lots", "J4", with_views("lots contracts", """
    SELECT row_key, lot_number, counterparty_name FROM contracts
    WHERE NOT EXISTS (SELECT 1 FROM lots WHERE lots.lot_number = contracts.lot_number)"""))
def contracts_without_lots(spark, d):
    return rec.without_lot(views.contracts(spark, d, "row_key", "lot_number", "counterparty_name"),
                           views.lots(spark, d, "lot_number"))


@query("contracts_of_chosen_lots", "J5", with_views("lots contracts", """
    SELECT row_key, lot_number, contract_signing_date FROM contracts
    WHERE contract_signing_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'
      AND lot_number IN (SELECT lot_number FROM lots WHERE discipline = 'PROMO')"""), dates="contract_signing_date")
def contracts_of_chosen_lots(spark, d):
    chosen = views.lots(spark, d, "lot_number", "discipline").where(F.col("discipline") == "PROMO")
    return rec.contracts_of_lots(views.contracts(spark, d, "row_key", "lot_number", "contract_signing_date"), chosen,
                                 date(1997, 1, 1), date(1999, 12, 31))


@query("contracts_without_lots_summary", "A28", with_views("lots contracts", """
    SELECT lot_number, counterparty_name, contract_currency, min(product_name) AS first_product,
           sum(total_contract_amount) AS amount, count(*) AS lines FROM contracts
    WHERE NOT EXISTS (SELECT 1 FROM lots WHERE lots.lot_number = contracts.lot_number) GROUP BY 1, 2, 3"""), doubles="amount")
def contracts_without_lots_summary(spark, d):
    c = views.contracts(spark, d, "lot_number", "counterparty_name", "contract_currency", "product_name",
                        "total_contract_amount")
    return rec.without_lot_summary(c, views.lots(spark, d, "lot_number"))


@query("executors_with_early_contracts", "A29 T5", with_views("contracts", """
    SELECT executor_dak, count(*) AS contracts FROM contracts WHERE contract_signing_date < lot_end_date GROUP BY 1"""))
def executors_with_early_contracts(spark, d):
    return rec.executors_with_early_contracts(
        views.contracts(spark, d, "executor_dak", "contract_signing_date", "lot_end_date"))


@query("lot_status", "A30", with_views("lots contracts", """
    WITH l AS (SELECT lot_number, good_count AS q, unit_price AS u, total_price AS v,
                      row_number() OVER (PARTITION BY lot_number ORDER BY good_count, unit_price) AS rn FROM lots),
         c AS (SELECT lot_number, quantity AS q, unit_price AS u, total_contract_amount AS v,
                      row_number() OVER (PARTITION BY lot_number ORDER BY quantity, unit_price) AS rn FROM contracts),
         a AS (SELECT lot_number, count(*) AS lot_rows, sum(v) AS lot_sum FROM l GROUP BY 1),
         b AS (SELECT lot_number, count(*) AS contract_rows, sum(v) AS contract_sum FROM c GROUP BY 1),
         m AS (SELECT l.lot_number, count(*) AS diff FROM l JOIN c ON l.lot_number = c.lot_number AND l.rn = c.rn
               WHERE l.q <> c.q OR l.u <> c.u GROUP BY 1)
    SELECT a.lot_number, lot_rows, contract_rows, lot_sum, contract_sum,
           CASE WHEN abs(lot_sum - contract_sum) <= 0.01 THEN 'sums equal'
                WHEN lot_rows = contract_rows AND coalesce(diff, 0) = 0 THEN 'rows equal'
                WHEN lot_rows = contract_rows THEN 'rows differ' WHEN lot_rows < contract_rows THEN 'rows grew'
                ELSE 'rows fell' END AS status
    FROM a JOIN b ON a.lot_number = b.lot_number LEFT JOIN m ON a.lot_number = m.lot_number"""),
    doubles="lot_sum:3 contract_sum:3")
def lot_status(spark, d):
    out = rec.lot_status(views.lots(spark, d, "lot_number", "good_count", "unit_price", "total_price"),
                         views.contracts(spark, d, "lot_number", "quantity", "unit_price", "total_contract_amount"))
    return out


@query("lot_lines_lined_up", "J14", with_views("lots contracts", """
    WITH l AS (SELECT lot_number, row_key AS lot_row,
                      row_number() OVER (PARTITION BY lot_number ORDER BY good_count, row_key) AS rn FROM lots),
         c AS (SELECT lot_number, row_key AS contract_row,
                      row_number() OVER (PARTITION BY lot_number ORDER BY quantity, row_key) AS rn FROM contracts)
    SELECT l.lot_number, l.rn, lot_row, contract_row FROM l JOIN c ON l.lot_number = c.lot_number AND l.rn = c.rn"""))
def lot_lines_lined_up(spark, d):
    lots = views.lots(spark, d, "lot_number", "good_count", "row_key").withColumnsRenamed(
        {"good_count": "quantity"}).withColumn("lot_row", F.col("row_key"))
    contracts = views.contracts(spark, d, "lot_number", "quantity", "row_key").withColumn("contract_row", F.col("row_key"))
    return rec.lined_up(lots, contracts, "quantity", "row_key").select("lot_number", "rn", "lot_row", "contract_row")


@query("shared_suppliers", "J8", with_views("lots", """
    WITH p AS (SELECT DISTINCT discipline, winner_name FROM lots)
    SELECT a.discipline AS discipline1, b.discipline AS discipline2, a.winner_name
    FROM p a JOIN p b ON a.winner_name = b.winner_name AND a.discipline < b.discipline"""))
def shared_suppliers(spark, d):
    return rec.shared_suppliers(views.lots(spark, d, "discipline", "winner_name"))


@query("shared_supplier_counts", "J8", with_views("lots", """
    WITH p AS (SELECT DISTINCT discipline, winner_name FROM lots)
    SELECT a.discipline AS discipline1, b.discipline AS discipline2, count(*) AS suppliers
    FROM p a JOIN p b ON a.winner_name = b.winner_name AND a.discipline < b.discipline GROUP BY 1, 2"""))
def shared_supplier_counts(spark, d):
    return rec.shared_supplier_counts(rec.shared_suppliers(views.lots(spark, d, "discipline", "winner_name")))


_GAPS = """
    g AS (SELECT discipline, winner_name, good_name, avg(unit_price_eur) AS price, count(DISTINCT lot_number) AS lots
          FROM lots_eur GROUP BY 1, 2, 3),
    x AS (SELECT a.winner_name, a.good_name, a.discipline AS discipline1, b.discipline AS discipline2, a.price AS price1,
                 b.price AS price2, a.lots AS lots1, b.lots AS lots2,
                 (a.price - b.price) * 100 / (a.price + b.price) AS percent_of_diff
          FROM g a JOIN g b ON a.winner_name = b.winner_name AND a.good_name = b.good_name AND a.discipline < b.discipline
          WHERE abs((a.price - b.price) * 100 / (a.price + b.price)) > 10)"""


def _priced_lots(spark, d):
    lots = views.lots(spark, d, "discipline", "winner_name", "good_name", "lot_number", "unit_price", "currency")
    return cleaning.in_eur(lots, [("unit_price", "currency", "unit_price_eur")])


@query("cross_discipline_prices", "A32 J9", with_views("lots_eur", f"WITH {_GAPS} SELECT * FROM x"),
       doubles="price1 price2 percent_of_diff")
def cross_discipline_prices(spark, d):
    return rec.cross_discipline_prices(_priced_lots(spark, d))


@query("cross_discipline_lots", "A32", with_views("lots_eur", f"""WITH {_GAPS}
    SELECT DISTINCT discipline, winner_name, good_name, lot_number FROM lots_eur l WHERE EXISTS (
        SELECT 1 FROM x WHERE x.winner_name = l.winner_name AND x.good_name = l.good_name
                          AND l.discipline IN (x.discipline1, x.discipline2))"""))
def cross_discipline_lots(spark, d):
    lots = _priced_lots(spark, d)
    return rec.cross_discipline_lots(lots, rec.cross_discipline_prices(lots))


@query("cross_discipline_statistics", "A33", with_views("lots_eur", f"""WITH {_GAPS}
    SELECT count(*) AS matches, count(DISTINCT winner_name) AS suppliers, avg(percent_of_diff) AS mean_gap FROM x"""),
    doubles="mean_gap:6")
def cross_discipline_statistics(spark, d):
    return rec.gap_statistics(rec.cross_discipline_prices(_priced_lots(spark, d)))


@query("cross_discipline_leaders", "A33 T2", with_views("lots_eur", f"""WITH {_GAPS}
    SELECT winner_name, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, winner_name LIMIT 10"""))
def cross_discipline_leaders(spark, d):
    return grouping.value_counts(rec.cross_discipline_prices(_priced_lots(spark, d)), "winner_name").limit(10)


@query("cross_discipline_matrix", "A33", with_views("lots_eur", f"""WITH {_GAPS},
    s AS (SELECT discipline1 AS discipline, discipline2 AS other FROM x UNION ALL SELECT discipline2, discipline1 FROM x)
    SELECT discipline, """ + ", ".join(f"count(CASE WHEN other = '{x}' THEN 1 END) AS \"{x}\"" for x in DISCIPLINES)
    + " FROM s GROUP BY discipline"))
def cross_discipline_matrix(spark, d):
    return rec.gap_matrix(rec.cross_discipline_prices(_priced_lots(spark, d)), DISCIPLINES)


@query("graph_edges", "G1", with_views("lots", """
    SELECT DISTINCT currency, project_name AS source, discipline AS target, 'project-discipline' AS kind FROM lots UNION ALL
    SELECT DISTINCT currency, discipline, winner_name, 'discipline-supplier' FROM lots"""))
def graph_edges(spark, d):
    return rec.edges(views.lots(spark, d, "currency", "project_name", "discipline", "winner_name"), "currency")


@query("graph_vertices", "G1", with_views("lots", """
    SELECT DISTINCT project_name AS name, 'project' AS kind FROM lots UNION ALL
    SELECT DISTINCT discipline, 'discipline' FROM lots UNION ALL SELECT DISTINCT winner_name, 'supplier' FROM lots"""))
def graph_vertices(spark, d):
    return rec.vertices(views.lots(spark, d, "project_name", "discipline", "winner_name"))


_COMMON = """
    v AS (SELECT project_name, winner_name, max(cv) AS cv FROM (
            SELECT project_name, winner_name, currency,
                   coalesce(stddev_samp(total_price), 0) / avg(total_price) AS cv FROM lots GROUP BY 1, 2, 3) q GROUP BY 1, 2),
    k AS (SELECT project_name, winner_name, count(DISTINCT discipline) AS disciplines,
                 string_agg(DISTINCT discipline, ', ' ORDER BY discipline) AS names FROM lots GROUP BY 1, 2
          HAVING count(DISTINCT discipline) > 1)"""


@query("common_suppliers_of_projects", "A31 X10", with_views("lots", f"""WITH {_COMMON}
    SELECT k.project_name, k.winner_name, disciplines, names, cv FROM k JOIN v
    ON k.project_name = v.project_name AND k.winner_name = v.winner_name"""), doubles="cv:6")
def common_suppliers_of_projects(spark, d):
    return rec.common_suppliers(views.lots(spark, d, "project_name", "winner_name", "discipline", "currency", "total_price"))


@query("common_supplier_graph", "G2", with_views("lots", f"""WITH {_COMMON}
    SELECT DISTINCT l.project_name, l.winner_name, l.discipline, least(cv, 0.5) AS weight FROM lots l
    JOIN k ON k.project_name = l.project_name AND k.winner_name = l.winner_name
    JOIN v ON v.project_name = l.project_name AND v.winner_name = l.winner_name"""), doubles="weight:6")
def common_supplier_graph(spark, d):
    return rec.common_supplier_graph(
        views.lots(spark, d, "project_name", "winner_name", "discipline", "currency", "total_price"))

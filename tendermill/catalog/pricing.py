"""Price, competition, risk, stock and alternative-supplier queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tendermill.catalog.registry import query, with_views
from tendermill.functions import text
from tendermill.operators import cleaning, outliers
from tendermill.plans import alternatives as alt
from tendermill.plans import concentration, prices
from tendermill.session import stored
from tendermill.sources import views

NOW = date(2002, 6, 30)
PROJECT = "BUILDING"


def lots_eur(spark, d, *columns):
    lots = views.lots(spark, d, *columns, "unit_price", "total_price", "currency")
    return cleaning.in_eur(lots, [("unit_price", "currency", "unit_price_eur"), ("total_price", "currency", "total_price_eur")])


def contracts_eur(spark, d, *columns):
    needed = dict.fromkeys([*columns, "unit_price", "total_contract_amount", "contract_currency"])
    return cleaning.in_eur(views.contracts(spark, d, *needed), [
        ("unit_price", "contract_currency", "unit_price_eur"),
        ("total_contract_amount", "contract_currency", "total_contract_amount_eur")])


@query("supplier_prices", "A34", with_views("lots_eur", """
    SELECT good_name, winner_name, avg(unit_price_eur) AS mean_price, min(unit_price_eur) AS min_price,
           max(unit_price_eur) AS max_price, stddev_samp(unit_price_eur) AS std_price, count(DISTINCT lot_number) AS lots,
           sum(supplier_qty) AS quantity, max(close_date) AS last_date, median(unit_price_eur) AS median_price
    FROM lots_eur GROUP BY 1, 2"""),
    doubles="mean_price min_price max_price std_price quantity median_price", dates="last_date")
def supplier_prices(spark, d):
    return prices.supplier_prices(lots_eur(spark, d, "good_name", "winner_name", "lot_number", "supplier_qty", "close_date"))


@query("supplier_price_lots", "A34", with_views("lots", "SELECT DISTINCT good_name, winner_name, lot_number FROM lots"))
def supplier_price_lots(spark, d):
    return prices.supplier_price_lots(views.lots(spark, d, "good_name", "winner_name", "lot_number"))


@query("goods_stats", "A35", with_views("lots", """
    SELECT concat(good_name, ' ', row_key) AS good_name, count(DISTINCT winner_name) AS suppliers,
           count(DISTINCT lot_number) AS lots, count(DISTINCT winner_name) = 1 AS single_supplier FROM
    (SELECT good_name, CASE WHEN lot_status = 'F' THEN winner_name ELSE '' END AS row_key, winner_name, lot_number FROM lots) t
    GROUP BY 1"""))
def goods_stats(spark, d):
    lots = views.lots(spark, d, "good_name", "winner_name", "lot_number", "lot_status")
    own = F.when(F.col("lot_status") == "F", F.col("winner_name")).otherwise("")
    return prices.goods_stats(lots.withColumn("good_name", F.concat("good_name", F.lit(" "), own)))


@query("discipline_price_stats", "A36", with_views("lots_eur", """
    WITH l AS (SELECT discipline, 'unit_price_eur' AS measure, unit_price_eur AS v FROM lots_eur UNION ALL
               SELECT discipline, 'total_price_eur', total_price_eur FROM lots_eur UNION ALL
               SELECT discipline, 'supplier_qty', supplier_qty FROM lots_eur)
    SELECT discipline, measure, median(v) AS median, avg(v) AS mean, stddev_samp(v) AS std FROM l GROUP BY 1, 2"""),
    doubles="median mean std")
def discipline_price_stats(spark, d):
    return prices.discipline_price_stats(lots_eur(spark, d, "discipline", "supplier_qty"))


_BOUNDS = """
    b AS (SELECT discipline, avg(unit_price_eur) AS m, stddev_samp(unit_price_eur) AS s, avg(total_price_eur) AS tm,
                 stddev_samp(total_price_eur) AS ts FROM lots_eur GROUP BY 1),
    o AS (SELECT l.* FROM lots_eur l JOIN b ON l.discipline = b.discipline
          WHERE unit_price_eur < m - 3 * s OR unit_price_eur > m + 3 * s
             OR total_price_eur < tm - 3 * ts OR total_price_eur > tm + 3 * ts)"""


@query("sigma_outliers", "O4 J6", with_views("lots_eur", f"""WITH {_BOUNDS}
    SELECT row_key, discipline, winner_name, unit_price_eur, total_price_eur FROM o"""),
    doubles="unit_price_eur total_price_eur")
def sigma_outliers(spark, d):
    lots = lots_eur(spark, d, "row_key", "discipline", "winner_name")
    return outliers.sigma_bounds(lots, ["discipline"], ["unit_price_eur", "total_price_eur"]).select(
        "row_key", "discipline", "winner_name", "unit_price_eur", "total_price_eur")


@query("outliers_by_supplier", "A37 T2", with_views("lots_eur", f"""WITH {_BOUNDS}
    SELECT winner_name, count(*) AS n FROM o GROUP BY 1 ORDER BY n DESC, winner_name LIMIT 20"""))
def outliers_by_supplier(spark, d):
    lots = lots_eur(spark, d, "discipline", "winner_name")
    return prices.anomaly_counts(outliers.sigma_bounds(lots, ["discipline"], ["unit_price_eur", "total_price_eur"]),
                                 "winner_name")


@query("price_spread", "A49", with_views("contracts_eur", """
    WITH m AS (SELECT metal_product, counterparty_name, avg(unit_price_eur) AS mean FROM contracts_eur GROUP BY 1, 2),
         s AS (SELECT metal_product AS product_type, count(*) AS suppliers, min(mean) AS lowest, max(mean) AS highest
               FROM m GROUP BY 1 HAVING count(*) >= 2)
    SELECT *, (highest - lowest) / lowest * 100 AS gap_percent, (highest - lowest) / lowest * 100 > 30 AS flagged FROM s"""),
    doubles="lowest highest gap_percent")
def price_spread(spark, d):
    c = contracts_eur(spark, d, "metal_product", "counterparty_name").withColumnRenamed("metal_product", "product_type")
    return prices.price_spread(c)


_COMPETITION = """k AS (SELECT lot_number, count(DISTINCT counterparty_name) AS suppliers,
    sum(total_contract_amount_eur) AS amount FROM contracts_eur GROUP BY 1)"""


@query("competition_distribution", "A50", with_views("contracts_eur", f"""WITH {_COMPETITION}
    SELECT suppliers, count(*) AS lots, sum(amount) AS amount, count(*) * 100.0 / (SELECT count(*) FROM k) AS percent
    FROM k GROUP BY 1"""), doubles="amount:1 percent:6")
def competition_distribution(spark, d):
    return prices.competition_distribution(prices.lot_competition(contracts_eur(spark, d, "lot_number", "counterparty_name")))


@query("single_supplier_lots", "A50 T2", with_views("contracts_eur", f"""WITH {_COMPETITION}
    SELECT lot_number, suppliers, amount FROM k WHERE suppliers = 1 ORDER BY amount DESC, lot_number LIMIT 5"""),
    doubles="amount:3")
def single_supplier_lots(spark, d):
    return prices.single_supplier_lots(prices.lot_competition(contracts_eur(spark, d, "lot_number", "counterparty_name")), 5)


@query("supplier_wins", "A51", with_views("contracts_eur", """
    SELECT counterparty_name, count(DISTINCT lot_number) AS lots, sum(total_contract_amount_eur) AS amount,
           string_agg(DISTINCT discipline, ', ' ORDER BY discipline) AS disciplines FROM contracts_eur GROUP BY 1"""),
    doubles="amount:1")
def supplier_wins(spark, d):
    return prices.supplier_wins(contracts_eur(spark, d, "counterparty_name", "lot_number", "discipline"))


@query("dominant_suppliers", "A51", with_views("contracts_eur", """
    SELECT * FROM (SELECT discipline, counterparty_name, amount, amount / sum(amount) OVER (PARTITION BY discipline) * 100 AS share
    FROM (SELECT discipline, counterparty_name, sum(total_contract_amount_eur) AS amount FROM contracts_eur GROUP BY 1, 2) s) q
    WHERE share > 3"""), doubles="amount:2 share:6")
def dominant_suppliers(spark, d):
    return prices.dominance(contracts_eur(spark, d, "discipline", "counterparty_name"), 3.0)


@query("signing_speed", "A52", with_views("contracts", """
    WITH t AS (SELECT date_diff('day', lot_end_date, contract_signing_date) AS days FROM contracts)
    SELECT count(*) AS contracts, avg(days) AS mean, median(days) AS median, min(days) AS least, max(days) AS most,
           count(CASE WHEN days = 0 THEN 1 END) AS same_day FROM t WHERE days >= 0"""), doubles="mean:6 median")
def signing_speed(spark, d):
    return prices.signing_speed(views.contracts(spark, d, "lot_end_date", "contract_signing_date"))


@query("monthly_activity", "A52", with_views("contracts_eur", """
    SELECT CAST(date_trunc('month', contract_signing_date) AS DATE) AS month, count(*) AS contracts,
           sum(total_contract_amount_eur) AS amount FROM contracts_eur GROUP BY 1"""), doubles="amount:1", dates="month")
def monthly_activity(spark, d):
    return prices.monthly_activity(contracts_eur(spark, d, "contract_signing_date"))


@query("value_by_payment_terms", "A53", with_views("contracts_eur", """
    SELECT payment_conditions, sum(total_contract_amount_eur) AS amount FROM contracts_eur GROUP BY 1
    ORDER BY amount DESC, payment_conditions LIMIT 5"""), doubles="amount:1")
def value_by_payment_terms(spark, d):
    return prices.value_by_terms(contracts_eur(spark, d, "payment_conditions"))


@query("delivery_by_discipline", "A53", with_views("contracts", """
    SELECT discipline, avg(delivery_time_days) AS mean_days FROM contracts GROUP BY 1"""), doubles="mean_days:6")
def delivery_by_discipline(spark, d):
    c = views.contracts(spark, d, "discipline", "delivery_time_days")
    return prices.delivery_by_discipline(c.withColumn("delivery_time_days", F.col("delivery_time_days").cast("string")))


@query("price_by_type", "A53 P27", with_views("contracts_eur", """
    SELECT split_part(metal_product, ' ', 1) AS product_type, avg(unit_price_eur) AS mean_price FROM contracts_eur GROUP BY 1
    ORDER BY mean_price DESC, product_type LIMIT 8"""), doubles="mean_price")
def price_by_type(spark, d):
    c = contracts_eur(spark, d, "metal_product").withColumn("product_type", text.product_type("metal_product"))
    return prices.price_by_type(c)


@query("risk_score", "A54", with_views("contracts_eur", f"""WITH {_COMPETITION},
    s AS (SELECT sum(total_contract_amount_eur) AS v FROM contracts_eur GROUP BY counterparty_name ORDER BY v DESC LIMIT 3),
    f AS (SELECT (SELECT avg(CASE WHEN suppliers = 1 THEN 1.0 ELSE 0.0 END) FROM k) AS single_share,
                 (SELECT sum(v) FROM s) / sum(total_contract_amount_eur) AS top3_share,
                 avg(CASE WHEN contains(payment_conditions, 'URGENT') THEN 1.0 ELSE 0.0 END) AS prepaid_share,
                 count(CASE WHEN abs((quantity * unit_price - product_amount) / product_amount) > 0.01 THEN 1 END) AS errors,
                 count(CASE WHEN lot_end_date = contract_signing_date THEN 1 END) * 1.0
                 / count(CASE WHEN contract_signing_date >= lot_end_date THEN 1 END) AS same_day_share,
                 (SELECT avg(suppliers) FROM k) AS mean_suppliers,
                 quantile_cont(total_contract_amount_eur, 0.75) AS priority_value FROM contracts_eur),
    p AS (SELECT *, CAST(CASE WHEN single_share > 0.3 THEN 3 WHEN single_share > 0.1 THEN 1 ELSE 0 END
                 + CASE WHEN top3_share > 0.6 THEN 3 WHEN top3_share > 0.4 THEN 1 ELSE 0 END
                 + CASE WHEN prepaid_share > 0.5 THEN 2 ELSE 0 END + CASE WHEN errors > 0 THEN 2 ELSE 0 END
                 + CASE WHEN same_day_share > 0.3 THEN 1 ELSE 0 END AS BIGINT) AS score FROM f)
    SELECT *, CASE WHEN score = 0 THEN 'none' WHEN score <= 3 THEN 'low' WHEN score <= 6 THEN 'medium' ELSE 'high' END AS level
    FROM p"""), doubles="single_share:6 top3_share:6 prepaid_share:6 same_day_share:6 mean_suppliers:6 priority_value")
def risk_score(spark, d):
    c = contracts_eur(spark, d, "lot_number", "counterparty_name", "payment_conditions", "quantity", "product_amount",
                      "lot_end_date", "contract_signing_date")
    return prices.risk_score(c, prepaid="URGENT")


@query("over_price", "A56", with_views("contracts_eur", """
    WITH o AS (SELECT product_name, counterparty_name, avg(unit_price_eur) AS price FROM contracts_eur GROUP BY 1, 2),
         m AS (SELECT *, min(price) OVER (PARTITION BY product_name) AS lowest FROM o),
         p AS (SELECT *, (price - lowest) / lowest * 100 AS over_percent FROM m)
    SELECT *, CASE WHEN over_percent = 0 THEN 'best' WHEN over_percent > 50 THEN '>50' WHEN over_percent > 30 THEN '>30'
           ELSE '' END AS marker FROM p"""), doubles="price lowest over_percent:3")
def over_price(spark, d):
    offers = contracts_eur(spark, d, "product_name", "counterparty_name").groupBy("product_name", "counterparty_name").agg(
        (F.sum(F.col("unit_price_eur").cast("decimal(28,12)")).cast("double") / F.count("*")).alias("price"))
    return prices.over_price(offers, "product_name", "price")


@query("warehouse_counts", "A38", with_views("stock", """
    SELECT count(DISTINCT warehouse) AS warehouses,
           count(DISTINCT CASE WHEN date_column = (SELECT max(date_column) FROM stock) THEN nomenclature END) AS items,
           max(date_column) AS latest FROM stock"""), dates="latest")
def warehouse_counts(spark, d):
    return prices.warehouse_counts(views.stock(spark, d))


@query("latest_stock_value", "A38", with_views("stock", """
    SELECT warehouse, currency, sum(total_price_currency) AS value FROM stock
    WHERE date_column = (SELECT max(date_column) FROM stock) GROUP BY 1, 2"""), doubles="value:3")
def latest_stock_value(spark, d):
    return prices.latest_stock_value(views.stock(spark, d))


# ---------------------------------------------------------------- alternatives

_CONTRACT_COLUMNS = ["discipline", "product_name", "counterparty_name", "contract_signing_date", "project_name"]
_PROFILES = """
    f AS (SELECT discipline, product_name, counterparty_name, count(*) AS contracts_count,
                 sum(total_contract_amount_eur) AS total_value, avg(unit_price_eur) AS avg_price,
                 stddev_samp(unit_price_eur) AS price_std, min(contract_signing_date) AS first_contract,
                 max(contract_signing_date) AS last_contract,
                 greatest(date_diff('day', min(contract_signing_date), max(contract_signing_date)) / 365.25, 1.0)
                 AS years_experience, count(DISTINCT project_name) AS projects_count FROM contracts_eur GROUP BY 1, 2, 3)"""
_PRICE_PART = """CASE WHEN cur > 0 AND avg_price > 0 THEN CASE WHEN cur > avg_price
        THEN least((cur - avg_price) / cur * 100, 20.0) ELSE greatest((cur - avg_price) / cur * 50, -10.0) END ELSE 0.0 END"""
_SCORE = f"""least(greatest(50.0 + least(years_experience * 5, 25.0) + least(contracts_count * 2, 15) + {_PRICE_PART}
        + CASE WHEN price_std > 0 THEN greatest(10 - price_std / avg_price * 100, 0.0) ELSE 0.0 END
        + least(projects_count * 2, 10), 0.0), 100.0)"""
_ADVICE = f"""CASE WHEN contracts_count >= 5 AND years_experience >= 2 AND cur > 0 AND avg_price < cur THEN '{alt.RECOMMENDED}'
        WHEN contracts_count >= 5 AND years_experience >= 2 THEN '{alt.SUITABLE}'
        WHEN contracts_count >= 2 THEN '{alt.CAREFUL}' ELSE '{alt.NOT_RECOMMENDED}' END"""
_RISKS = """concat_ws('; ', CASE WHEN years_experience < 1 THEN 'Недостаточный опыт работы' END,
        CASE WHEN contracts_count < 3 THEN 'Малое количество контрактов' END,
        CASE WHEN price_std / avg_price > 0.3 THEN 'Нестабильные цены' END,
        CASE WHEN date_diff('day', last_contract, DATE '2002-06-30') > 365 THEN 'Длительный перерыв в работе' END)"""
_CURRENT = f"""
    u AS (SELECT DISTINCT discipline, product_name, counterparty_name FROM contracts_eur WHERE project_name = '{PROJECT}'),
    c AS (SELECT discipline, product_name, avg(unit_price_eur) AS cur FROM contracts_eur
          WHERE project_name = '{PROJECT}' GROUP BY 1, 2)"""
_FOUND = f"""{_PROFILES}, {_CURRENT},
    a AS (SELECT f.*, cur, {_SCORE} AS recommendation_score, {_RISKS} AS risks, {_ADVICE} AS recommendation
          FROM f JOIN c ON f.discipline = c.discipline AND f.product_name = c.product_name
          WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.discipline = f.discipline AND u.product_name = f.product_name
                            AND u.counterparty_name = f.counterparty_name))"""


def _frames(spark, d):
    contracts = contracts_eur(spark, d, *_CONTRACT_COLUMNS)
    return contracts, alt.supplier_profiles(contracts), contracts.where(F.col("project_name") == PROJECT)


@query("supplier_profiles", "A59", with_views("contracts_eur", f"WITH {_PROFILES} SELECT * FROM f"),
       doubles="total_value:2 avg_price price_std years_experience:6", dates="first_contract last_contract")
def supplier_profiles(spark, d):
    return _frames(spark, d)[1]


@query("alternative_suppliers", "A60 T10", with_views("contracts_eur", f"""WITH {_FOUND}
    SELECT discipline, product_name, counterparty_name, contracts_count, avg_price, cur AS current_avg_price,
           recommendation_score, (avg_price - cur) / cur * 100 AS price_vs_current, risks, recommendation FROM a"""),
    doubles="avg_price current_avg_price recommendation_score price_vs_current")
def alternative_suppliers(spark, d):
    _, profiles, current = _frames(spark, d)
    found = alt.alternatives(profiles, current, NOW)
    return found.select("discipline", "product_name", "counterparty_name", "contracts_count", "avg_price",
                        "current_avg_price", "recommendation_score", "price_vs_current",
                        F.array_join("risks", "; ").alias("risks"), "recommendation")


@query("best_alternatives", "A60 T3", with_views("contracts_eur", f"""WITH {_FOUND}
    SELECT discipline, product_name, counterparty_name, recommendation_score, rank FROM (SELECT *, row_number() OVER (
        PARTITION BY discipline, product_name ORDER BY recommendation_score DESC, counterparty_name) AS rank FROM a) r
    WHERE rank <= 3"""), doubles="recommendation_score")
def best_alternatives(spark, d):
    _, profiles, current = _frames(spark, d)
    return alt.best_alternatives(alt.alternatives(profiles, current, NOW)).select(
        "discipline", "product_name", "counterparty_name", "recommendation_score", "rank")


@query("alternatives_to_target", "A60", with_views("contracts_eur", f"""WITH {_PROFILES}, {_CURRENT}
    SELECT f.discipline, f.product_name, counterparty_name, {_SCORE} AS recommendation_score,
           concat_ws('; ', CASE WHEN projects_count > 1 THEN concat('Работа на разных проектах (', projects_count, ' проектов)') END,
                     CASE WHEN price_std / avg_price < 0.15 THEN 'Стабильные цены' END) AS advantages
    FROM f JOIN c ON f.discipline = c.discipline AND f.product_name = c.product_name
    WHERE counterparty_name <> 'Supplier#000000001'"""), doubles="recommendation_score")
def alternatives_to_target(spark, d):
    _, profiles, current = _frames(spark, d)
    found = alt.alternatives(profiles, current, NOW, target="Supplier#000000001")
    kept = F.filter("advantages", lambda x: x.startswith("Работа") | x.startswith("Стабильные"))
    return found.select("discipline", "product_name", "counterparty_name", "recommendation_score",
                        F.array_join(kept, "; ").alias("advantages"))


@query("market_position", "A61", with_views("contracts_eur", f"""WITH {_PROFILES}, {_CURRENT},
    m AS (SELECT f.discipline, f.product_name, count(*) AS total_suppliers, count(u.counterparty_name) AS current_suppliers,
                 sum(CASE WHEN u.counterparty_name IS NOT NULL THEN contracts_count ELSE 0 END) * 1.0 / sum(contracts_count)
                 AS market_coverage
          FROM f JOIN c ON f.discipline = c.discipline AND f.product_name = c.product_name
          LEFT JOIN u ON u.discipline = f.discipline AND u.product_name = f.product_name
                     AND u.counterparty_name = f.counterparty_name GROUP BY 1, 2),
    n AS (SELECT *, total_suppliers - current_suppliers AS alternative_suppliers FROM m)
    SELECT *, alternative_suppliers * 1.0 / total_suppliers AS diversification,
           CASE WHEN alternative_suppliers > current_suppliers THEN 'Высокая' WHEN alternative_suppliers > 0 THEN 'Средняя'
                ELSE 'Низкая' END AS competitiveness,
           CASE WHEN alternative_suppliers = 0 THEN 'Критический риск: альтернативы не найдены. Требуется расширение поиска поставщиков.'
                WHEN alternative_suppliers <= 2 THEN concat('Ограниченный выбор: ', alternative_suppliers,
                     ' альтернатив. Рекомендуется активный поиск новых поставщиков.')
                ELSE concat('Хорошие возможности диверсификации: ', alternative_suppliers, ' альтернатив доступно.') END AS summary
    FROM n"""), doubles="market_coverage:6 diversification:6")
def market_position(spark, d):
    _, profiles, current = _frames(spark, d)
    return alt.market_position(profiles, current)


@query("alternatives_for_major_suppliers", "A62", with_views("contracts_eur", f"""WITH {_PROFILES},
    s AS (SELECT discipline, counterparty_name, sum(total_contract_amount_eur) AS amount FROM contracts_eur GROUP BY 1, 2),
    j AS (SELECT discipline, counterparty_name FROM (SELECT *, amount / sum(amount) OVER (PARTITION BY discipline) * 100 AS share
          FROM s) q WHERE share >= 3.0),
    h AS (SELECT e.discipline, e.product_name, e.counterparty_name AS major_supplier, avg(unit_price_eur) AS cur
          FROM contracts_eur e JOIN j ON j.discipline = e.discipline AND j.counterparty_name = e.counterparty_name GROUP BY 1, 2, 3),
    a AS (SELECT f.*, major_supplier, {_SCORE} AS score FROM f JOIN h ON f.discipline = h.discipline
          AND f.product_name = h.product_name WHERE f.counterparty_name <> major_supplier)
    SELECT discipline, major_supplier, count(DISTINCT product_name) AS products,
           count(DISTINCT counterparty_name) AS alternatives, avg(score) AS mean_score, max(score) AS best_score
    FROM a GROUP BY 1, 2"""), doubles="mean_score best_score")
def alternatives_for_major_suppliers(spark, d):
    # the contracts are put together once: sums and mean prices of the major suppliers come from the profiles
    profiles = stored(_frames(spark, d)[1])
    offers = profiles.withColumnsRenamed({"total_value": "total_contract_amount_eur", "avg_price": "unit_price_eur"})
    major = concentration.major_suppliers(concentration.supplier_shares(offers), 3.0)
    return alt.major_totals(alt.alternatives_for_major(profiles, offers, major, NOW))


@query("current_and_other_prices", "A63", with_views("contracts_eur", f"""
    WITH s AS (SELECT discipline, product_name, counterparty_name,
                      max(CASE WHEN project_name = '{PROJECT}' THEN 1 ELSE 0 END) AS inside FROM contracts_eur GROUP BY 1, 2, 3),
         n AS (SELECT discipline, product_name, count(CASE WHEN inside = 1 THEN 1 END) AS current_suppliers,
                      count(CASE WHEN inside = 0 THEN 1 END) AS other_suppliers FROM s GROUP BY 1, 2)
    SELECT e.discipline, e.product_name, avg(CASE WHEN project_name = '{PROJECT}' THEN unit_price_eur END) AS current_mean,
           avg(CASE WHEN project_name <> '{PROJECT}' THEN unit_price_eur END) AS other_mean,
           any_value(current_suppliers) AS current_suppliers, any_value(other_suppliers) AS other_suppliers
    FROM contracts_eur e JOIN n ON n.discipline = e.discipline AND n.product_name = e.product_name GROUP BY 1, 2"""),
    doubles="current_mean other_mean")
def current_and_other_prices(spark, d):
    return alt.current_and_other_prices(_frames(spark, d)[0], PROJECT)


@query("other_suppliers", "A63", with_views("contracts_eur", f"""
    SELECT discipline, product_name, counterparty_name FROM contracts_eur GROUP BY 1, 2, 3
    HAVING count(CASE WHEN project_name = '{PROJECT}' THEN 1 END) = 0"""))
def other_suppliers(spark, d):
    return alt.other_suppliers(_frames(spark, d)[0], PROJECT)

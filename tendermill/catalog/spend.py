"""Spend queries over lots and contracts."""

from __future__ import annotations


from pyspark.sql import functions as F

from tendermill.catalog.registry import query, with_views
from tendermill.functions.money import EUR_RATES
from tendermill.operators import cleaning, grouping
from tendermill.plans import spend
from tendermill.sources import views

DISCIPLINES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
CURRENCIES = list(EUR_RATES)
LOT_EUR = [("total_price", "currency", "total_price_eur")]
CONTRACT_EUR = [("total_contract_amount", "contract_currency", "total_contract_amount_eur")]


def lots_eur(spark, d, *columns):
    return cleaning.in_eur(views.lots(spark, d, *columns, "total_price", "currency"), LOT_EUR)


def contracts_eur(spark, d, *columns):
    return cleaning.in_eur(views.contracts(spark, d, *columns, "total_contract_amount", "contract_currency"), CONTRACT_EUR)


@query(
    "price_bounds_by_currency", "A1",
    with_views("lots", """
        SELECT discipline, currency, sum(total_price) AS total, min(total_price) AS least, max(total_price) AS most
        FROM lots WHERE currency IS NOT NULL AND total_price <> 0 GROUP BY discipline, currency"""),
    doubles="total:2 least most")
def price_bounds_by_currency(spark, d):
    return spend.price_bounds(views.lots(spark, d, "discipline", "currency", "total_price"))


@query("lots_by_discipline_currency", "A2", with_views("lots", """
    SELECT discipline, currency, count(DISTINCT lot_number) AS lots FROM lots GROUP BY discipline, currency"""))
def lots_by_discipline_currency(spark, d):
    return spend.distinct_lots(views.lots(spark, d, "discipline", "currency", "lot_number"), "discipline", "currency")


@query("lots_by_actor_currency", "A3", with_views("lots", """
    SELECT discipline, actor_name, currency, count(DISTINCT lot_number) AS lots
    FROM lots GROUP BY discipline, actor_name, currency"""))
def lots_by_actor_currency(spark, d):
    keys = ["discipline", "actor_name", "currency"]
    lots = views.lots(spark, d, *keys, "lot_number")
    return spend.distinct_lots(views.spread(spark, d, lots, *keys), *keys)


@query("monthly_totals_eur", "A4", with_views("lots_eur", """
    SELECT CAST(date_trunc('month', close_date) AS DATE) AS month, sum(total_price_eur) AS total
    FROM lots_eur GROUP BY 1"""), doubles="total:1", dates="month")
def monthly_totals_eur(spark, d):
    return spend.monthly_totals(lots_eur(spark, d, "close_date"), "close_date", "total_price_eur")


@query("month_by_discipline", "A5", with_views("lots_eur", "SELECT CAST(date_trunc('month', close_date) AS DATE) AS month, "
       + ", ".join(f"sum(CASE WHEN discipline = '{x}' THEN total_price_eur ELSE 0.0 END) AS \"{x}\"" for x in DISCIPLINES)
       + " FROM lots_eur GROUP BY 1"), doubles=" ".join(f"{x}:1" for x in DISCIPLINES), dates="month")
def month_by_discipline(spark, d):
    return spend.month_by_discipline(lots_eur(spark, d, "discipline", "close_date"), DISCIPLINES)


@query("significant_disciplines", "A6 W8", with_views("lots_eur", """
    WITH t AS (SELECT discipline, sum(total_price_eur) AS total FROM lots_eur GROUP BY discipline),
         s AS (SELECT discipline, total, total / (SELECT sum(total) FROM t) * 100 AS share FROM t)
    SELECT CASE WHEN share >= 16.5 THEN discipline ELSE 'Другие' END AS discipline, sum(total) AS total, sum(share) AS share
    FROM s GROUP BY 1"""), doubles="total:1 share:6")
def significant_disciplines(spark, d):
    return spend.significant_disciplines(lots_eur(spark, d, "discipline"), 16.5)


@query("discipline_summary", "A7", with_views("lots_eur", """
    SELECT discipline, sum(total_price_eur) AS total_eur, avg(total_price_eur) AS mean_eur, count(*) AS purchases,
           sum(total_price) AS total_original, sum(total_price_eur) / (SELECT sum(total_price_eur) FROM lots_eur) * 100 AS share
    FROM lots_eur GROUP BY discipline"""), doubles="total_eur:1 mean_eur total_original:1 share:6")
def discipline_summary(spark, d):
    return spend.discipline_summary(lots_eur(spark, d, "discipline"))


@query("monthly_series_stats", "A8", with_views("lots_eur", """
    WITH m AS (SELECT date_trunc('month', close_date) AS month, sum(total_price_eur) AS total FROM lots_eur GROUP BY 1)
    SELECT avg(total) AS mean, median(total) AS median, stddev_samp(total) AS std,
           stddev_samp(total) / avg(total) AS cv, min(total) AS least, max(total) AS most FROM m"""),
    doubles="mean:2 median:2 std:2 cv:6 least:2 most:2")
def monthly_series_stats(spark, d):
    return spend.series_stats(spend.monthly_totals(lots_eur(spark, d, "close_date"), "close_date", "total_price_eur"))


@query("cv_by_discipline", "A9", with_views("lots_eur", """
    SELECT discipline, CASE WHEN avg(total_price_eur) <> 0 THEN stddev_samp(total_price_eur) / avg(total_price_eur)
           ELSE 0.0 END AS cv FROM lots_eur GROUP BY discipline"""), doubles="cv:6")
def cv_by_discipline(spark, d):
    return spend.cv_by_discipline(lots_eur(spark, d, "discipline"))


@query("forecast_candidates", "A10 J11", with_views("lots_eur", """
    SELECT discipline, sum(total_price_eur) / (SELECT sum(total_price_eur) FROM lots_eur) * 100 AS share,
           stddev_samp(total_price_eur) / avg(total_price_eur) AS cv FROM lots_eur GROUP BY discipline
    HAVING sum(total_price_eur) / (SELECT sum(total_price_eur) FROM lots_eur) * 100 >= 2
       AND stddev_samp(total_price_eur) / avg(total_price_eur) < 20"""), doubles="share:6 cv:6")
def forecast_candidates(spark, d):
    return spend.forecast_candidates(lots_eur(spark, d, "discipline"))


@query("supplier_stats", "A11", with_views("lots_eur", """
    SELECT winner_name, sum(total_price_eur) AS total, count(*) AS purchases, avg(total_price_eur) AS mean
    FROM lots_eur GROUP BY winner_name"""), doubles="total:1 mean")
def supplier_stats(spark, d):
    return spend.supplier_stats(lots_eur(spark, d, "winner_name"))


@query("overall_supplier_stats", "A11", with_views("lots_eur", """
    SELECT count(DISTINCT winner_name) AS suppliers, count(*) AS purchases, sum(total_price_eur) AS total,
           avg(total_price_eur) AS mean FROM lots_eur"""), doubles="total:0 mean")
def overall_supplier_stats(spark, d):
    return spend.overall_supplier_stats(lots_eur(spark, d, "winner_name")).withColumn(
        "purchases", F.col("purchases").cast("long"))


_TOP10 = "SELECT winner_name FROM lots_eur GROUP BY winner_name ORDER BY sum(total_price_eur) DESC, winner_name LIMIT 10"


@query("supplier_by_currency", "A12 J10", with_views("lots_eur", f"SELECT winner_name, "
       + ", ".join(f"sum(CASE WHEN currency = '{x}' THEN total_price ELSE 0.0 END) AS \"{x}\"" for x in CURRENCIES)
       + f" FROM lots_eur WHERE winner_name IN ({_TOP10}) GROUP BY winner_name"),
       doubles=" ".join(f"{x}:2" for x in CURRENCIES))
def supplier_by_currency(spark, d):
    return spend.supplier_by_currency(lots_eur(spark, d, "winner_name"), CURRENCIES)


@query("supplier_by_month", "A13", with_views("lots_eur", f"""SELECT winner_name, strftime(close_date, '%Y-%m') AS month,
    sum(total_price_eur) AS total FROM lots_eur WHERE winner_name IN ({_TOP10}) GROUP BY 1, 2"""), doubles="total:2")
def supplier_by_month(spark, d):
    return spend.supplier_months(lots_eur(spark, d, "winner_name", "close_date"))


_TOP10C = ("SELECT counterparty_name FROM contracts_eur GROUP BY counterparty_name "
           "ORDER BY sum(total_contract_amount_eur) DESC, counterparty_name LIMIT 10")


@query("top_supplier_quarters", "A14", with_views("contracts_eur", f"""
    SELECT counterparty_name, CAST(date_trunc('quarter', contract_signing_date) AS DATE) AS quarter,
           sum(total_contract_amount_eur) AS total
    FROM contracts_eur WHERE counterparty_name IN ({_TOP10C}) GROUP BY 1, 2"""), doubles="total:2", dates="quarter")
def top_supplier_quarters(spark, d):
    return spend.top_supplier_quarters(contracts_eur(spark, d, "counterparty_name", "contract_signing_date"))


@query("top_supplier_products", "A14", with_views("contracts_eur", f"""
    SELECT counterparty_name, product_name, avg(total_contract_amount_eur) AS mean
    FROM contracts_eur WHERE counterparty_name IN ({_TOP10C}) GROUP BY 1, 2"""), doubles="mean:3")
def top_supplier_products(spark, d):
    return spend.top_supplier_products(contracts_eur(spark, d, "counterparty_name", "product_name"))


@query("top_supplier_range", "A14", with_views("contracts_eur", f"""
    SELECT counterparty_name, count(DISTINCT product_name) AS unique_products,
           count(DISTINCT discipline) AS unique_disciplines
    FROM contracts_eur WHERE counterparty_name IN ({_TOP10C}) GROUP BY 1"""))
def top_supplier_range(spark, d):
    return spend.top_supplier_range(contracts_eur(spark, d, "counterparty_name", "product_name", "discipline"))


@query("top_share_gini", "A15", with_views("contracts_eur", """
    WITH t AS (SELECT counterparty_name, sum(total_contract_amount_eur) AS total FROM contracts_eur GROUP BY 1),
         b AS (SELECT counterparty_name, total / (SELECT sum(total) FROM t) AS share FROM t
               ORDER BY total DESC, counterparty_name LIMIT 10),
         c AS (SELECT share, sum(share) OVER (ORDER BY share, counterparty_name DESC) AS cum FROM b),
         p AS (SELECT share, cum, lag(cum) OVER (ORDER BY cum) AS prev FROM c)
    SELECT sum(share) AS top_share, 1 - 2 * sum((cum + prev) / 2) / count(*) AS gini FROM p"""),
    doubles="top_share:6 gini:6")
def top_share_gini(spark, d):
    return spend.top_share_gini(contracts_eur(spark, d, "counterparty_name"))


@query("win_frequency", "A16 T1", with_views("lots", """
    SELECT project_name, discipline, actor_name, winner_name, count(*) AS win_count,
           round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY project_name, discipline, actor_name) * 100
                 + 1e-9, 2) AS win_percentage
    FROM (SELECT project_name, discipline, trim(split_part(actor_name, '(', 1)) AS actor_name, winner_name FROM lots) t
    GROUP BY project_name, discipline, actor_name, winner_name"""), doubles="win_percentage")
def win_frequency(spark, d):
    from tendermill.functions.text import before_bracket
    lots = views.lots(spark, d, "project_name", "discipline", "actor_name", "winner_name")
    return spend.win_frequency(lots.withColumn("actor_name", before_bracket("actor_name"))).orderBy(
        "discipline", "actor_name", F.desc("win_count"))


@query("favourite_suppliers", "T3", with_views("lots", """
    SELECT project_name, discipline, actor_name, winner_name, win_count, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY project_name, discipline, actor_name
                                   ORDER BY win_count DESC, winner_name) AS rank
      FROM (SELECT project_name, discipline, trim(split_part(actor_name, '(', 1)) AS actor_name, winner_name,
                   count(*) AS win_count FROM lots GROUP BY ALL) t) r WHERE rank <= 3"""))
def favourite_suppliers(spark, d):
    from tendermill.functions.text import before_bracket
    lots = views.lots(spark, d, "project_name", "discipline", "actor_name", "winner_name")
    return spend.favourite_suppliers(lots.withColumn("actor_name", before_bracket("actor_name"))).drop("win_percentage")


@query("bidding_duration", "A17 J6", with_views("lots", """
    WITH t AS (SELECT discipline, trim(split_part(actor_name, '(', 1)) AS actor_name, winner_name,
                      date_diff('day', open_date, close_date) AS days FROM lots),
         o AS (SELECT discipline, avg(days) AS overall_avg_duration FROM t GROUP BY discipline)
    SELECT t.discipline, actor_name, winner_name, count(*) AS win_count, avg(days) AS average_duration,
           any_value(overall_avg_duration) AS overall_avg_duration,
           avg(days) - any_value(overall_avg_duration) AS duration_difference
    FROM t JOIN o ON t.discipline = o.discipline GROUP BY ALL"""),
    doubles="average_duration:6 overall_avg_duration:6 duration_difference:6")
def bidding_duration(spark, d):
    from tendermill.functions.text import before_bracket
    lots = views.lots(spark, d, "discipline", "actor_name", "winner_name", "open_date", "close_date")
    return spend.bidding_duration(lots.withColumn("actor_name", before_bracket("actor_name")))


@query("lots_by_quarter", "A18", with_views("lots", "SELECT discipline, " + ", ".join(
    f"count(DISTINCT CASE WHEN quarter(close_date) = {q} THEN lot_number END) AS q{q}" for q in (1, 2, 3, 4))
    + " FROM lots GROUP BY discipline"))
def lots_by_quarter(spark, d):
    return spend.lots_by_quarter(views.lots(spark, d, "discipline", "close_date", "lot_number"))


@query("lot_list_by_quarter", "A18", with_views("lots", """
    SELECT DISTINCT discipline, quarter(close_date) AS quarter, lot_number FROM lots"""))
def lot_list_by_quarter(spark, d):
    return spend.lot_list_by_quarter(views.lots(spark, d, "discipline", "close_date", "lot_number"))


@query("half_year_totals", "A41", with_views("contracts_eur", """
    SELECT year(contract_signing_date) AS year, CASE WHEN month(contract_signing_date) <= 6 THEN CAST(1 AS BIGINT)
           ELSE CAST(2 AS BIGINT) END AS half, sum(total_contract_amount_eur) AS total FROM contracts_eur GROUP BY 1, 2"""),
    doubles="total:1")
def half_year_totals(spark, d):
    c = contracts_eur(spark, d, "contract_signing_date")
    return spend.half_year_totals(c, "contract_signing_date", "total_contract_amount_eur")


@query("currency_months", "A48", with_views("lots", """
    SELECT currency, CAST(date_trunc('month', close_date) AS DATE) AS month, sum(total_price) AS total
    FROM lots GROUP BY 1, 2"""), doubles="total:2", dates="month")
def currency_months(spark, d):
    return spend.currency_months(views.lots(spark, d, "currency", "close_date", "total_price"))


@query("currency_leaders", "A48 T3", with_views("lots", """
    SELECT currency, winner_name, total, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY currency ORDER BY total DESC, winner_name) AS rank
      FROM (SELECT currency, winner_name, sum(total_price) AS total FROM lots GROUP BY 1, 2) t) r
    WHERE rank <= 5"""), doubles="total:2")
def currency_leaders(spark, d):
    return spend.currency_leaders(views.lots(spark, d, "currency", "winner_name", "total_price"))


@query("percent_of_peak", "W12", with_views("lots_eur", """
    WITH m AS (SELECT discipline, CAST(date_trunc('month', close_date) AS DATE) AS month, sum(total_price_eur) AS total
               FROM lots_eur GROUP BY 1, 2)
    SELECT discipline, month, total, total / max(total) OVER (PARTITION BY discipline) * 100 AS percent_of_peak FROM m"""),
    doubles="total:1 percent_of_peak:6", dates="month")
def percent_of_peak(spark, d):
    monthly = spend.monthly_totals(lots_eur(spark, d, "discipline", "close_date"), "close_date", "total_price_eur",
                                   "discipline")
    return spend.percent_of_peak(monthly, "discipline")


@query("abc_classes", "A26 W7", with_views("lots", """
    WITH t AS (SELECT discipline, winner_name, currency, sum(total_price) AS total FROM lots GROUP BY ALL),
         c AS (SELECT *, total / sum(total) OVER (PARTITION BY currency) * 100 AS share,
                      sum(total) OVER (PARTITION BY currency ORDER BY total DESC, discipline, winner_name
                                       ROWS UNBOUNDED PRECEDING) / sum(total) OVER (PARTITION BY currency) * 100 AS cumulative
               FROM t)
    SELECT *, CASE WHEN cumulative <= 70 THEN 'A' WHEN cumulative <= 90 THEN 'B' ELSE 'C' END AS abc FROM c"""),
    doubles="total:2 share:6 cumulative:6")
def abc_classes(spark, d):
    return spend.abc_classes(views.lots(spark, d, "discipline", "winner_name", "currency", "total_price"))


@query("largest_suppliers", "T2", with_views("lots_eur", """
    SELECT winner_name, sum(total_price_eur) AS total FROM lots_eur GROUP BY winner_name
    ORDER BY total DESC, winner_name LIMIT 10"""), doubles="total:1")
def largest_suppliers(spark, d):
    return spend.top_suppliers(lots_eur(spark, d, "winner_name"), "winner_name", "total_price_eur")


@query("top_and_bottom_suppliers", "T4 T8", with_views("lots_eur", """
    WITH t AS (SELECT winner_name, sum(total_price_eur) AS total FROM lots_eur GROUP BY winner_name)
    (SELECT winner_name, total, 'top' AS side FROM t ORDER BY total DESC, winner_name LIMIT 10)
    UNION ALL (SELECT winner_name, total, 'bottom' AS side FROM t ORDER BY total, winner_name LIMIT 10)"""),
    doubles="total:1")
def top_and_bottom_suppliers(spark, d):
    totals = lots_eur(spark, d, "winner_name").groupBy("winner_name").agg(
        grouping.exact_sum("total_price_eur").alias("total"))
    return grouping.top_and_bottom(totals, 10, "total", "winner_name")


@query("status_counts", "T5", with_views("lots", "SELECT lot_status, count(*) AS n FROM lots GROUP BY lot_status"))
def status_counts(spark, d):
    return grouping.value_counts(views.lots(spark, d, "lot_status"), "lot_status")


@query("suppliers_in_both", "T9", with_views("lots", """
    SELECT winner_name FROM lots WHERE discipline = 'ECONOMY' AND project_name = 'BUILDING' INTERSECT
    SELECT winner_name FROM lots WHERE discipline = 'LARGE' AND project_name = 'MACHINERY'"""))
def suppliers_in_both(spark, d):
    lots = views.lots(spark, d, "winner_name", "discipline", "project_name")
    left = lots.where((F.col("discipline") == "ECONOMY") & (F.col("project_name") == "BUILDING")).select("winner_name")
    right = lots.where((F.col("discipline") == "LARGE") & (F.col("project_name") == "MACHINERY")).select("winner_name")
    return grouping.common_values(left, right)


@query("lots_without_contracts", "T10", with_views("lots contracts", """
    SELECT lot_number FROM lots EXCEPT SELECT lot_number FROM contracts"""))
def lots_without_contracts(spark, d):
    return grouping.values_without(views.lots(spark, d, "lot_number"), views.contracts(spark, d, "lot_number"))

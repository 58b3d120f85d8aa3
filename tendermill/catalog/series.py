"""Weekly, monthly, trend and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendermill.catalog.pricing import contracts_eur, lots_eur
from tendermill.catalog.registry import query, with_views
from tendermill.plans import series, spend, trend
from tendermill.sources import views

_WEEK_COLUMNS = ["contract_signing_date", "contract_number", "counterparty_name"]
_WEEKS = """
    w AS (SELECT CAST(date_trunc('week', contract_signing_date) AS DATE) AS contract_week,
                 sum(total_contract_amount_eur) AS total_amount, avg(unit_price_eur) AS avg_unit_price,
                 max(total_contract_amount_eur) AS max_contract, min(total_contract_amount_eur) AS min_contract,
                 stddev_samp(total_contract_amount_eur) AS std_contract, count(DISTINCT contract_number) AS contract_count,
                 count(DISTINCT counterparty_name) AS unique_counterparties,
                 median(total_contract_amount_eur) AS median_contract FROM contracts_eur GROUP BY 1)"""


def _weekly(spark, d):
    return series.weekly_base(contracts_eur(spark, d, *_WEEK_COLUMNS))


@query("weekly_base", "A39", with_views("contracts_eur", f"WITH {_WEEKS} SELECT * FROM w"),
       doubles="total_amount:2 avg_unit_price max_contract min_contract std_contract median_contract", dates="contract_week")
def weekly_base(spark, d):
    return _weekly(spark, d)


_SHAPE = f"""{_WEEKS},
    s AS (SELECT *, weekofyear(contract_week) AS week, sin(2 * pi() * weekofyear(contract_week) / 52) AS week_sin,
                 cos(2 * pi() * weekofyear(contract_week) / 52) AS week_cos, month(contract_week) AS month,
                 quarter(contract_week) AS quarter, row_number() OVER o - 1 AS week_number,
                 total_amount / contract_count AS avg_contract_size, max_contract / total_amount AS max_concentration,
                 CAST(max_contract > (SELECT quantile_cont(max_contract, 0.75) FROM w) AS BIGINT) AS has_large_contract,
                 avg(total_amount) OVER (ORDER BY contract_week ROWS 2 PRECEDING) AS amount_ma3,
                 avg(total_amount) OVER (ORDER BY contract_week ROWS 3 PRECEDING) AS amount_ma4,
                 total_amount - lag(total_amount) OVER o AS amount_change,
                 coalesce(total_amount / lag(total_amount) OVER o - 1, 0) AS amount_pct_change,
                 stddev_samp(total_amount) OVER (ORDER BY contract_week ROWS 3 PRECEDING) AS amount_volatility,
                 CAST(coalesce(total_amount > lag(total_amount) OVER o, false) AS BIGINT) AS is_growing,
                 total_amount / unique_counterparties AS amount_per_counterparty,
                 unique_counterparties - lag(unique_counterparties) OVER o AS counterparties_change,
                 std_contract / (total_amount / contract_count) AS contract_cv
          FROM w WINDOW o AS (ORDER BY contract_week)),
    f AS (SELECT *, amount_change - lag(amount_change) OVER (ORDER BY contract_week) AS amount_acceleration FROM s)"""
_SHAPE_DOUBLES = ("total_amount:2 avg_unit_price max_contract min_contract std_contract median_contract week_sin:6 week_cos:6 "
                  "avg_contract_size:3 max_concentration:6 amount_ma3:2 amount_ma4:2 amount_change:2 amount_pct_change:6 "
                  "amount_volatility:2 amount_per_counterparty:3 contract_cv:6 amount_acceleration:2")


@query("weekly_shape", "W2 W3 W6", with_views("contracts_eur", f"WITH {_SHAPE} SELECT * FROM f"), doubles=_SHAPE_DOUBLES,
       dates="contract_week")
def weekly_shape(spark, d):
    return series.with_shape(_weekly(spark, d))


@query("weekly_lags", "W4", with_views("contracts_eur", f"WITH {_SHAPE} SELECT contract_week, " + ", ".join(
    f"lag({c}, {i}) OVER (ORDER BY contract_week) AS {c}_lag_{i}" for c in series.LAGGED for i in (1, 2, 3, 4))
    + " FROM f"), doubles=" ".join(f"{c}_lag_{i}:2" for c in series.LAGGED for i in (1, 2, 3, 4)
                                   if c not in ("contract_count", "unique_counterparties")), dates="contract_week")
def weekly_lags(spark, d):
    lagged = series.with_lags(series.with_shape(_weekly(spark, d)), series.LAGGED, series.LAGS)
    return lagged.select("contract_week", *(f"{c}_lag_{i}" for c in series.LAGGED for i in (1, 2, 3, 4)))


@query("weekly_target", "W5", with_views("contracts_eur", f"""WITH {_SHAPE}
    SELECT contract_week, ln(1 + greatest(lead(amount_ma3) OVER (ORDER BY contract_week),
           CASE WHEN lead(amount_ma3) OVER (ORDER BY contract_week) IS NOT NULL THEN 1.0 END)) AS target FROM f"""),
    doubles="target:6", dates="contract_week")
def weekly_target(spark, d):
    return series.with_target(series.with_shape(_weekly(spark, d)), True).select("contract_week", "target")


@query("top_discipline_counts", "A40 J10", with_views("contracts_eur", """
    WITH r AS (SELECT discipline, row_number() OVER (ORDER BY count(*) DESC, discipline) AS place FROM contracts_eur GROUP BY 1),
         c AS (SELECT CAST(date_trunc('week', contract_signing_date) AS DATE) AS contract_week, discipline,
                      count(DISTINCT contract_number) AS n FROM contracts_eur GROUP BY 1, 2)
    SELECT contract_week, """ + ", ".join(f"CAST(sum(CASE WHEN place = {i} THEN n ELSE 0 END) AS BIGINT) AS top{i}"
                                          for i in range(1, 6))
    + " FROM c JOIN r ON c.discipline = r.discipline GROUP BY 1"), dates="contract_week")
def top_discipline_counts(spark, d):
    return series.top_discipline_counts(contracts_eur(spark, d, "contract_signing_date", "contract_number", "discipline"))


@query("chronological_split", "K10", with_views("contracts_eur", f"""WITH {_WEEKS}
    SELECT contract_week, row_number() OVER (ORDER BY contract_week) > count(*) OVER () - ceil(count(*) OVER () * 0.3)
           AS is_test FROM w"""), dates="contract_week")
def chronological_split(spark, d):
    return series.chronological_split(_weekly(spark, d), 0.3).select("contract_week", "is_test")


@query("weekly_diagnosis", "K14", with_views("contracts_eur", f"""WITH {_WEEKS}
    SELECT count(*) AS weeks, avg(total_amount) AS mean, median(total_amount) AS median, stddev_samp(total_amount) AS std,
           min(total_amount) AS least, max(total_amount) AS most, stddev_samp(total_amount) / avg(total_amount) AS cv,
           stddev_samp(total_amount) / avg(total_amount) > 1 AS is_volatile, count(*) < 30 AS below_30,
           CASE WHEN count(*) < 20 THEN 'too few for a regression' WHEN count(*) < 40 THEN 'simple model'
                WHEN count(*) < 80 THEN 'standard model' ELSE 'full model' END AS verdict FROM w"""),
    doubles="mean:2 median:2 std:2 least:2 most:2 cv:6")
def weekly_diagnosis(spark, d):
    return series.diagnosis(_weekly(spark, d))


@query("weekly_autocorrelation", "W13", with_views("contracts_eur", f"WITH {_WEEKS}, r AS (" + " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS lag, corr(total_amount, b) AS correlation FROM "
    f"(SELECT total_amount, lag(total_amount, {i}) OVER (ORDER BY contract_week) AS b FROM w) t{i}" for i in (1, 2, 3, 4))
    + """) SELECT *, CASE WHEN abs(correlation) < 0.3 THEN 'weak' WHEN abs(correlation) < 0.7 THEN 'medium'
    ELSE 'strong' END AS strength FROM r"""), doubles="correlation:6")
def weekly_autocorrelation(spark, d):
    return series.autocorrelation(_weekly(spark, d), "total_amount", "contract_week")


@query("monthly_acf", "W13", with_views("lots_eur", """WITH m AS (SELECT date_trunc('month', close_date) AS month, sum(total_price_eur) AS total FROM lots_eur GROUP BY 1),
    c AS (SELECT month, total - (SELECT avg(total) FROM m) AS x FROM m), r AS (""" + " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS lag, sum(x * b) / sum(x * x) AS acf FROM "
    f"(SELECT x, lag(x, {i}) OVER (ORDER BY month) AS b FROM c) t{i}" for i in range(1, 21)) + ") SELECT * FROM r"),
    doubles="acf:6")
def monthly_acf(spark, d):
    return series.acf(_monthly(spark, d), "total", "month")


def _monthly(spark, d):
    return spend.monthly_totals(lots_eur(spark, d, "close_date"), "close_date", "total_price_eur")


_MONTHS = """
    m AS (SELECT CAST(date_trunc('month', close_date) AS DATE) AS month, sum(total_price_eur) AS total FROM lots_eur GROUP BY 1),
    q AS (SELECT quantile_cont(total, 0.25) AS q1, quantile_cont(total, 0.75) AS q3 FROM m),
    c AS (SELECT month, total FROM m, q WHERE total BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"""


@query("month_z_scores", "O1", with_views("lots_eur", f"""WITH {_MONTHS}
    SELECT month, total, (total - avg(total) OVER ()) / stddev_pop(total) OVER () AS z,
           abs((total - avg(total) OVER ()) / stddev_pop(total) OVER ()) >= 2 AS is_outlier FROM m"""),
    doubles="total:1 z:6", dates="month")
def month_z_scores(spark, d):
    return trend.outlier_months(_monthly(spark, d))


@query("months_without_outliers", "O2", with_views("lots_eur", f"WITH {_MONTHS} SELECT * FROM c"), doubles="total:1",
       dates="month")
def months_without_outliers(spark, d):
    return trend.cleaned_months(_monthly(spark, d))


@query("moving_mean", "W1", with_views("lots_eur", f"""WITH {_MONTHS}
    SELECT month, total, CASE WHEN row_number() OVER (ORDER BY month) >= 3
           THEN avg(total) OVER (ORDER BY month ROWS 2 PRECEDING) END AS moving_mean FROM c"""),
    doubles="total:1 moving_mean:1", dates="month")
def moving_mean(spark, d):
    return series.moving_mean(trend.cleaned_months(_monthly(spark, d)), "total", "month")


@query("monthly_trend", "F1", with_views("lots_eur", f"""WITH {_MONTHS},
    x AS (SELECT total, CAST(row_number() OVER (ORDER BY month) - 1 AS DOUBLE) AS x FROM c)
    SELECT regr_slope(total, x) AS slope, regr_intercept(total, x) AS intercept, regr_r2(total, x) AS r2, count(*) AS points
    FROM x"""), doubles="slope:3 intercept:2 r2:6")
def monthly_trend(spark, d):
    return trend.linear_trend(trend.cleaned_months(_monthly(spark, d)))


_KEYS = ["discipline", "counterparty_name"]
_FILLED = """
    t AS (SELECT discipline, counterparty_name, CAST(date_trunc('month', contract_signing_date) AS DATE) AS month,
                 sum(total_contract_amount_eur) AS total FROM contracts_eur GROUP BY 1, 2, 3),
    g AS (SELECT discipline, counterparty_name, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE)
                 AS month FROM t GROUP BY 1, 2),
    s AS (SELECT g.discipline, g.counterparty_name, g.month, coalesce(total, 0.0) AS total,
                 CAST(row_number() OVER (PARTITION BY g.discipline, g.counterparty_name ORDER BY g.month) - 1 AS DOUBLE) AS x
          FROM g LEFT JOIN t ON t.discipline = g.discipline AND t.counterparty_name = g.counterparty_name AND t.month = g.month)"""


def _flow(spark, d):
    return contracts_eur(spark, d, *_KEYS, "contract_signing_date")


def _filled(spark, d):
    return trend.filled_months(_flow(spark, d), _KEYS, "contract_signing_date", "total_contract_amount_eur")


@query("months_filled", "J15", with_views("contracts_eur", f"""WITH {_FILLED}
    SELECT discipline, counterparty_name, month, total FROM s"""), doubles="total:3", dates="month")
def months_filled(spark, d):
    return _filled(spark, d)


@query("group_trends", "F2", with_views("contracts_eur", f"""WITH {_FILLED}
    SELECT discipline, counterparty_name, count(*) AS months, regr_slope(total, x) AS slope,
           regr_intercept(total, x) AS intercept, regr_r2(total, x) AS r2 FROM s GROUP BY 1, 2 HAVING count(*) >= 2"""),
    doubles="slope:3 intercept:3 r2:6")
def group_trends(spark, d):
    return trend.group_trends(_flow(spark, d), _KEYS, "contract_signing_date", "total_contract_amount_eur")


@query("trend_preparation", "F3", with_views("lots contracts_eur", """
    WITH p AS (SELECT DISTINCT lot_number, project_name FROM lots)
    SELECT p.project_name, CAST(date_trunc('month', contract_signing_date) AS DATE) AS year_month, count(*) AS contracts,
           sum(total_contract_amount_eur) AS amount FROM contracts_eur c JOIN p ON p.lot_number = c.lot_number
    WHERE total_contract_amount > 0 AND quantity > 0 GROUP BY 1, 2"""), doubles="amount:1", dates="year_month")
def trend_preparation(spark, d):
    contracts = views.contracts(spark, d, "row_key", "lot_number", "contract_signing_date", "total_contract_amount",
                                "unit_price", "quantity", "contract_currency")
    kept, _ = trend.prepared_for_trend(contracts, views.lots(spark, d, "lot_number", "project_name"))
    return kept.groupBy("project_name", "year_month").agg(
        F.count("*").alias("contracts"), F.sum("total_contract_amount_eur").alias("amount"))


_SMOOTH = f"""{_FILLED},
    k AS (SELECT discipline, counterparty_name, median(CASE WHEN total <> 0 THEN total END) AS target,
                 count(CASE WHEN total = 0 THEN 1 END) AS empty FROM s GROUP BY 1, 2),
    j AS (SELECT s.*, target, empty, total > 2 * target AND empty > 0 AS peak FROM s JOIN k
          ON k.discipline = s.discipline AND k.counterparty_name = s.counterparty_name),
    o AS (SELECT discipline, counterparty_name, sum(CASE WHEN peak THEN total - target ELSE 0.0 END) AS pool FROM j GROUP BY 1, 2),
    e AS (SELECT j.discipline, j.counterparty_name, month, x, total,
                 CASE WHEN peak THEN target WHEN total = 0 THEN pool / empty ELSE total END AS smooth
          FROM j JOIN o ON o.discipline = j.discipline AND o.counterparty_name = j.counterparty_name)"""


@query("smoothed_months", "F4", with_views("contracts_eur", f"""WITH {_SMOOTH}
    SELECT discipline, counterparty_name, month, total, smooth FROM e"""), doubles="total:3 smooth:3", dates="month")
def smoothed_months(spark, d):
    return trend.smoothed(_filled(spark, d), _KEYS)


_LOGGED = f"""{_SMOOTH},
    l0 AS (SELECT *, ln(CASE WHEN smooth = 0 THEN 1.0 ELSE smooth END) AS y0 FROM e),
    l1 AS (SELECT *, coalesce(abs((y0 - avg(y0) OVER g) / nullif(stddev_pop(y0) OVER g, 0)) > 3, false) AS off FROM l0
           WINDOW g AS (PARTITION BY discipline, counterparty_name)),
    l2 AS (SELECT discipline, counterparty_name, median(y0) AS med FROM l1 WHERE NOT off GROUP BY 1, 2),
    l AS (SELECT l1.discipline, l1.counterparty_name, month, x, CASE WHEN off THEN med ELSE y0 END AS y FROM l1 JOIN l2
          ON l2.discipline = l1.discipline AND l2.counterparty_name = l1.counterparty_name)"""


@query("log_series", "F5", with_views("contracts_eur", f"""WITH {_LOGGED}
    SELECT discipline, counterparty_name, month, y FROM l"""), doubles="y:6", dates="month")
def log_series(spark, d):
    return trend.log_series(trend.smoothed(_filled(spark, d), _KEYS), _KEYS).drop("total", "smooth")


@query("forecasts", "F6", with_views("contracts_eur", f"""WITH {_LOGGED},
    f0 AS (SELECT discipline, counterparty_name, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, max(x) AS last_x,
                  max(month) AS last_month FROM l GROUP BY 1, 2),
    r AS (SELECT l.discipline, l.counterparty_name, month(l.month) AS moy, y - a - b * x AS residual FROM l JOIN f0
          ON f0.discipline = l.discipline AND f0.counterparty_name = l.counterparty_name),
    z AS (SELECT discipline, counterparty_name, moy, avg(residual) AS effect FROM r GROUP BY 1, 2, 3),
    v AS (SELECT r.discipline, r.counterparty_name, stddev_samp(residual - effect) AS sigma FROM r JOIN z
          ON z.discipline = r.discipline AND z.counterparty_name = r.counterparty_name AND z.moy = r.moy GROUP BY 1, 2),
    h AS (SELECT f0.*, step, CAST(last_month + to_months(CAST(step AS INT)) AS DATE) AS month
          FROM f0, (SELECT unnest(generate_series(1, 12)) AS step) n),
    p AS (SELECT h.discipline, h.counterparty_name, h.month, a + b * (last_x + step) + coalesce(effect, 0) AS level, sigma
          FROM h JOIN v ON v.discipline = h.discipline AND v.counterparty_name = h.counterparty_name
          LEFT JOIN z ON z.discipline = h.discipline AND z.counterparty_name = h.counterparty_name AND z.moy = month(h.month))
    SELECT discipline, counterparty_name, month, exp(level) AS forecast, exp(level - 1.96 * sigma) AS low,
           exp(level + 1.96 * sigma) AS high FROM p"""), doubles="forecast:3 low:3 high:2", dates="month")
def forecasts(spark, d):
    return trend.forecast(trend.log_series(trend.smoothed(_filled(spark, d), _KEYS), _KEYS), _KEYS)

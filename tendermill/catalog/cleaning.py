"""Reading, cleaning and conversion queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tendermill.catalog.registry import query, rate_sql, usd_rate_sql, with_views
from tendermill.functions import money, text, values
from tendermill.operators import cleaning
from tendermill.plans import metal
from tendermill.sources import intake, schemas, views

START, END = date(1997, 1, 1), date(1999, 12, 31)


@query(
    "lot_export_cleaned", "S1 P1 P3 P8 P13",
    with_views("lots", """
        SELECT discipline, actor_name, count(*) AS lines, count(DISTINCT lot_number) AS lots,
               sum(total_price) AS total, min(open_date) AS first_open, max(close_date) AS last_close
        FROM (SELECT DISTINCT lot_number, lot_status, discipline, project_name, open_date, close_date,
                     trim(split_part(actor_name, '(', 1)) AS actor_name, good_name, good_count,
                     round(unit_price, 2) AS unit_price, total_price, winner_name, currency, supplier_unit FROM lots) t
        GROUP BY discipline, actor_name"""),
    doubles="total:2", dates="first_open last_close")
def lot_export_cleaned(spark, d):
    """Every line written as export text twice, then read back through the intake."""
    lots = views.lots(spark, d, *schemas.LOTS.fieldNames())
    number = {c: F.regexp_replace(F.format_number(c, 2), ",", " ") for c in
              ("good_count", "supplier_qty", "unit_price", "total_price")}
    as_text = lots.withColumns({
        **{c: F.regexp_replace(n, r"\.", ",") for c, n in number.items()},
        "open_date": F.date_format("open_date", "dd.MM.yyyy"),
        "close_date": F.date_format("close_date", "dd.MM.yyyy"),
        "lot_number": F.col("lot_number").cast("string"),
    }).withColumnsRenamed({v: k for k, v in schemas.LOT_HEADERS.items()})
    # both copies are made from one text and lie side by side, so they meet before their rows are shuffled
    twice = as_text.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    cleaned = intake.lots_from_export(twice)
    return cleaned.groupBy("discipline", "actor_name").agg(
        F.count("*").alias("lines"), F.countDistinct("lot_number").alias("lots"), F.sum("total_price").alias("total"),
        F.min("open_date").alias("first_open"), F.max("close_date").alias("last_close"))


@query(
    "contract_export_cleaned", "S2 P2 P6 P12",
    with_views("contracts", """
        SELECT executor_dak, discipline, count(*) AS lines, sum(quantity) AS quantity, sum(product_amount) AS amount,
               min(contract_signing_date) AS first_signed
        FROM (SELECT DISTINCT lot_number, contract_number, contract_signing_date, lot_end_date, executor_dak,
                     counterparty_name, product_name, quantity, round(unit_price, 4) AS unit_price, product_amount,
                     round(total_contract_amount, 4) AS total_contract_amount, discipline, payment_conditions,
                     delivery_conditions, supplier_unit, additional_expenses FROM contracts) t
        GROUP BY executor_dak, discipline"""),
    doubles="quantity amount:2", dates="first_signed")
def contract_export_cleaned(spark, d):
    contracts = views.contracts(spark, d, *schemas.CONTRACTS.fieldNames())
    numeric = ["quantity", "unit_price", "product_amount", "additional_expenses", "total_contract_amount"]
    as_text = contracts.withColumns({
        **{c: F.regexp_replace(F.format_number(c, 4), ",", "") for c in numeric},
        "lot_end_date": F.date_format("lot_end_date", "dd.MM.yyyy"),
        "contract_signing_date": F.date_format("contract_signing_date", "dd.MM.yyyy"),
        "executor_dak": F.concat("executor_dak", F.lit("\n (dept)")),
        "lot_number": F.col("lot_number").cast("string"),
        "delivery_time_days": F.col("delivery_time_days").cast("string"),
    }).withColumnsRenamed({v: k for k, v in schemas.CONTRACT_HEADERS.items()})
    # both copies are made from one text, so lines are joined and written as text once
    twice = as_text.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    cleaned = intake.contracts_from_export(twice)
    return cleaned.groupBy("executor_dak", "discipline").agg(
        F.count("*").alias("lines"), F.sum("quantity").alias("quantity"), F.sum("product_amount").alias("amount"),
        F.min("contract_signing_date").alias("first_signed"))


@query(
    "staged_lots_selected", "S4 S14",
    with_views("lots", """
        SELECT project_name, currency, count(*) AS lines, sum(total_price) AS total
        FROM lots WHERE total_price > 1000.0 GROUP BY project_name, currency"""), doubles="total:2")
def staged_lots_selected(spark, d):
    staged = views.lots(spark, d, "project_name", "currency", "total_price")
    return intake.from_sql(
        spark, "SELECT project_name, currency, count(*) AS lines, sum(total_price) AS total FROM data_tmp "
        "WHERE total_price > :least GROUP BY project_name, currency", {"data_tmp": staged}, least=1000.0)


@query(
    "lots_in_date_range", "S5 S8",
    with_views("lots", """
        SELECT lot_number, row_key, close_date, total_price FROM lots
        WHERE close_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'"""), doubles="total_price", dates="close_date")
def lots_in_date_range(spark, d):
    lots = views.lots(spark, d, "lot_number", "row_key", "close_date", "total_price")
    return intake.load_range(lots, "close_date", START, END)


@query(
    "contracts_in_date_range", "S6",
    with_views("contracts", """
        SELECT contract_number, row_key, contract_signing_date, quantity FROM contracts
        WHERE contract_signing_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'"""),
    doubles="quantity", dates="contract_signing_date")
def contracts_in_date_range(spark, d):
    c = views.contracts(spark, d, "contract_number", "row_key", "contract_signing_date", "quantity")
    return intake.load_range(c, "contract_signing_date", START, END)


@query(
    "stock_in_date_range", "S7",
    with_views("stock", """
        SELECT date_column, warehouse, currency, count(*) AS lines, sum(total_price_currency) AS value
        FROM stock WHERE date_column BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'
        GROUP BY date_column, warehouse, currency"""), doubles="value:2", dates="date_column")
def stock_in_date_range(spark, d):
    rows = intake.load_range(views.stock(spark, d), "date_column", START, END)
    return rows.groupBy("date_column", "warehouse", "currency").agg(
        F.count("*").alias("lines"), F.sum("total_price_currency").alias("value"))


@query(
    "close_date_bounds", "S15",
    with_views("lots", "SELECT min(close_date) AS min_date, max(close_date) AS max_date FROM lots"),
    dates="min_date max_date")
def close_date_bounds(spark, d):
    return cleaning.date_bounds(views.lots(spark, d, "close_date"), "close_date")


@query(
    "goods_of_disciplines", "S16",
    with_views("lots", "SELECT DISTINCT good_name FROM lots WHERE discipline IN ('ECONOMY', 'PROMO')"))
def goods_of_disciplines(spark, d):
    return intake.distinct_goods(views.lots(spark, d, "discipline", "good_name"), ["ECONOMY", "PROMO"])


@query(
    "dates_parsed_from_text", "P1",
    with_views("contracts", """
        SELECT CASE WHEN delivery_conditions = 'R' THEN NULL ELSE contract_signing_date END AS signed, count(*) AS lines
        FROM contracts GROUP BY 1"""), dates="signed")
def dates_parsed_from_text(spark, d):
    c = views.contracts(spark, d, "contract_signing_date", "delivery_conditions")
    as_text = c.select(
        F.when(F.col("delivery_conditions") == "R", "31.02.1998")
        .when(F.col("delivery_conditions") == "A", F.date_format("contract_signing_date", "dd.MM.yyyy"))
        .otherwise(F.date_format("contract_signing_date", "yyyy-MM-dd")).alias("signed"))
    return cleaning.dates(as_text, ["signed"]).groupBy("signed").agg(F.count("*").alias("lines"))


@query(
    "numbers_parsed_from_text", "P2 P3",
    with_views("contracts", """
        SELECT delivery_conditions, count(*) AS lines,
               count(CASE WHEN delivery_conditions <> 'R' THEN 1 END) AS parsed,
               sum(CASE WHEN delivery_conditions <> 'R' THEN product_amount ELSE 0.0 END) AS amount
        FROM contracts GROUP BY delivery_conditions"""), doubles="amount:2")
def numbers_parsed_from_text(spark, d):
    c = views.contracts(spark, d, "product_amount", "delivery_conditions")
    written = F.translate(F.format_number("product_amount", 2), ",.", " ,")
    as_text = c.withColumn("amount_text", F.when(F.col("delivery_conditions") == "R", "n/a").otherwise(written))
    parsed = cleaning.local_numbers(as_text, ["amount_text"])
    return parsed.groupBy("delivery_conditions").agg(
        F.count("*").alias("lines"), F.count("amount_text").alias("parsed"),
        F.sum(F.coalesce("amount_text", F.lit(0.0))).alias("amount"))


@query(
    "gaps_filled", "P4",
    with_views("contracts", """
        SELECT CASE WHEN payment_conditions = '5-LOW' THEN 'Не указано' ELSE payment_conditions END AS payment_conditions,
               sum(CASE WHEN payment_conditions = '5-LOW' THEN 0.0 ELSE additional_expenses END) AS expenses,
               count(*) AS lines FROM contracts GROUP BY 1"""), doubles="expenses:2")
def gaps_filled(spark, d):
    c = views.contracts(spark, d, "payment_conditions", "additional_expenses")
    blank = F.col("payment_conditions") == "5-LOW"
    holed = c.select(F.when(~blank, F.col("payment_conditions")).alias("payment_conditions"),
                     F.when(~blank, F.col("additional_expenses")).alias("additional_expenses"))
    filled = cleaning.filled(holed, {"payment_conditions": cleaning.UNSPECIFIED, "additional_expenses": 0.0})
    return filled.groupBy("payment_conditions").agg(
        F.sum("additional_expenses").alias("expenses"), F.count("*").alias("lines"))


@query(
    "unit_price_median_filled", "P5",
    with_views("contracts", """
        SELECT executor_dak, sum(coalesce(p, (SELECT median(CASE WHEN payment_conditions <> '5-LOW' THEN unit_price END)
               FROM contracts))) AS price_sum, count(*) AS lines
        FROM (SELECT executor_dak, CASE WHEN payment_conditions <> '5-LOW' THEN unit_price END AS p FROM contracts) t
        GROUP BY executor_dak"""), doubles="price_sum:2")
def unit_price_median_filled(spark, d):
    c = views.contracts(spark, d, "executor_dak", "payment_conditions", "unit_price")
    holed = c.withColumn("unit_price", F.when(F.col("payment_conditions") != "5-LOW", F.col("unit_price")))
    return cleaning.median_filled(holed, "unit_price").groupBy("executor_dak").agg(
        F.sum("unit_price").alias("price_sum"), F.count("*").alias("lines"))


@query(
    "incomplete_rows_dropped", "P6",
    with_views("contracts", """
        SELECT counterparty_name, count(*) AS lines, sum(product_amount) AS amount FROM contracts
        WHERE payment_conditions <> '5-LOW' AND quantity > 10 GROUP BY counterparty_name"""), doubles="amount:2")
def incomplete_rows_dropped(spark, d):
    c = views.contracts(spark, d, "counterparty_name", "payment_conditions", "quantity", "product_amount")
    holed = c.withColumns({
        "payment_conditions": F.when(F.col("payment_conditions") != "5-LOW", F.col("payment_conditions")),
        "quantity": F.greatest(F.col("quantity") - 10, F.lit(0.0))})
    kept = cleaning.complete(holed, ["payment_conditions"], positive=["quantity"])
    return kept.groupBy("counterparty_name").agg(F.count("*").alias("lines"), F.sum("product_amount").alias("amount"))


@query(
    "duplicate_rows_dropped", "P7 P8",
    with_views("lots", """
        SELECT lot_number, count(*) AS lines FROM
        (SELECT DISTINCT lot_number, winner_name, good_name FROM lots) t GROUP BY lot_number"""))
def duplicate_rows_dropped(spark, d):
    lots = views.lots(spark, d, "lot_number", "winner_name", "good_name")
    return cleaning.unique_rows_in_lots(lots).groupBy("lot_number").agg(F.count("*").alias("lines"))


@query(
    "smallest_row_kept", "P9",
    with_views("contracts", """
        SELECT lot_number, counterparty_name, product_name, min(row_key) AS row_key
        FROM contracts GROUP BY lot_number, counterparty_name, product_name"""))
def smallest_row_kept(spark, d):
    c = views.contracts(spark, d, "lot_number", "counterparty_name", "product_name", "row_key")
    return cleaning.unique_by(c, ["lot_number", "counterparty_name", "product_name"], "row_key")


@query(
    "first_row_of_lot", "P10",
    with_views("lots", """
        SELECT lot_number, project_name, row_key FROM
        (SELECT lot_number, project_name, row_key,
                row_number() OVER (PARTITION BY lot_number ORDER BY project_name, row_key) AS rn FROM lots) t
        WHERE rn = 1"""))
def first_row_of_lot(spark, d):
    return cleaning.first_in_lot(views.lots(spark, d, "lot_number", "project_name", "row_key"),
                                 "project_name", "row_key")


@query(
    "lots_table_maintained", "P11 P13",
    with_views("lots", """
        SELECT actor_name, count(*) AS lines, sum(total_price) AS total FROM
        (SELECT DISTINCT trim(split_part(actor_name, '(', 1)) AS actor_name, row_key,
                CASE WHEN lot_status = 'P' THEN 0.0 ELSE total_price END AS total_price
         FROM lots WHERE good_count <> 1.0) t GROUP BY actor_name"""), doubles="total:2")
def lots_table_maintained(spark, d):
    lots = views.lots(spark, d, "actor_name", "good_count", "supplier_qty", "unit_price", "total_price", "lot_status",
                      "row_key")
    holed = lots.withColumns({"good_count": F.col("good_count") - 1,
                              "total_price": F.when(F.col("lot_status") != "P", F.col("total_price"))})
    return cleaning.maintained_lots(holed.unionByName(holed)).groupBy("actor_name").agg(
        F.count("*").alias("lines"), F.sum("total_price").alias("total"))


@query(
    "text_tidied", "P12",
    with_views("contracts", """
        SELECT concat(product_name, ' / ', discipline) AS title, count(*) AS lines FROM contracts
        GROUP BY product_name, discipline"""))
def text_tidied(spark, d):
    c = views.contracts(spark, d, "product_name", "discipline")
    raw = c.select(F.concat(F.lit("  "), "product_name", F.lit("\n/\n"), "discipline", F.lit("\n")).alias("title"))
    return raw.select(text.one_line("title").alias("title")).groupBy("title").agg(F.count("*").alias("lines"))


@query(
    "supplier_names_cleaned", "P14",
    with_views("lots", """
        SELECT trim(regexp_replace(winner_name, '\\s+', ' ', 'g')) AS supplier, count(*) AS lines, sum(total_price) AS total
        FROM lots GROUP BY 1"""), doubles="total:2")
def supplier_names_cleaned(spark, d):
    lots = views.lots(spark, d, "winner_name", "lot_status", "total_price")
    marked = (F.when(F.col("lot_status") == "F", F.concat(F.lit("не использовать дубль "), "winner_name"))
              .when(F.col("lot_status") == "O", F.concat(F.lit("[Удалено]  "), "winner_name", F.lit("<не использовать>")))
              .otherwise(F.concat(F.lit("Не использовать  "), "winner_name")))
    return lots.groupBy(text.without_unwanted_phrases(marked).alias("supplier")).agg(
        F.count("*").alias("lines"), F.sum("total_price").alias("total"))


@query(
    "supplier_names_canonical", "P15",
    with_views("lots", """
        SELECT CASE lot_status WHEN 'F' THEN 'BAGRAIN TOO' WHEN 'O' THEN 'POINT VISION СП ООО' ELSE winner_name END AS supplier,
               count(*) AS lines FROM lots GROUP BY 1"""))
def supplier_names_canonical(spark, d):
    lots = views.lots(spark, d, "winner_name", "lot_status")
    raw = (F.when(F.col("lot_status") == "F", F.lit("[Удалено]  БАГРАЙН ТОО"))
           .when(F.col("lot_status") == "O", F.lit("не использовать дубль Point Vision ПИИ"))
           .otherwise(F.col("winner_name")))
    return lots.groupBy(text.canonical_supplier(raw).alias("supplier")).agg(F.count("*").alias("lines"))


@query(
    "spend_in_eur", "P16",
    with_views("contracts_eur", """
        SELECT contract_currency, count(*) AS lines, sum(total_contract_amount_eur) AS amount_eur,
               sum(unit_price_eur) AS price_eur FROM contracts_eur GROUP BY contract_currency"""),
    doubles="amount_eur:1 price_eur:1")
def spend_in_eur(spark, d):
    c = views.contracts(spark, d, "contract_currency", "total_contract_amount", "unit_price")
    eur = cleaning.in_eur(c, [("total_contract_amount", "contract_currency", "amount_eur"),
                              ("unit_price", "contract_currency", "price_eur")])
    return eur.groupBy("contract_currency").agg(
        F.count("*").alias("lines"), F.sum("amount_eur").alias("amount_eur"), F.sum("price_eur").alias("price_eur"))


@query(
    "spend_unknown_rate_as_one", "P17",
    with_views("lots", f"""
        SELECT currency, count(*) AS lines, sum(total_price * coalesce({usd_rate_sql('currency')}, 1.0)) AS amount
        FROM lots GROUP BY currency"""), doubles="amount:1")
def spend_unknown_rate_as_one(spark, d):
    out = cleaning.in_eur(views.lots(spark, d, "currency", "total_price"), [("total_price", "currency", "usd")],
                          unknown="one", rates=money.USD_RATES)
    return out.groupBy("currency").agg(F.count("*").alias("lines"), F.sum("usd").alias("amount"))


@query(
    "spend_unknown_rate_as_null", "P18",
    with_views("lots", f"""
        SELECT currency, count(*) AS lines, count({rate_sql('currency')}) AS converted,
               sum(total_price * {rate_sql('currency')}) AS amount FROM lots GROUP BY currency"""), doubles="amount:1")
def spend_unknown_rate_as_null(spark, d):
    out = cleaning.in_eur(views.lots(spark, d, "currency", "total_price"), [("total_price", "currency", "eur")],
                          unknown="null")
    return out.groupBy("currency").agg(
        F.count("*").alias("lines"), F.count("eur").alias("converted"), F.sum("eur").alias("amount"))


@query("currencies_without_rate", "P18",
       with_views("lots", f"SELECT DISTINCT currency FROM lots WHERE {rate_sql('currency')} IS NULL"))
def currencies_without_rate(spark, d):
    return cleaning.currencies_without_rate(views.lots(spark, d, "currency"), "currency")


@query(
    "facet_filter", "P19",
    with_views("lots", """
        SELECT row_key, discipline, project_name, currency, total_price FROM lots
        WHERE discipline IN ('ECONOMY', 'LARGE') AND project_name IN ('BUILDING') AND currency IN ('EUR', 'USD', 'RUB')"""),
    doubles="total_price")
def facet_filter(spark, d):
    lots = views.lots(spark, d, "row_key", "discipline", "project_name", "currency", "total_price")
    return cleaning.facets(lots, {"discipline": ["ECONOMY", "LARGE"], "project_name": ["BUILDING"],
                                  "currency": ["EUR", "USD", "RUB"], "row_key": []})


@query("facet_values_found", "P20",
       with_views("lots", "SELECT DISTINCT winner_name FROM lots WHERE contains(lower(winner_name), 'er#0000000')"))
def facet_values_found(spark, d):
    return cleaning.facet_values(views.lots(spark, d, "winner_name"), "winner_name", "ER#0000000")


@query(
    "calendar_of_signing", "P21 P22",
    with_views("contracts", """
        SELECT year(s) AS year, month(s) AS month, strftime(s, '%Y-%m') AS year_month, quarter(s) AS quarter,
               weekofyear(s) AS iso_week, CAST(date_trunc('week', s) AS DATE) AS week_start,
               concat('Q', quarter(s), '_', year(s)) AS label, count(*) AS lines
        FROM (SELECT contract_signing_date AS s FROM contracts) t GROUP BY ALL"""), dates="week_start")
def calendar_of_signing(spark, d):
    c = views.contracts(spark, d, "contract_signing_date")
    return c.select(*values.calendar_columns("contract_signing_date"),
                    values.quarter_label("contract_signing_date").alias("label")).groupBy(
        "year", "month", "year_month", "quarter", "iso_week", "week_start", "label").agg(F.count("*").alias("lines"))


@query(
    "day_differences", "P23",
    with_views("contracts", """
        SELECT date_diff('day', lot_end_date, contract_signing_date) AS days, count(*) AS lines
        FROM contracts GROUP BY 1"""))
def day_differences(spark, d):
    c = views.contracts(spark, d, "lot_end_date", "contract_signing_date")
    return c.groupBy(values.days_between("lot_end_date", "contract_signing_date").alias("days")).agg(
        F.count("*").alias("lines"))


@query(
    "kilograms_to_tonnes", "P24",
    with_views("contracts", """
        SELECT CASE WHEN unit = 'кг' THEN 'т' ELSE unit END AS unit, count(*) AS lines,
               sum(CASE WHEN unit = 'кг' THEN quantity / 1000 ELSE quantity END) AS quantity
        FROM contracts GROUP BY 1"""), doubles="quantity")
def kilograms_to_tonnes(spark, d):
    c = views.contracts(spark, d, "quantity", "unit")
    quantity, unit = values.mass_quantity("quantity", "unit")
    return c.select(quantity.alias("quantity"), unit.alias("unit")).groupBy("unit").agg(
        F.count("*").alias("lines"), F.sum("quantity").alias("quantity"))


@query(
    "product_types", "P27 P28",
    with_views("lots", """
        SELECT concat(upper(substring(w, 1, 1)), lower(substring(w, 2))) AS product_type, count(*) AS lines,
               sum(total_price) AS total
        FROM (SELECT split_part(metal_product, ' ', 1) AS w, total_price FROM lots) t
        WHERE lower(w) IN ('труба', 'лист', 'швеллер') GROUP BY 1"""), doubles="total:2")
def product_types(spark, d):
    lots = metal.rolled_metal(views.lots(spark, d, "metal_product", "total_price"), "metal_product",
                              ["труба", "лист", "швеллер"])
    return lots.groupBy(text.product_type("metal_product").alias("product_type")).agg(
        F.count("*").alias("lines"), F.sum("total_price").alias("total"))


@query(
    "numbers_and_names_formatted", "P29 X10",
    with_views("contracts", """
        SELECT contract_number, replace(replace(substring(concat('a/b:', counterparty_name, '*?'), 1, 12), '/', '_'), ':', '_') AS sheet,
               replace(format('{:,.2f}', quantity * 1000), ',', ' ') AS shown, count(*) AS lines
        FROM contracts GROUP BY ALL"""))
def numbers_and_names_formatted(spark, d):
    c = views.contracts(spark, d, "contract_number", "counterparty_name", "quantity")
    raw = F.concat(F.lit("a/b:"), "counterparty_name", F.lit("*?"))
    shown = F.replace(text.thousands(F.col("quantity") * 1000), F.lit(","), F.lit("."))
    return c.select("contract_number", text.safe_name(raw, 12).alias("sheet"), shown.alias("shown")).groupBy(
        "contract_number", "sheet", "shown").agg(F.count("*").alias("lines"))


@query(
    "arithmetic_errors", "P30",
    with_views("contracts", """
        SELECT row_key, quantity * unit_price AS expected_amount, product_amount,
               abs((quantity * unit_price - product_amount) / product_amount) AS gap
        FROM contracts WHERE abs((quantity * unit_price - product_amount) / product_amount) > 0.0151"""),
    doubles="expected_amount product_amount gap:6")
def arithmetic_errors(spark, d):
    c = views.contracts(spark, d, "row_key", "quantity", "unit_price", "product_amount")
    checked = cleaning.amount_check(c, "quantity", "unit_price", "product_amount", 0.0151)
    return checked.where("is_error").select("row_key", "expected_amount", "product_amount", "gap")


@query(
    "signed_before_lot_end", "P31",
    with_views("contracts", """
        SELECT row_key, lot_number, executor_dak, lot_end_date, contract_signing_date FROM contracts
        WHERE contract_signing_date < lot_end_date"""), dates="lot_end_date contract_signing_date")
def signed_before_lot_end(spark, d):
    return cleaning.signed_before_lot_end(
        views.contracts(spark, d, "row_key", "lot_number", "executor_dak", "lot_end_date", "contract_signing_date"))


@query(
    "price_per_tonne", "P25 P26 J13",
    metal.price_per_tonne_sql(with_views), doubles="price_per_tonne:3")
def price_per_tonne(spark, d):
    return metal.price_per_tonne_report(views.lots(spark, d, "row_key", "metal_product", "unit_price", "supplier_unit",
                                                   "unit"), views.catalogue(spark, d))


@query("metal_weights", "P26 X7", metal.weights_sql(with_views), doubles="tonnes_per_metre:6")
def metal_weights(spark, d):
    return metal.weights(views.catalogue(spark, d)).select("item_id", "metal_product", "tonnes_per_metre")

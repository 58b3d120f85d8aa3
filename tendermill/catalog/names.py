"""Product names: attributes, similarity and comparable offers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendermill.catalog.pricing import contracts_eur
from tendermill.catalog.registry import query, with_views
from tendermill.functions import attributes, text
from tendermill.operators import grouping
from tendermill.plans import comparables, gaps, metal
from tendermill.session import checkpointed
from tendermill.sources import views


@query("lots_mentioning_goods", "X1", with_views("lots", """
    SELECT DISTINCT good, lot_number FROM lots, (SELECT unnest(['Small', 'RING', 'bolt']) AS good) g
    WHERE contains(lower(good_name), lower(good))"""))
def lots_mentioning_goods(spark, d):
    return comparables.lots_mentioning(views.lots(spark, d, "good_name", "lot_number"), ["Small", "RING", "bolt"])


@query("normalised_names", "X2", with_views("catalogue", """
    SELECT DISTINCT metal_product, trim(translate(regexp_replace(lower(metal_product), '\\s+', ' ', 'g'), 'øф∅х×ё', 'ofoxxе'))
           AS normalised FROM catalogue"""))
def normalised_names(spark, d):
    names = views.catalogue(spark, d).select("metal_product").distinct()
    return names.withColumn("normalised", text.normalised_product("metal_product"))


@query("quick_features", "X3", with_views("catalogue", """
    WITH n AS (SELECT item_id, lower(metal_product) AS t FROM catalogue)
    SELECT item_id,
      CASE WHEN contains(t, 'труба') THEN 'труба' WHEN contains(t, 'швеллер') THEN 'швеллер'
           WHEN contains(t, 'арматура') THEN 'арматура' WHEN contains(t, 'уголок') THEN 'уголок'
           WHEN contains(t, 'лист') THEN 'лист' WHEN contains(t, 'круг') THEN 'круг' END AS type,
      CAST(NULLIF(regexp_extract(t, '[øф∅d]\\s*(\\d+)', 1), '') AS BIGINT) AS diameter,
      CASE WHEN contains(t, 'швеллер') THEN CAST(NULLIF(regexp_extract(t, '(\\d+)', 1), '') AS DOUBLE) END AS number,
      NULLIF(regexp_extract(t, '(гост\\s+[\\d-]+)', 1), '') AS standard,
      CASE WHEN contains(t, 'ст3') THEN 'ст3' WHEN contains(t, 'ст20') THEN 'ст20' END AS material FROM n"""),
    doubles="number")
def quick_features(spark, d):
    return views.catalogue(spark, d).withColumn("q", attributes.quick_features("metal_product")).select("item_id", "q.*")


@query("metal_dimensions", "X7", with_views("catalogue", """
    SELECT item_id,
      CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 20.0 + p_size * 2 WHEN 4 THEN 8.0 + 2 * (p_size % 8)
           WHEN 5 THEN 10.0 + p_size END::DOUBLE AS diameter,
      CASE CAST(p_partkey % 6 AS INT) WHEN 1 THEN 6000.0 WHEN 2 THEN 25.0 + p_size END::DOUBLE AS side_size,
      CASE CAST(p_partkey % 6 AS INT) WHEN 1 THEN 1500.0 WHEN 2 THEN 25.0 + p_size END::DOUBLE AS width,
      CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 2.0 + p_partkey % 5 WHEN 1 THEN 3.0 WHEN 2 THEN 3.0 + p_partkey % 4 END::DOUBLE
      AS thickness,
      CASE CAST(p_partkey % 6 AS INT) WHEN 3 THEN CAST(10 + 2 * (p_size % 10) AS VARCHAR) END AS mark_number
    FROM catalogue JOIN part ON p_partkey = item_id"""), doubles="diameter side_size width thickness")
def metal_dimensions(spark, d):
    return metal.with_dimensions(views.catalogue(spark, d)).select(
        "item_id", "diameter", "side_size", "width", "thickness", "mark_number")


@query("catalogue_parameters", "X8", with_views("catalogue", """
    SELECT item_id, CASE CAST(item_id % 6 AS INT) WHEN 0 THEN 'труба' WHEN 1 THEN 'лист' WHEN 2 THEN 'уголок' WHEN 3 THEN 'швеллер'
           WHEN 4 THEN 'арматура' ELSE 'круг' END AS shape,
      CAST(NULLIF(regexp_extract(lower(metal_product), '(\\d+)х(\\d+)', 1), '') AS DOUBLE) AS outer_diameter,
      CAST(NULLIF(regexp_extract(lower(metal_product), '(\\d+)х(\\d+)', 2), '') AS DOUBLE) AS wall_thickness FROM catalogue"""),
    doubles="outer_diameter wall_thickness")
def catalogue_parameters(spark, d):
    return views.catalogue(spark, d).withColumn("m", attributes.metal_parameters("metal_product")).select("item_id", "m.*")


@query("shape_attributes", "X9", with_views("catalogue", """
    WITH n AS (SELECT item_id, metal_product, CAST(item_id % 6 AS INT) AS k, split_part(metal_product, ' ', 2) AS size FROM catalogue)
    SELECT item_id, metal_product,
      CASE k WHEN 0 THEN 'труба' WHEN 1 THEN 'лист' WHEN 2 THEN 'уголок' WHEN 3 THEN 'швеллер' WHEN 4 THEN 'арматура' END AS shape,
      CASE WHEN k = 4 THEN 'А500' END AS class, CAST(NULL AS VARCHAR) AS coating, CASE WHEN k = 4 THEN size END AS diameter,
      CAST(NULL AS VARCHAR) AS inches, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS length,
      CASE WHEN k IN (0, 2) THEN replace(size, 'х', 'x') END AS size, CAST(NULL AS VARCHAR) AS standard, CAST(NULL AS VARCHAR) AS steel,
      CAST(NULL AS VARCHAR) AS thickness, CASE WHEN k = 3 THEN size END AS type_size,
      CASE WHEN k = 3 THEN 'с параллельными полками' END AS flange FROM n"""))
def shape_attributes(spark, d):
    return views.catalogue(spark, d).select("item_id", "metal_product", *attributes.shape_attributes("metal_product"))


@query("categories_and_types", "X4", with_views("catalogue", """
    SELECT metal_product, CASE CAST(any_value(item_id) % 6 AS INT) WHEN 0 THEN 'трубы_фитинги' WHEN 5 THEN 'расходные_материалы'
           ELSE 'металлопрокат' END AS category,
           CASE CAST(any_value(item_id) % 6 AS INT) WHEN 0 THEN 'труба' WHEN 1 THEN 'лист' WHEN 2 THEN 'уголок'
           WHEN 3 THEN 'швеллер' WHEN 4 THEN 'арматура' ELSE 'круг' END AS type FROM catalogue GROUP BY metal_product"""))
def categories_and_types(spark, d):
    names = views.catalogue(spark, d).select("metal_product").distinct()
    return names.withColumn("k", attributes.category_and_type("metal_product")).select("metal_product", "k.*")


@query("name_dimensions", "X5", with_views("catalogue", """
    WITH n AS (SELECT DISTINCT metal_product, split_part(metal_product, ' ', 1) AS word, split_part(metal_product, ' ', 2) AS size FROM catalogue)
    SELECT metal_product,
      CASE WHEN word = 'Труба' THEN split_part(size, 'х', 1)::DOUBLE END AS diameter,
      CASE WHEN word = 'Труба' THEN split_part(size, 'х', 2)::DOUBLE END AS thickness,
      CASE WHEN word = 'Уголок' THEN split_part(size, 'х', 1)::DOUBLE END AS length,
      CASE WHEN word = 'Уголок' THEN split_part(size, 'х', 2)::DOUBLE END AS width,
      CASE WHEN word = 'Уголок' THEN split_part(size, 'х', 3)::DOUBLE END AS height,
      CASE word WHEN 'Уголок' THEN split_part(size, 'х', 1)::DOUBLE WHEN 'Швеллер' THEN replace(size, 'П', '')::DOUBLE END AS number
    FROM n"""), doubles="diameter thickness length width height number")
def name_dimensions(spark, d):
    names = views.catalogue(spark, d).select("metal_product").distinct()
    return names.withColumn("m", attributes.dimensions("metal_product")).select("metal_product", "m.*")


@query("name_features", "X6", with_views("catalogue", """
    WITH n AS (SELECT DISTINCT metal_product AS name, split_part(metal_product, ' ', 1) AS word, split_part(metal_product, ' ', 2) AS size
               FROM catalogue)
    SELECT name, CASE word WHEN 'Труба' THEN 'ст20' WHEN 'Лист' THEN 'ст3' WHEN 'Круг' THEN 'ст45' END AS material,
      CASE WHEN word = 'Труба' THEN 'гост 8732-78' END AS standard, CAST(NULL AS VARCHAR) AS model, CAST(NULL AS VARCHAR) AS brand,
      '' AS specifications,
      CASE word WHEN 'Труба' THEN 'weight=' || split_part(size, 'х', 2) || '.0;temperature=78.0'
           WHEN 'Арматура' THEN 'current=' || size || '.0;temperature=500.0'
           WHEN 'Лист' THEN 'temperature=' || size || '.0' WHEN 'Круг' THEN 'temperature=' || size || '.0' ELSE '' END AS measurements
    FROM n"""))
def name_features(spark, d):
    features = comparables.named_features(views.catalogue(spark, d), "metal_product")
    return features.select(
        "name", "f.material", "f.standard", "f.model", "f.brand", F.array_join("f.specifications", ";").alias("specifications"),
        F.array_join(F.transform(F.map_entries("f.measurements"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(
            F.transform(e["value"], lambda v: v.cast("string")), ","))), ";").alias("measurements"))


_PAIRS = """
    n AS (SELECT DISTINCT metal_product AS name, split_part(lower(metal_product), ' ', 1) AS word,
                 regexp_extract(metal_product, '(\\d+)', 1) AS lead FROM catalogue),
    p AS (SELECT a.name AS name1, b.name AS name2 FROM n a JOIN n b ON a.word = b.word AND a.lead = b.lead AND a.name < b.name),
    t AS (SELECT *, replace(lower(name1), 'х', 'x') AS t1, replace(lower(name2), 'х', 'x') AS t2 FROM p)"""


@query("levenshtein_and_tokens", "M1 M3 J7", with_views("catalogue", f"""WITH {_PAIRS}
    SELECT name1, name2, 1.0 - CAST(levenshtein(t1, t2) AS DOUBLE) / greatest(length(t1), length(t2)) AS levenshtein,
           CAST(len(list_intersect(list_distinct(string_split(t1, ' ')), list_distinct(string_split(t2, ' ')))) AS DOUBLE)
           / len(list_distinct(list_concat(string_split(t1, ' '), string_split(t2, ' ')))) AS token FROM t"""),
    doubles="levenshtein:6 token:6")
def levenshtein_and_tokens(spark, d):
    return comparables.text_scores(comparables.text_pairs(views.catalogue(spark, d), "metal_product"))


@query("quick_name_scores", "M2 M4 M5")
def quick_name_scores(spark, d):
    scores = comparables.quick_scores(comparables.text_pairs(views.catalogue(spark, d), "metal_product"))
    return scores.select("name1", "name2", "levenshtein", "token", "jaro", "jaro_winkler", "blocks", "score")


# The generated names have six shapes. At 0.85 pipes of one wall pair up to a diameter 5 apart, angles of one thickness where the sides
# agree within 5 % or 1, rounds less than 2 apart; no sheet, channel or bar does, since their sizes are critical. At 0.75 angles
# pair up to sides 10 apart. The text ratio settles none of these pairs: the other parts leave it no say.
_SHAPES = """
    {0} AS (SELECT DISTINCT metal_product AS name, split_part(metal_product, ' ', 1) AS word, split_part(metal_product, ' ', 2) AS size FROM {1}),
    shapes AS (SELECT name, word,
        CASE word WHEN 'Труба' THEN 'трубы_фитинги' WHEN 'Круг' THEN 'расходные_материалы' ELSE 'металлопрокат' END AS category, lower(word) AS type,
        CASE WHEN word IN ('Труба', 'Уголок') THEN split_part(size, 'х', 1)::DOUBLE WHEN word = 'Круг' THEN size::DOUBLE END AS a,
        CASE word WHEN 'Труба' THEN split_part(size, 'х', 2)::DOUBLE WHEN 'Уголок' THEN split_part(size, 'х', 3)::DOUBLE END AS b FROM {0})"""
_ALIKE = """CASE x.word WHEN 'Труба' THEN x.b = y.b AND abs(x.a - y.a) < 5 WHEN 'Круг' THEN abs(x.a - y.a) < 2
    WHEN 'Уголок' THEN x.b = y.b AND (abs(x.a - y.a) <= (x.a + y.a) / 2 * 0.05 OR abs(x.a - y.a) <= 1) ELSE false END"""
_OFFERS = f"""WITH {_SHAPES.format('n', 'contracts_eur')},
    related AS (SELECT x.category, x.type, x.name AS name1, y.name AS name2 FROM shapes x JOIN shapes y ON x.word = y.word AND (x.name = y.name OR {_ALIKE})),
    offers AS (SELECT metal_product AS name, counterparty_name AS supplier,
        CAST(sum(CAST(unit_price_eur AS DECIMAL(28, 12))) AS DOUBLE) / count(*) AS price FROM contracts_eur GROUP BY 1, 2),
    met AS (SELECT category, type, name1, name2, o.supplier AS supplier1, p.supplier AS supplier2, o.price AS price1, p.price AS price2,
        CASE WHEN o.price > 0 THEN abs(p.price - o.price) / o.price * 100 ELSE 0 END AS gap_pct
        FROM related JOIN offers o ON o.name = name1 JOIN offers p ON p.name = name2 AND p.supplier <> o.supplier)"""


@query("similar_names", "M6 M7")
def similar_names(spark, d):
    return comparables.similar_names(comparables.named_features(views.catalogue(spark, d), "metal_product"))


@query("similar_name_pairs", "M6 J7", with_views("catalogue", f"""WITH {_SHAPES.format('n', 'catalogue')}
    SELECT x.category, x.type, x.name AS name1, y.name AS name2 FROM shapes x JOIN shapes y ON x.word = y.word AND x.name < y.name AND {_ALIKE}"""))
def similar_name_pairs(spark, d):
    return similar_names(spark, d).select("category", "type", "name1", "name2")


@query("similar_name_classes", "M9", with_views("catalogue", f"""WITH {_SHAPES.format('n', 'catalogue')}
    SELECT x.category, x.type, x.name AS class1, y.name AS class2, CAST(1 AS BIGINT) AS names1, CAST(1 AS BIGINT) AS names2, CAST(1 AS BIGINT) AS pairs
    FROM shapes x JOIN shapes y ON x.word = y.word AND x.name < y.name AND CASE WHEN x.word = 'Уголок' THEN x.b = y.b AND abs(x.a - y.a) <= 10 ELSE {_ALIKE} END"""))
def similar_name_classes(spark, d):
    return comparables.similar_classes(comparables.named_features(views.catalogue(spark, d), "metal_product"))[0]


@query("dearest_in_block", "T6", with_views("contracts_eur", """
    SELECT row_key, word, rank FROM (SELECT row_key, split_part(metal_product, ' ', 1) AS word, row_number() OVER (
        PARTITION BY split_part(metal_product, ' ', 1) ORDER BY unit_price_eur DESC, row_key) AS rank FROM contracts_eur) t
    WHERE rank <= 500"""))
def dearest_in_block(spark, d):
    c = contracts_eur(spark, d, "row_key", "metal_product").withColumn("word", text.first_word("metal_product"))
    return grouping.top_in_group(c, ["word"], 500, F.desc("unit_price_eur"), "row_key").select("row_key", "word", "rank")


def _matches(spark, d):
    return comparables.comparable_offers(contracts_eur(spark, d, "metal_product", "counterparty_name"), name="metal_product")


def _statistics(spark, d):
    return comparables.match_statistics(contracts_eur(spark, d, "metal_product", "counterparty_name"), name="metal_product")


@query("comparable_offers", "M8 J7")
def comparable_offers(spark, d):
    return _matches(spark, d)


@query("critical_price_gaps", "M10", with_views("contracts_eur", f"""{_OFFERS}
    SELECT category, type, name1, name2, count(*) AS matches, CAST(count_if(gap_pct > 30) AS BIGINT) AS critical FROM met GROUP BY ALL HAVING critical > 0"""))
def critical_price_gaps(spark, d):
    return comparables.critical_gaps(_statistics(spark, d))


def _per_offer(spark, d):
    c = contracts_eur(spark, d, "metal_product", "counterparty_name")
    return checkpointed(comparables.related_names(c, 0.85, "metal_product")), comparables.offers(c, "metal_product")


@query("largest_gaps_of_names", "M10 M8", with_views("contracts_eur", f"""{_OFFERS}
    SELECT category, type, name1, name2, supplier1, supplier2, price1, price2, gap_pct, place FROM (SELECT *, row_number() OVER (
        PARTITION BY name1, name2 ORDER BY gap_pct DESC, supplier1, supplier2) AS place FROM met WHERE gap_pct > 30) t WHERE place <= 3"""),
    doubles="price1 price2 gap_pct")
def largest_gaps_of_names(spark, d):
    return gaps.largest_of_names(*_per_offer(spark, d))


@query("median_gap_by_category", "A55", with_views("contracts_eur", f"""{_OFFERS}
    SELECT category, count(*) AS matches, median(gap_pct) AS median_gap FROM met GROUP BY 1"""), doubles="median_gap:6")
def median_gap_by_category(spark, d):
    return gaps.median_gaps(*_per_offer(spark, d))


@query("matches_by_category", "A55", with_views("contracts_eur", f"""{_OFFERS}
    SELECT category, count(*) AS matches, avg(gap_pct) AS mean_gap,
           CASE WHEN count_if(gap_pct <= 10) * 2 >= count(*) THEN '0-10' WHEN count_if(gap_pct <= 20) * 2 >= count(*) THEN '10-20'
                WHEN count_if(gap_pct <= 30) * 2 >= count(*) THEN '20-30' ELSE '>30' END AS median_gap,
           sum(abs(price2 - price1)) AS value, avg(abs(price2 - price1)) AS mean_value, max(gap_pct) AS max_gap FROM met GROUP BY 1"""),
    doubles="mean_gap:6 value:2 mean_value:4 max_gap:4")
def matches_by_category(spark, d):
    return comparables.category_report(_statistics(spark, d), _matches(spark, d))


@query("match_supplier_ratings", "A55", with_views("contracts_eur", f"""{_OFFERS},
    s AS (SELECT supplier1 AS supplier, CASE WHEN price2 > price1 THEN 'cheaper' ELSE 'expensive' END AS side, gap_pct FROM met WHERE price1 <> price2)
    SELECT supplier, count(*) AS matches, avg(gap_pct) AS mean_gap, side FROM s GROUP BY 1, 4"""), doubles="mean_gap")
def match_supplier_ratings(spark, d):
    return comparables.supplier_ratings(_statistics(spark, d))


@query("match_gap_buckets", "A55", with_views("contracts_eur", f"""{_OFFERS}
    SELECT CASE WHEN gap_pct <= 10 THEN '0-10' WHEN gap_pct <= 20 THEN '10-20' WHEN gap_pct <= 30 THEN '20-30' ELSE '>30' END AS bucket,
           count(*) AS matches FROM met GROUP BY 1"""))
def match_gap_buckets(spark, d):
    return comparables.gap_buckets(_statistics(spark, d))


@query("largest_match_gaps", "A55 T2")
def largest_match_gaps(spark, d):
    return comparables.largest_gaps(_matches(spark, d))


@query("matches_of_target", "M11")
def matches_of_target(spark, d):
    found = comparables.matches_of("Труба 42х4 ГОСТ 8732-78 Ст20", views.catalogue(spark, d), "metal_product", 0.6)
    described = comparables.compared(found.drop("penalty", "ratio", "similarity"))
    return described.select(
        "name1", "name2", "similarity", F.array_join(F.array_sort(F.map_keys("matches")), ",").alias("equal"),
        F.array_join(F.array_sort(F.map_keys("differences")), ",").alias("differing")).orderBy(F.desc("similarity"), "name2")

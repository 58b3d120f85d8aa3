"""Rolled metal: catalogue dimensions, mass per metre and price per tonne."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendermill.functions import attributes, text

# Kilograms per metre of channels by mark, steel density, the constant pi used.
CHANNEL_KG_PER_METRE = {
    "5": 4.84, "6.5": 5.9, "8": 7.05, "10": 8.59, "12": 10.4, "14": 12.3, "16": 14.2, "18": 16.3, "20": 18.4, "22": 21.0,
    "24": 24.0, "27": 27.7, "30": 31.8, "40": 48.3,
}
STEEL_KG_PER_M3 = 7850
PI = 3.1415

# Factors that bring a price to one tonne.
PER_TONNE = {"кг": 1000.0, "kg": 1000.0, "г": 1000000.0, "gram": 1000000.0}


def rolled_metal(df: DataFrame, name: str, words: list[str]) -> DataFrame:
    """Rows whose first word is one of ``words``."""
    return df.where(F.lower(text.first_word(name)).isin(words))


def with_dimensions(df: DataFrame, name: str = "metal_product") -> DataFrame:
    dims = attributes.metal_dimensions(name)
    return df.withColumn("_dims", dims).select("*", "_dims.*").drop("_dims")


def mass_per_metre(name: Column, mark: Column, diameter: Column, side: Column, width: Column, thickness: Column) -> Column:
    """Tonnes per metre from the section; 0 for a shape without a formula."""
    kg = F.create_map(*(F.lit(x) for x in chain.from_iterable(CHANNEL_KG_PER_METRE.items())))[mark]
    d, s, w, t = (c / 1000 for c in (diameter, side, width, thickness))
    inner = d - 2 * t
    area = (
        F.when(name.contains("лист"), w * t)
        .when(name.contains("труба"), PI * (d * d - inner * inner) / 4)
        .when(name.contains("уголок"), s * t + w * t - t * t)
        .when(name.contains("полоса"), w * t)
        .otherwise(F.lit(0.0))
    )
    return F.coalesce(kg / 1000, area * STEEL_KG_PER_M3 / 1000)


def weights(catalogue: DataFrame, name: str = "metal_product") -> DataFrame:
    sized = with_dimensions(catalogue, name)
    cols = [F.lower(F.col(name)), *(F.col(c) for c in ("mark_number", "diameter", "side_size", "width", "thickness"))]
    return sized.withColumn("tonnes_per_metre", mass_per_metre(*cols))


def catalogue_lookup(df: DataFrame, catalogue: DataFrame, name: str, values: list[str]) -> DataFrame:
    """Left join on the trimmed lower-case name; the first catalogue row of a name gives the values.

    The catalogue is cut to one row per name first. Whether it is small enough to be
    broadcast is decided at run time from its measured size.
    """
    key = F.lower(F.trim(F.col(name)))
    first = catalogue.groupBy(F.lower(F.trim(F.col("metal_product"))).alias("_key")).agg(
        F.min_by(F.struct(*values), F.struct("metal_product", *values)).alias("_found")
    )
    joined = df.withColumn("_key", key).join(first, "_key", "left")
    return joined.select(*df.columns, *(F.col(f"_found.{v}").alias(v) for v in values))


def price_to_tonne(price: Column, unit: Column, tonnes_per_metre: Column) -> Column:
    """Price of a tonne from the price of a unit; a metre needs a mass, other units keep the price."""
    u = F.lower(F.trim(unit))
    result = F.when(u.isNull() | (price <= 0), F.lit(None).cast("double"))
    for name, factor in PER_TONNE.items():
        result = result.when(u == name, price * factor)
    return result.when(u.isin("м", "метр"), F.try_divide(price, tonnes_per_metre)).otherwise(price)


def price_per_tonne(df: DataFrame, catalogue: DataFrame, price: str = "unit_price", name: str = "metal_product") -> DataFrame:
    # the mass follows from the name alone, so each spelling is read once
    spellings = catalogue.groupBy(F.lower(F.trim("metal_product")).alias("_key")).agg(
        F.min("metal_product").alias("metal_product"))
    with_mass = catalogue_lookup(df, weights(spellings), name, ["tonnes_per_metre"])
    return with_mass.withColumn(
        "price_per_tonne",
        price_to_tonne(F.col(price), F.coalesce("supplier_unit", "unit"), F.col("tonnes_per_metre")),
    )


def price_per_tonne_report(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    return price_per_tonne(df, catalogue).select("row_key", "metal_product", "supplier_unit", "price_per_tonne")


_MASS_SQL = (
    "CASE CAST(p_partkey % 6 AS INT) "
    "WHEN 0 THEN 3.1415 * (pow((20 + p_size * 2) / 1000.0, 2) "
    "     - pow((20 + p_size * 2 - 2 * (2 + p_partkey % 5)) / 1000.0, 2)) / 4 * 7850 / 1000 "
    "WHEN 1 THEN 1.5 * 0.003 * 7850 / 1000 "
    "WHEN 2 THEN (2 * (25 + p_size) * (3 + p_partkey % 4) - pow(3 + p_partkey % 4, 2)) / 1000000.0 * 7850 / 1000 "
    "WHEN 3 THEN coalesce(CASE 10 + 2 * (p_size % 10) WHEN 10 THEN 8.59 WHEN 12 THEN 10.4 WHEN 14 THEN 12.3 WHEN 16 THEN 14.2 "
    "     WHEN 18 THEN 16.3 WHEN 20 THEN 18.4 WHEN 22 THEN 21.0 WHEN 24 THEN 24.0 END / 1000, 0) "
    "ELSE 0 END"
)


def weights_sql(with_views) -> str:
    return with_views(
        "catalogue",
        f"SELECT item_id, metal_product, CAST({_MASS_SQL} AS DOUBLE) AS tonnes_per_metre "
        "FROM catalogue JOIN part ON p_partkey = item_id",
    )


def price_per_tonne_sql(with_views) -> str:
    return with_views(
        "lots catalogue",
        f"""WITH mass AS (SELECT DISTINCT metal_product, round(CAST({_MASS_SQL} AS DOUBLE), 12) AS m
                          FROM catalogue JOIN part ON p_partkey = item_id)
        SELECT row_key, lots.metal_product, supplier_unit,
               CASE supplier_unit WHEN 'кг' THEN unit_price * 1000
                    WHEN 'м' THEN CASE WHEN m > 0 THEN unit_price / m END ELSE unit_price END AS price_per_tonne
        FROM lots LEFT JOIN mass ON lots.metal_product = mass.metal_product""",
    )

"""Cleaning steps for lots, contracts and stock. Each is ``DataFrame -> DataFrame`` for ``df.transform``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendermill.functions import money, text, values
from tendermill.operators.quantiles import exact_quantiles

UNSPECIFIED = "Не указано"


def numbers(df: DataFrame, columns: Iterable[str], on_bad: str = "null") -> DataFrame:
    """Coerce to double; bad values stay null, become ``zero`` or lose the row (``drop``)."""
    columns = list(columns)
    out = df.withColumns({c: values.parsed_number(c) for c in columns})
    if on_bad == "zero":
        return out.fillna(0.0, subset=columns)
    if on_bad == "drop":
        return out.na.drop(subset=columns)
    return out


def local_numbers(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: values.parsed_local_number(c) for c in columns})


def dates(df: DataFrame, columns: Iterable[str], *formats: str) -> DataFrame:
    return df.withColumns({c: values.parsed_date(c, *formats) for c in columns})


def filled(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(defaults))


def median_filled(df: DataFrame, column: str) -> DataFrame:
    """Nulls take the exact median of the column."""
    median = exact_quantiles(df, [], column, {"m": 0.5}).select("m").scalar()
    return df.withColumn(column, F.coalesce(F.col(column), median))


def complete(df: DataFrame, keys: Iterable[str], positive: Iterable[str] = (), non_zero: Iterable[str] = ()) -> DataFrame:
    """Rows with all keys present, the ``positive`` columns above and ``non_zero`` columns off zero."""
    out = df.na.drop(subset=list(keys))
    for c in positive:
        out = out.where(F.col(c) > 0)
    for c in non_zero:
        out = out.where(F.col(c) != 0)
    return out


def unique_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def unique_rows_in_lots(df: DataFrame) -> DataFrame:
    """Full-row duplicates inside a lot go, and so do rows without a lot."""
    return df.where(F.col("lot_number").isNotNull()).distinct()


def unique_by(df: DataFrame, columns: Iterable[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` for each value of ``columns``.

    ``min_by`` keeps one partial result per key on the map side, so copies of one
    row never meet in a single task.
    """
    columns = list(columns)
    rest = [c for c in df.columns if c not in columns]
    picked = df.groupBy(*columns).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_kept"))
    return picked.select(*columns, *(F.col(f"_kept.{c}").alias(c) for c in rest)).select(*df.columns)


def first_in_lot(df: DataFrame, *order: str) -> DataFrame:
    """One row per lot: the first in the stated order."""
    rest = [c for c in df.columns if c != "lot_number"]
    picked = df.groupBy("lot_number").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    )
    return picked.select("lot_number", *(F.col(f"_first.{c}").alias(c) for c in rest)).select(*df.columns)


def maintained_lots(df: DataFrame) -> DataFrame:
    """Table upkeep: null numbers to zero, zero quantities out, duplicates out, person names trimmed."""
    numeric = ["good_count", "supplier_qty", "unit_price", "total_price"]
    return (
        df.fillna(0.0, subset=numeric)
        .where((F.col("good_count") != 0) & (F.col("supplier_qty") != 0))
        .withColumn("actor_name", text.before_bracket("actor_name"))
        .distinct()
    )


def clean_lots(df: DataFrame) -> DataFrame:
    """What an analysis of lots starts from: keys present, prices positive, suppliers named canonically."""
    return (
        complete(df, ["lot_number", "discipline", "winner_name", "currency"], positive=["unit_price", "total_price"])
        .withColumn("winner_name", text.canonical_supplier("winner_name"))
        .withColumn("actor_name", text.before_bracket("actor_name"))
        .distinct()
    )


def clean_contracts(df: DataFrame) -> DataFrame:
    """What an analysis of contracts starts from: texts filled, price gaps filled by the median."""
    texts = [c for c in ("discipline", "executor_dak", "delivery_conditions", "payment_conditions") if c in df.columns]
    out = df.fillna(UNSPECIFIED, subset=texts).fillna(0.0, subset=["additional_expenses"])
    out = complete(out, ["lot_number", "contract_signing_date", "counterparty_name", "product_name"])
    out = median_filled(out, "unit_price")
    return out.where((F.col("quantity") > 0) & (F.col("unit_price") > 0)).withColumn(
        "counterparty_name", text.canonical_supplier("counterparty_name")
    )


def in_eur(df: DataFrame, columns: Iterable[tuple[str, str, str]], unknown: str = "drop",
           rates: Mapping[str, float] | None = None) -> DataFrame:
    """Convert ``(amount, currency, result)`` columns by the rate table.

    ``unknown`` says what a currency without a rate does: ``drop`` the row, count
    the rate as ``one``, or leave the result ``null``.
    """
    if unknown not in ("drop", "one", "null"):
        raise ValueError(f"unknown must be drop, one or null, not {unknown!r}")
    columns = list(columns)
    table = money.rate_table(df.sparkSession, None if rates is None else dict(rates))
    held = {currency: f"_rate_{currency}" for _, currency, _ in columns}
    out = df
    # joined once per currency column; a looked-up expression would be repeated in every filter on the results
    for c, h in held.items():
        side = table.select(F.col("code").alias(f"_code_{c}"), F.col("rate").alias(h))
        out = out.join(side, F.col(c) == F.col(f"_code_{c}"), "inner" if unknown == "drop" else "left").drop(f"_code_{c}")
    if unknown == "one":
        out = out.fillna(1.0, subset=list(held.values()))
    return out.withColumns({r: F.col(a) * F.col(held[c]) for a, c, r in columns}).drop(*held.values())


def currencies_without_rate(df: DataFrame, currency: str) -> DataFrame:
    return df.where(money.rate_of(currency).isNull()).select(currency).distinct()


def amount_check(df: DataFrame, quantity: str, price: str, amount: str, tolerance: float = 0.01) -> DataFrame:
    """Compare quantity times price with the stated amount; flag a gap above the tolerance."""
    expected = F.col(quantity) * F.col(price)
    gap = F.abs(F.try_divide(expected - F.col(amount), F.col(amount)))
    return df.withColumns({"expected_amount": expected, "gap": gap, "is_error": F.coalesce(gap > tolerance, F.lit(False))})


def signed_before_lot_end(df: DataFrame) -> DataFrame:
    return df.where(F.col("contract_signing_date") < F.col("lot_end_date"))


def between_dates(df: DataFrame, column: str, start, end) -> DataFrame:
    """Rows in the inclusive range; the bare column lets the scan skip row groups."""
    if start > end:
        raise ValueError(f"start {start} is after end {end}")
    return df.where(F.col(column).between(F.lit(start), F.lit(end)))


def date_bounds(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min_date"), F.max(column).alias("max_date"))


def is_empty_range(df: DataFrame) -> bool:
    """Probe before a load: reads until the first row, not the whole range."""
    return df.isEmpty()


def facets(df: DataFrame, chosen: Mapping[str, Iterable]) -> DataFrame:
    """Rows whose value is among the chosen ones in every facet; an empty choice does not restrict."""
    out = df
    for column, allowed in chosen.items():
        allowed = list(allowed)
        if allowed:
            out = out.where(F.col(column).isin(allowed))
    return out


def facet_values(df: DataFrame, column: str, containing: str | None = None) -> DataFrame:
    """Sorted distinct values of a facet, optionally those containing a text in any case."""
    out = df.where(F.col(column).isNotNull()).select(column).distinct()
    if containing:
        out = out.where(F.lower(F.col(column)).contains(containing.lower()))
    return out.orderBy(column)


def ranked_once(df: DataFrame, partition: Iterable[str], *order) -> DataFrame:
    """``rn`` inside each partition in the stated order."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))

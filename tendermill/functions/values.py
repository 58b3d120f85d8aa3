"""Dates, numbers and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parsed_date(c: Column | str, *formats: str) -> Column:
    """Date in the first format that fits, null when none does."""
    formats = formats or ("dd.MM.yyyy", "yyyy-MM-dd")
    return F.coalesce(*(F.to_date(F.try_to_timestamp(_col(c), F.lit(f))) for f in formats))


def parsed_number(c: Column | str) -> Column:
    """Number or null."""
    return _col(c).try_cast("double")


def parsed_local_number(c: Column | str) -> Column:
    """Number written with spaces between thousands and a decimal comma."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"[\s ]", ""), ",", ".").try_cast("double")


def calendar_columns(date: Column | str, prefix: str = "") -> list[Column]:
    d = _col(date)
    return [
        F.year(d).alias(f"{prefix}year"),
        F.month(d).alias(f"{prefix}month"),
        F.date_format(d, "yyyy-MM").alias(f"{prefix}year_month"),
        F.quarter(d).alias(f"{prefix}quarter"),
        F.weekofyear(d).alias(f"{prefix}iso_week"),
        week_start(d).alias(f"{prefix}week_start"),
    ]


def month_start(date: Column | str) -> Column:
    return F.trunc(_col(date), "month")


def week_start(date: Column | str) -> Column:
    """Monday of the week."""
    return F.trunc(_col(date), "week")


def quarter_label(date: Column | str) -> Column:
    return F.concat(F.lit("Q"), F.quarter(_col(date)), F.lit("_"), F.year(_col(date)))


def days_between(start: Column | str, end: Column | str) -> Column:
    return F.datediff(_col(end), _col(start))


def mass_quantity(quantity: Column | str, unit: Column | str) -> tuple[Column, Column]:
    """Quantity and unit with kilograms turned into tonnes."""
    is_kg = _col(unit) == "кг"
    return (
        F.when(is_kg, _col(quantity) / 1000).otherwise(_col(quantity)),
        F.when(is_kg, F.lit("т")).otherwise(_col(unit)),
    )

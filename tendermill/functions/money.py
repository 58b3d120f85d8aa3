"""Currency rates and conversion columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rates to EUR.
EUR_RATES = {
    "AED": 0.23,
    "CNY": 0.13,
    "EUR": 1.0,
    "GBP": 1.13,
    "KRW": 0.00077,
    "KZT": 0.002,
    "RUB": 0.011,
    "USD": 0.83,
    "UZS": 0.000071,
    "JPY": 0.0073,
    "SGD": 0.61,
}

# The older table, rates to USD.
USD_RATES = {
    "AED": 0.27,
    "CNY": 0.14,
    "EUR": 1.2,
    "GBP": 1.32,
    "KRW": 0.00076,
    "KZT": 0.0021,
    "RUB": 0.0113,
    "USD": 1.0,
    "UZS": 0.000078,
    "JPY": 0.0069,
    "SGD": 0.78,
}


def rate_of(currency: Column | str, rates: dict[str, float] | None = None) -> Column:
    """Rate of a currency code, null when the code has none.

    A literal map keeps the lookup inside code generation: the table is a handful
    of codes, so no join (and no broadcast) is needed.
    """
    rates = EUR_RATES if rates is None else rates
    literal = F.create_map(*(F.lit(x) for x in chain.from_iterable(sorted(rates.items()))))
    return literal[F.col(currency) if isinstance(currency, str) else currency]


def updated_rates(changes: dict[str, float], rates: dict[str, float] | None = None) -> dict[str, float]:
    return {**(EUR_RATES if rates is None else rates), **changes}


def rate_table(spark: SparkSession, rates: dict[str, float] | None = None) -> DataFrame:
    """The rates as a local relation: its true size is known to the planner, a handful of rows."""
    rates = EUR_RATES if rates is None else rates
    rows = ", ".join(f"('{code}', {float(rate)!r}D)" for code, rate in rates.items())
    return spark.sql(f"SELECT code, rate FROM VALUES {rows} AS t(code, rate)")

"""Registry of queries and the SQL that states the same result.

Doubles are rounded on both sides to the stated digits, because sums run in
different orders. A small constant is added first so that a value lying on a
rounding tie falls to the same side in both engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendermill.functions.money import EUR_RATES, USD_RATES
from tendermill.sources import views


@dataclass(frozen=True)
class Query:
    name: str
    items: tuple[str, ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: dict[str, int] = field(default_factory=dict)
    dates: tuple[str, ...] = ()

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return _comparable(self.build(spark, sf_dir), self.doubles)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        swaps = [f"round({c} + {_nudge(d)}, {d}) AS {c}" for c, d in self.doubles.items()]
        swaps += [f"CAST({c} AS VARCHAR) AS {c}" for c in self.dates]
        if not swaps:
            return self.sql
        return f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({self.sql}) AS result"


REGISTRY: dict[str, Query] = {}


def _nudge(digits: int) -> str:
    return f"{3.3 * 10.0 ** (-digits - 4):.1e}"


def _comparable(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Longs for integers, text for dates, rounded doubles."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            d = digits.get(f.name, 4)
            c = F.round(c + F.lit(float(_nudge(d))), d)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, items: str, sql: str | None = None, doubles: str = "", dates: str = ""):
    """Register ``build(spark, sf_dir)``. ``doubles`` lists ``column[:digits]``, four digits by default."""
    digits = {}
    for spec in doubles.split():
        column, _, d = spec.partition(":")
        digits[column] = int(d or 4)

    def register(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, tuple(items.split()), build, sql, digits, tuple(dates.split()))
        return build

    return register


def rate_sql(column: str, rates: dict[str, float] = EUR_RATES) -> str:
    cases = " ".join(f"WHEN '{code}' THEN CAST({rate!r} AS DOUBLE)" for code, rate in rates.items())
    return f"(CASE {column} {cases} END)"


def usd_rate_sql(column: str) -> str:
    return rate_sql(column, USD_RATES)


def with_views(names: str, body: str) -> str:
    """``body`` after common table expressions for the mapped views it names."""
    derived = {
        "lots_eur": ("lots", f"SELECT *, total_price * {rate_sql('currency')} AS total_price_eur, "
                     f"unit_price * {rate_sql('currency')} AS unit_price_eur "
                     f"FROM lots WHERE {rate_sql('currency')} IS NOT NULL"),
        "contracts_eur": ("contracts", f"SELECT *, total_contract_amount * {rate_sql('contract_currency')} "
                          f"AS total_contract_amount_eur, unit_price * {rate_sql('contract_currency')} AS unit_price_eur "
                          f"FROM contracts WHERE {rate_sql('contract_currency')} IS NOT NULL"),
    }
    ctes: dict[str, str] = {}
    for name in names.split():
        base, text = derived.get(name, (name, None))
        ctes.setdefault(base, views.view_sql(base))
        if text:
            ctes[name] = text
    head = ", ".join(f"{n} AS ({t})" for n, t in ctes.items())
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"

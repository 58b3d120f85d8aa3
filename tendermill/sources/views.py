"""Procurement tables mapped from the star schema of the given Parquet files.

Each column is one expression that Spark and DuckDB read alike, so the same text
builds the DataFrame and the view of the SQL check. A view joins only the
dimension tables that the asked columns need and keeps every line item.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# prefix of a dimension's columns -> (table, key on the left, key on the right)
_DIMENSIONS = {
    "o": ("orders", "l_orderkey", "o_orderkey"),
    "p": ("part", "l_partkey", "p_partkey"),
    "s": ("supplier", "l_suppkey", "s_suppkey"),
    "c": ("customer", "o_custkey", "c_custkey"),
    "n": ("nation", "s_nationkey", "n_nationkey"),
    "r": ("region", "n_regionkey", "r_regionkey"),
}
_NEEDS = {"c": "o", "n": "s", "r": "sn"}
# a dimension that hangs on another one is joined to that first, so the wide rows are shuffled once for both
_HANGS_ON = {"c": "o", "n": "s", "r": "n"}

_CURRENCIES = ["AED", "CNY", "EUR", "GBP", "KRW", "KZT", "RUB", "USD", "UZS", "JPY", "SGD"]
_CURRENCY = (
    "CASE CAST(s_nationkey % 12 AS INT) "
    + " ".join(f"WHEN {i} THEN '{code}'" for i, code in enumerate(_CURRENCIES))
    + " ELSE 'XXX' END"
)
_UNIT = "CASE CAST(p_size % 4 AS INT) WHEN 0 THEN 'кг' WHEN 1 THEN 'т' WHEN 2 THEN 'м' ELSE 'шт' END"
_METAL_NAME = (
    "CASE CAST(p_partkey % 6 AS INT) "
    "WHEN 0 THEN concat('Труба ', 20 + p_size * 2, 'х', 2 + p_partkey % 5, ' ГОСТ 8732-78 Ст20') "
    "WHEN 1 THEN concat('Лист ', 2 + p_size % 8, ' Ст3') "
    "WHEN 2 THEN concat('Уголок ', 25 + p_size, 'х', 25 + p_size, 'х', 3 + p_partkey % 4) "
    "WHEN 3 THEN concat('Швеллер ', 10 + 2 * (p_size % 10), 'П') "
    "WHEN 4 THEN concat('Арматура ', 8 + 2 * (p_size % 8), ' А500С') "
    "ELSE concat('Круг ', 10 + p_size, ' Ст45') END"
)
_ROW_KEY = "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)"

LOT_COLUMNS = {
    "lot_number": "l_orderkey",
    "lot_status": "o_orderstatus",
    "discipline": "p_type",
    "project_name": "c_mktsegment",
    "open_date": "CAST(o_orderdate AS DATE)",
    "close_date": "CAST(o_orderdate AS DATE) + CAST(5 + l_orderkey % 60 AS INT)",
    "actor_name": "concat('Actor ', o_custkey % 20, ' (ext. ', o_custkey, ')')",
    "good_name": "p_name",
    "good_count": "l_quantity",
    "unit": _UNIT,
    "supplier_qty": "l_quantity",
    "supplier_unit": _UNIT,
    "winner_name": "s_name",
    "unit_price": "l_extendedprice / l_quantity",
    "total_price": "l_extendedprice",
    "currency": _CURRENCY,
    "row_key": _ROW_KEY,
    "metal_product": _METAL_NAME,
}

# Lines taxed at 8 % play contracts signed outside any lot: their lot number is unknown to the lots.
CONTRACT_COLUMNS = {
    "lot_number": "CASE WHEN l_tax >= 0.075 THEN -1 - l_orderkey ELSE l_orderkey END",
    "lot_end_date": "CAST(o_orderdate AS DATE)",
    "contract_number": "concat(l_orderkey, '-', l_suppkey)",
    "contract_signing_date": "CAST(l_shipdate AS DATE)",
    "contract_name": "concat(l_orderkey, '-', l_suppkey)",
    "executor_dak": "concat('Exec ', l_suppkey % 15)",
    "counterparty_name": "s_name",
    "product_name": "p_name",
    "supplier_unit": _UNIT,
    "quantity": "l_quantity",
    "unit": _UNIT,
    "unit_price": "l_extendedprice / l_quantity * (1 + l_tax)",
    "product_amount": "l_extendedprice",
    "additional_expenses": "l_extendedprice * l_tax",
    "total_contract_amount": "l_extendedprice * (1 + l_tax) * (1 - l_discount)",
    "contract_currency": _CURRENCY,
    "delivery_conditions": "l_returnflag",
    "payment_conditions": "o_orderpriority",
    "delivery_time_days": "CAST(l_orderkey % 90 AS INT)",
    "discipline": "p_type",
    "project_name": "c_mktsegment",
    "row_key": _ROW_KEY,
    "metal_product": _METAL_NAME,
}

STOCK_COLUMNS = {
    "date_column": "CAST(date_trunc('month', l_shipdate) AS DATE)",
    "warehouse": "n_name",
    "nomenclature": "p_name",
    "currency": _CURRENCY,
    "stock_category": "p_brand",
    "department": "r_name",
    "project_name": "c_mktsegment",
}

#: From this many lines on rows are dealt over tasks by their number, about so many to a task.
MANY, OF_A_TASK = 4_000_000, 250_000

CATALOGUE_COLUMNS = {"item_id": "p_partkey", "metal_product": _METAL_NAME, "mass_class": "p_brand"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tasks(spark: SparkSession, lines: int) -> int:
    """Tasks for so many lines, 0 where they are few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines // OF_A_TASK + 1) if lines > MANY else 0


def _lines(spark: SparkSession, sf_dir: str) -> int:
    """Counting reads the footers of the files only."""
    return table(spark, sf_dir, "lineitem").count()


def spread(spark: SparkSession, sf_dir: str, df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a view by ``keys``, in as many tasks as the number of lines asks for.

    Adaptive execution sizes tasks by compressed bytes, and rows of long texts take many times as much memory when they
    are sorted or grouped. A small table is left to it.
    """
    tasks = _tasks(spark, _lines(spark, sf_dir))
    return df.repartition(tasks, *keys) if tasks else df


def _needed(expressions: Iterable[str]) -> set[str]:
    needed = set(re.findall(r"\b([opscnr])_[a-z]+\b", " ".join(expressions)))
    for prefix in list(needed):
        needed.update(_NEEDS.get(prefix, ""))
    return needed


def _joins(expressions: Iterable[str]) -> list[tuple[str, str, str]]:
    needed = _needed(expressions)
    return [spec for prefix, spec in _DIMENSIONS.items() if prefix in needed]


def _dimension(spark: SparkSession, sf_dir: str, prefix: str, needed: set[str]) -> DataFrame:
    """A dimension table with those that hang on it."""
    df = table(spark, sf_dir, _DIMENSIONS[prefix][0])
    for other, parent in _HANGS_ON.items():
        if parent == prefix and other in needed:
            _, left, right = _DIMENSIONS[other]
            df = df.join(_dimension(spark, sf_dir, other, needed), F.col(left) == F.col(right))
    return df


def _mapped(spark: SparkSession, sf_dir: str, mapping: dict[str, str], columns: Iterable[str]) -> DataFrame:
    chosen = {c: mapping[c] for c in columns}
    df = table(spark, sf_dir, "lineitem")
    needed = _needed(chosen.values())
    lines = _lines(spark, sf_dir) if needed else 0
    tasks = _tasks(spark, lines)
    for prefix, (name, left, right) in _DIMENSIONS.items():
        if prefix in needed and prefix not in _HANGS_ON:
            # tables of fewer rows than that can be broadcast, and need no shuffle of the lines
            if tasks and 10 * table(spark, sf_dir, name).count() >= lines:
                df = df.repartition(tasks, left)
            df = df.join(_dimension(spark, sf_dir, prefix, needed), F.col(left) == F.col(right))
    return df.select(*(F.expr(e).alias(c) for c, e in chosen.items()))


def lots(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Tender lines. Ask for the columns needed: each spares a dimension join."""
    return _mapped(spark, sf_dir, LOT_COLUMNS, columns or LOT_COLUMNS)


def contracts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Contract lines, same convention as :func:`lots`."""
    return _mapped(spark, sf_dir, CONTRACT_COLUMNS, columns or CONTRACT_COLUMNS)


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warehouse balances by month, summed over the line items."""
    lines = _mapped(
        spark, sf_dir, {**STOCK_COLUMNS, "amount": "l_extendedprice"}, [*STOCK_COLUMNS, "amount"]
    )
    return lines.groupBy(*STOCK_COLUMNS).agg(F.sum("amount").alias("total_price_currency"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metal catalogue: one row per part, named like rolled-metal items."""
    part = table(spark, sf_dir, "part")
    return part.select(*(F.expr(e).alias(c) for c, e in CATALOGUE_COLUMNS.items()))


def _view_sql(mapping: dict[str, str]) -> str:
    joins = " ".join(f"JOIN {t} ON {a} = {b}" for t, a, b in _joins(mapping.values()))
    cols = ", ".join(f"{e} AS {c}" for c, e in mapping.items())
    return f"SELECT {cols} FROM lineitem {joins}"


def view_sql(name: str) -> str:
    """The same view as a SELECT for the SQL check."""
    if name == "lots":
        return _view_sql(LOT_COLUMNS)
    if name == "contracts":
        return _view_sql(CONTRACT_COLUMNS)
    if name == "stock":
        keys = ", ".join(STOCK_COLUMNS)
        inner = _view_sql({**STOCK_COLUMNS, "amount": "l_extendedprice"})
        return f"SELECT {keys}, sum(amount) AS total_price_currency FROM ({inner}) GROUP BY {keys}"
    if name == "catalogue":
        cols = ", ".join(f"{e} AS {c}" for c, e in CATALOGUE_COLUMNS.items())
        return f"SELECT {cols} FROM part"
    raise KeyError(name)

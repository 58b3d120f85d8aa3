"""Reading the two export files, and the warehouse-style reads over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendermill.functions import text, values
from tendermill.operators import cleaning
from tendermill.sources import schemas


def raw_schema(headers: dict[str, str]) -> T.StructType:
    """All-text schema of an export file: nothing is inferred, nothing is lost before cleaning."""
    return T.StructType([T.StructField(h, T.StringType()) for h in headers])


def read_export(spark: SparkSession, path: str, headers: dict[str, str]) -> DataFrame:
    return spark.read.csv(path, schema=raw_schema(headers), header=True, encoding="UTF-8", multiLine=True,
                          escape='"')


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns parsed to the schema's types; a value that does not parse becomes null."""
    out = []
    for field in schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DateType):
            c = values.parsed_date(c)
        elif isinstance(field.dataType, T.DoubleType):
            c = values.parsed_local_number(c)
        elif isinstance(field.dataType, T.LongType):
            c = values.parsed_local_number(c).cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


def lots_from_export(raw: DataFrame) -> DataFrame:
    """Rename, parse, drop duplicates inside lots, null numbers to zero, person names to the bracket."""
    out = typed(raw.withColumnsRenamed(schemas.LOT_HEADERS), schemas.LOTS)
    out = cleaning.unique_rows_in_lots(out)
    out = out.fillna(0.0, subset=["good_count", "total_price", "supplier_qty", "unit_price"])
    return out.withColumn("actor_name", text.before_bracket("actor_name"))


def contracts_from_export(raw: DataFrame) -> DataFrame:
    """Rename, tidy texts, parse, keep rows with lot, product and executor and a positive quantity and price."""
    out = raw.withColumnsRenamed(schemas.CONTRACT_HEADERS).na.drop(how="all")
    texts = [f.name for f in schemas.CONTRACTS.fields if isinstance(f.dataType, T.StringType)]
    out = out.withColumns({c: text.one_line(c) for c in texts})
    out = typed(out, schemas.CONTRACTS)
    out = cleaning.complete(out, ["lot_number", "product_name", "executor_dak"], non_zero=["quantity", "unit_price"])
    return out.withColumn("executor_dak", text.before_bracket("executor_dak")).distinct()


def read_delimited(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Plain CSV with a header; a byte-order mark is skipped by the reader."""
    return spark.read.csv(path, schema=schema, header=True, encoding="UTF-8")


def from_sql(spark: SparkSession, statement: str, tables: dict[str, DataFrame] | None = None, **args) -> DataFrame:
    """SQL text to a frame; named parameters are bound by Spark, never pasted into the text."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement, args=args)


def load_range(df: DataFrame, column: str, start, end) -> DataFrame:
    """Inclusive date-range load of lots, contracts or stock."""
    return cleaning.between_dates(df, column, start, end)


def distinct_goods(df: DataFrame, disciplines: list[str]) -> DataFrame:
    return df.where(F.col("discipline").isin(disciplines)).select("good_name").distinct()

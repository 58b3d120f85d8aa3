"""Loading and writing: each query writes a result, reads it back and reports what arrived."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from tendermill.catalog.registry import query, with_views
from tendermill.operators import cleaning
from tendermill.session import checkpointed, shared_folder
from tendermill.sources import intake, sinks, views
from tendermill.streaming import intake_stream

YEARS = [1990, 1996, 1999, 2010]
_LINES = ("row_key", "discipline", "total_price")
_SCHEMA = "row_key string, discipline string, total_price double"
_BY_DISCIPLINE = """
    SELECT discipline, count(*) AS lines, count(DISTINCT row_key) AS different, sum(total_price) AS total
    FROM lots GROUP BY discipline"""


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}"


def _by_discipline(df):
    return df.groupBy("discipline").agg(
        F.count("*").alias("lines"), F.countDistinct("row_key").alias("different"), F.sum("total_price").alias("total"))


def _halves(df):
    part = F.pmod(F.xxhash64("row_key"), F.lit(2))
    return df.where(part == 0), df.where(part == 1)


@query("files_loaded_once", "S3", with_views("lots", _BY_DISCIPLINE), doubles="total:2")
def files_loaded_once(spark, d):
    """Half of the files are loaded; then the other half joins them, and only those are read."""
    folder = _folder(spark, "files_loaded_once")
    early, late = _halves(views.lots(spark, d, *_LINES))
    sinks.write_csv(early, folder)
    no_files = spark.createDataFrame([], "nameoffiles string")
    first = checkpointed(intake_stream.rows_of_new_files(intake.read_delimited(spark, folder, _SCHEMA), no_files))
    ledger = intake_stream.with_ledger(no_files, first)
    late.write.mode("append").csv(folder, header=True, encoding="UTF-8")
    fresh = intake_stream.rows_of_new_files(intake.read_delimited(spark, folder, _SCHEMA), ledger)
    return _by_discipline(first.unionByName(fresh))


@query("appended_to_table", "S4", with_views("lots", _BY_DISCIPLINE), doubles="total:2")
def appended_to_table(spark, d):
    table = f"appended_{uuid.uuid4().hex}"
    early, late = _halves(views.lots(spark, d, *_LINES))
    sinks.append_to(early, table)
    sinks.append_to(late.select("total_price", "row_key", "discipline"), table)
    found = checkpointed(_by_discipline(spark.table(table)))
    spark.sql(f"DROP TABLE {table}")
    return found


@query("ranges_with_rows", "S8", with_views("lots", f"""
    SELECT CAST(y AS BIGINT) AS year, NOT EXISTS (SELECT 1 FROM lots WHERE year(close_date) = y) AS is_empty
    FROM (SELECT unnest({YEARS}) AS y) t"""))
def ranges_with_rows(spark, d):
    lots = views.lots(spark, d, "close_date")
    rows = [(y, cleaning.is_empty_range(intake.load_range(lots, "close_date", date(y, 1, 1), date(y, 12, 31)))) for y in YEARS]
    return spark.createDataFrame(rows, "year long, is_empty boolean")


@query("delimited_and_back", "S9 S10", with_views("lots", _BY_DISCIPLINE), doubles="total:2")
def delimited_and_back(spark, d):
    folder = _folder(spark, "delimited_and_back")
    sinks.write_csv(views.lots(spark, d, *_LINES), folder)
    return _by_discipline(intake.read_delimited(spark, folder, _SCHEMA))


@query("replaced_table", "S11", with_views("lots", """
    SELECT *, true AS is_listed FROM (
        SELECT discipline, count(*) AS lines, sum(total_price) AS total FROM lots WHERE currency = 'USD' GROUP BY discipline) t"""),
       doubles="total:2")
def replaced_table(spark, d):
    """The second write replaces rows and columns of the first; the table stays listed."""
    table = f"replaced_{uuid.uuid4().hex}"
    lots = views.lots(spark, d, "discipline", "currency", "total_price")
    sinks.replace_table(lots.groupBy("currency").count(), table)
    sinks.replace_table(lots.where("currency = 'USD'").groupBy("discipline").agg(
        F.count("*").alias("lines"), F.sum("total_price").alias("total")), table)
    listed = not sinks.table_names(spark).where(F.col("tableName") == table).isEmpty()
    found = checkpointed(spark.table(table).withColumn("is_listed", F.lit(listed)))
    spark.sql(f"DROP TABLE {table}")
    return found


_BUNDLE = {"Суммы по дисциплинам за все годы": "discipline", "Суммы по дисциплинам за все годы: проекты": "project_name"}


@query("bundle_and_back", "S12", with_views("lots", " UNION ALL ".join(f"""
    SELECT '{name}' AS result, {key} AS key, count(*) AS lines, sum(total_price) AS total FROM lots GROUP BY {key}"""
       for name, key in _BUNDLE.items())), doubles="total:2")
def bundle_and_back(spark, d):
    """Two results whose names begin alike: both come back."""
    lots = views.lots(spark, d, "discipline", "project_name", "total_price")
    frames = {name: lots.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("lines"), F.sum("total_price").alias("total"))
              for name, key in _BUNDLE.items()}
    first, second = (spark.read.parquet(path).withColumn("result", F.lit(name)) for name, path in zip(
        _BUNDLE, sinks.write_bundle(frames, _folder(spark, "bundle_and_back"))))
    return first.unionByName(second)


@query("split_and_back", "S13", with_views("lots", _BY_DISCIPLINE), doubles="total:2")
def split_and_back(spark, d):
    """Rows of each folder, counted by the folder's own name."""
    folder = _folder(spark, "split_and_back")
    lots = views.lots(spark, d, *_LINES)
    sinks.write_split(lots, "discipline", folder)
    back = spark.read.schema(lots.schema.add("_split", "string")).parquet(folder)
    return _by_discipline(back.drop("discipline").withColumnRenamed("_split", "discipline"))

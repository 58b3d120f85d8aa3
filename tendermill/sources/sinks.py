"""Writing results: staging append, table maintenance, bundles and splits."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_to(df: DataFrame, table: str) -> None:
    """Append by column name; the table is created on the first load."""
    if df.sparkSession.catalog.tableExists(table):
        df.select(*df.sparkSession.table(table).columns).write.mode("append").insertInto(table)
    else:
        df.write.saveAsTable(table)


def replace_table(df: DataFrame, table: str) -> None:
    df.write.mode("overwrite").saveAsTable(table)


def table_names(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW TABLES").select("tableName", "isTemporary")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def write_bundle(frames: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> list[str]:
    """One folder per named result. The folder's name encodes the whole result name, so two names never share one."""
    written = []
    for name, df in frames.items():
        target = f"{folder}/{quote(name, safe=' ')}"
        df.write.mode("overwrite").format(fmt).option("header", "true").save(target)
        written.append(target)
    return written


def write_split(df: DataFrame, key: str, folder: str, files_per_key: int = 8) -> None:
    """One folder per key value, whole. A hot key is spread over several files by a salt."""
    safe = df.withColumn("_split", F.col(key).cast("string"))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_key))
    safe.repartition("_split", salt).write.mode("overwrite").partitionBy("_split").parquet(folder)

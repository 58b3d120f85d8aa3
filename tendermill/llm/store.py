"""Cutting lineage and sharing tables between executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one long column that may be broadcast: 32 MB of keys.
BROADCAST_ROWS = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where unset (tests), one in the warehouse, which is shared as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends there, executors may go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; its files go when nothing refers to them any more."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` written once with ``_row``, a number for each row that stays the same from then on."""
    return stored(df.withColumn("_row", F.monotonically_increasing_id()))


def small_side(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``keys``, marked for broadcast if it has at most ``rows`` rows; beyond that the join shuffles both sides."""
    return F.broadcast(keys) if keys.count() <= rows else keys

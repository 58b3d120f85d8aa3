"""Incremental intake: each export file is loaded once.

The checkpoint of the file stream is the ledger of loaded files; a restart goes on
where it stopped. The batch form keeps the ledger as a table of file names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tendermill.sources import intake, schemas

# File name prefixes of the two exports.
KINDS = {
    "KP_": (schemas.LOT_HEADERS, intake.lots_from_export),
    "Contr_": (schemas.CONTRACT_HEADERS, intake.contracts_from_export),
}


def export_stream(spark: SparkSession, folder: str, prefix: str, files_per_batch: int = 1000) -> DataFrame:
    headers, _ = KINDS[prefix]
    return (
        spark.readStream.schema(intake.raw_schema(headers))
        .option("header", "true")
        .option("encoding", "UTF-8")
        .option("multiLine", "true")
        .option("escape", '"')
        .option("pathGlobFilter", f"{prefix}*.csv")
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
    )


def load_new_files(
    spark: SparkSession, folder: str, prefix: str, target: str, checkpoint: str
) -> StreamingQuery:
    """Clean and append all files not loaded yet, then stop.

    Each micro-batch goes to a folder of its own number, so a batch that is run
    again after a failure replaces its output and nothing is loaded twice.
    """
    _, clean = KINDS[prefix]

    def write(batch: DataFrame, number: int) -> None:
        clean(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        export_stream(spark, folder, prefix)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def rows_of_new_files(raw: DataFrame, ledger: DataFrame) -> DataFrame:
    """Batch form: rows whose file name is not in the ledger (``nameoffiles``)."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return raw.withColumn("nameoffiles", name).join(ledger, "nameoffiles", "left_anti")


def with_ledger(ledger: DataFrame, loaded: DataFrame) -> DataFrame:
    return ledger.unionByName(loaded.select("nameoffiles").distinct()).distinct()


def each_kind(folder: str, load: Callable[[str, str], StreamingQuery]) -> list[StreamingQuery]:
    """Route every file of a folder by its prefix."""
    return [load(folder, prefix) for prefix in KINDS]

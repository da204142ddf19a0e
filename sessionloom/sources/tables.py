"""Table sinks on any Hadoop-compatible store, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

WORK_SETTING = "spark.checkpoint.dir"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine.
    """
    shared = spark.conf.get(WORK_SETTING, None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {WORK_SETTING} to a folder all executors can reach")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The parquet table at ``path``, or None when nothing has been written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def overwrite_table(
    df: DataFrame, path: str, by: str | None = None, in_order: bool = False
) -> DataFrame:
    """Full refresh: replace the table at ``path`` and read it back.

    ``by`` partitions the table on a column. The rows are rebalanced on it, so a partition has
    few files and a large one is still written by several tasks. ``in_order`` says that the rows
    lie by that column already, as those of a day-partitioned source do: then nothing is shuffled.
    """
    spread = by and not in_order
    writer = (df.hint("rebalance", by) if spread else df).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def overwrite_partitions(df: DataFrame, path: str, *by: str, in_order: bool = False) -> None:
    """Replace only the partitions present in ``df``; the others stay. Rebalanced as above."""
    (
        (df if in_order else df.hint("rebalance", *by))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def export_report(report: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a report as one file. For aggregated reports only: one task writes it."""
    writer = report.coalesce(1).write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)

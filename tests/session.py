"""The local session tests run in."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from sessionloom.session import STARTUP_SETTINGS, configure


def local_session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .appName("sessionloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config(map=STARTUP_SETTINGS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)

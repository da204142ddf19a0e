"""The nested daily event export."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.sources.tables import overwrite_partitions

# Fields of the export that are read. Days are 'yyyyMMdd', times are microseconds.
PARAMS_TYPE = """array<struct<key: string, value: struct<
    string_value: string, int_value: bigint, float_value: double, double_value: double>>>"""
ITEMS_TYPE = """array<struct<
    item_id: string, item_name: string, item_brand: string, item_variant: string,
    item_category: string, item_list_id: string, item_list_index: string,
    promotion_name: string, creative_name: string, price: double, price_in_usd: double,
    quantity: bigint, item_revenue: double, item_revenue_in_usd: double>>"""
EXPORT_SCHEMA = f"""
    event_date string,
    event_timestamp bigint,
    event_name string,
    user_pseudo_id string,
    user_first_touch_timestamp bigint,
    event_params {PARAMS_TYPE},
    device struct<category: string, mobile_brand_name: string>,
    geo struct<continent: string, sub_continent: string, country: string, region: string,
        city: string>,
    traffic_source struct<medium: string, source: string, name: string>,
    ecommerce struct<transaction_id: string, purchase_revenue: double,
        purchase_revenue_in_usd: double, tax_value: double, tax_value_in_usd: double,
        total_item_quantity: bigint, unique_items: bigint>,
    items {ITEMS_TYPE}
"""


def read_export(
    spark: SparkSession, root: str, start: str, end: str, fmt: str = "parquet"
) -> DataFrame:
    """Events of the days ``start`` to ``end`` ('yyyyMMdd', inclusive) under ``root/event_date=D``.

    Literal bounds on the partition column, so other days are never listed or read.
    """
    day = F.col("event_date")
    return (
        spark.read.format(fmt).schema(EXPORT_SCHEMA).load(root).where(day.between(start, end))
    )


def read_sharded_export(
    spark: SparkSession,
    root: str,
    start: str,
    end: str,
    fmt: str = "parquet",
    prefix: str = "events_",
) -> DataFrame:
    """The same for one folder per day, ``root/events_D``. Days without a folder are skipped; a window
    without any folder has no rows."""
    first, last = (datetime.strptime(d, "%Y%m%d") for d in (start, end))
    days = [
        f"{first + timedelta(days=n):%Y%m%d}" for n in range((last - first).days + 1)
    ]
    path = f"{root}/{prefix}{{{','.join(days)}}}"
    try:
        return spark.read.format(fmt).schema(EXPORT_SCHEMA).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EXPORT_SCHEMA)


def write_export(raw: DataFrame, root: str, in_order: bool = False) -> None:
    """Store events one partition per day, replacing the days present. ``in_order``: they lie by day."""
    overwrite_partitions(raw, root, "event_date", in_order=in_order)

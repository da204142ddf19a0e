"""Dimensions: devices, traffic sources, calendar."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.config import EVENT_ORDER, TRAFFIC
from sessionloom.functions import calendar_columns
from sessionloom.functions.keys import traffic_key

DEVICE_COLUMNS = ("continent", "sub_continent", "country", "region", "city", "device", "brand")


def devices(events: DataFrame) -> DataFrame:
    """One row per device with the attributes of its latest event (Type 1)."""
    latest = F.max_by(F.struct(*DEVICE_COLUMNS), F.struct(*EVENT_ORDER)).alias("last")
    return (
        events.groupBy("device_id")
        .agg(latest)
        .select("device_id", *[F.col(f"last.{c}").alias(c) for c in DEVICE_COLUMNS])
    )


def traffic_sources(events: DataFrame) -> DataFrame:
    """Every medium / source / campaign combination seen, NULL parts included."""
    return events.select(*TRAFFIC).distinct().select(
        traffic_key().alias("traffic_source_key"), *TRAFFIC
    )


def current_attribution(events: DataFrame) -> DataFrame:
    """The traffic source on each device's latest event, with its key and time."""
    latest = F.max_by(F.struct(*TRAFFIC, "time_stamp"), F.struct(*EVENT_ORDER)).alias("last")
    return (
        events.groupBy("device_id")
        .agg(latest)
        .select(
            "device_id",
            traffic_key("last.").alias("traffic_source_key"),
            *[F.col(f"last.{c}").alias(c) for c in TRAFFIC],
            F.col("last.time_stamp").alias("attributed_at"),
        )
    )


def _calendar(span: DataFrame) -> DataFrame:
    """``span``: one row (first, last)."""
    days = span.where(F.col("first").isNotNull()).select(
        F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("date_day")
    )
    return days.select("date_day", *calendar_columns(F.col("date_day")))


def calendar(spark: SparkSession, start: str | date, end: str | date) -> DataFrame:
    """One row per day, both ends included; ends are dates or 'yyyyMMdd' texts."""

    def day(value: str | date) -> date:
        return datetime.strptime(value, "%Y%m%d").date() if isinstance(value, str) else value

    return _calendar(
        spark.range(1).select(F.lit(day(start)).alias("first"), F.lit(day(end)).alias("last"))
    )


def calendar_of(events: DataFrame, column: str = "event_date") -> DataFrame:
    """Calendar over the days an event table spans."""
    return _calendar(events.agg(F.min(column).alias("first"), F.max(column).alias("last")))

"""Flat, cleaned event table from the nested export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import event_param
from sessionloom.functions.text import clean_lowered

# Output name -> nested field, all cleaned as text.
TEXT_FIELDS = {
    "device": "device.category",
    "brand": "device.mobile_brand_name",
    "continent": "geo.continent",
    "sub_continent": "geo.sub_continent",
    "country": "geo.country",
    "region": "geo.region",
    "city": "geo.city",
    "medium": "traffic_source.medium",
    "traffic_source": "traffic_source.source",
    "source_name": "traffic_source.name",
    "transaction_id": "ecommerce.transaction_id",
}
MEASURES = (
    "purchase_revenue",
    "purchase_revenue_in_usd",
    "tax_value",
    "tax_value_in_usd",
    "total_item_quantity",
    "unique_items",
)


def stage_events(raw: DataFrame) -> DataFrame:
    """One row per event: 25 flat columns and the items array. Projections, no shuffle.

    Fields are looked up and lower-cased in a first projection, so that cleaning, which looks at
    a text several times, does not repeat the lookups.
    """
    texts = {
        "page_title": event_param("page_title"),
        "page_location": event_param("page_location"),
        **{name: F.col(field) for name, field in TEXT_FIELDS.items()},
    }
    flat = raw.select(
        F.to_date("event_date", "yyyyMMdd").alias("event_date"),
        F.timestamp_micros("event_timestamp").alias("time_stamp"),
        F.lower("event_name").alias("event_name"),
        F.lower("user_pseudo_id").alias("device_id"),
        event_param("ga_session_id", "int").cast("string").alias("session_id"),
        F.timestamp_micros("user_first_touch_timestamp").alias("first_touch"),
        *[F.lower(c).alias(name) for name, c in texts.items()],
        *[F.col(f"ecommerce.{m}").alias(m) for m in MEASURES],
        "items",
    )
    cleaned = {name: clean_lowered(F.col(name)).alias(name) for name in texts}
    return flat.select(
        "event_date",
        "time_stamp",
        "event_name",
        "device_id",
        cleaned["page_title"],
        cleaned["page_location"],
        "session_id",
        "first_touch",
        *[cleaned[name] for name in TEXT_FIELDS],
        *MEASURES,
        "items",
    )

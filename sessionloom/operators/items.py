"""Line items: one row per item of an event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import clean_item_string, surrogate_key
from sessionloom.functions.keys import event_key

ITEM_TEXTS = (
    "item_id",
    "item_name",
    "item_brand",
    "item_variant",
    "item_category",
    "item_list_id",
    "item_list_index",
    "promotion_name",
    "creative_name",
)
ITEM_MEASURES = ("price", "price_in_usd", "quantity", "item_revenue", "item_revenue_in_usd")


def item_facts(events: DataFrame) -> DataFrame:
    """Unnest the items with their 0-based position; events without items give no row.

    Takes staged or sessionised events. With the latter each row also carries its session, so
    reports need no fact-to-fact join.
    """
    carried = (
        [F.col("session_key").alias("session_id")] if "session_key" in events.columns else []
    )
    unnested = events.where(F.size("items") > 0).select(
        event_key().alias("event_id"),
        *carried,
        "event_date",
        "event_name",
        F.posexplode("items").alias("item_index", "item"),
    )
    return unnested.select(
        surrogate_key("event_id", "item_index").alias("event_item_id"),
        "event_id",
        *(["session_id"] if carried else []),
        "event_date",
        "event_name",
        "item_index",
        *[clean_item_string(f"item.{c}").alias(c) for c in ITEM_TEXTS],
        *[F.col(f"item.{c}").alias(c) for c in ITEM_MEASURES],
    )


def modal_category(items: DataFrame, event_name: str = "view_item") -> DataFrame:
    """The category each product name carries most often on ``event_name`` rows.

    Ties go to the alphabetically first. Counted first, so a name's buffer is one row however
    many categories it has.
    """
    counted = (
        items.where(
            (F.col("event_name") == event_name)
            & F.col("item_name").isNotNull()
            & F.col("item_category").isNotNull()
        )
        .groupBy("item_name", "item_category")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.groupBy("item_name").agg(
        F.min_by("item_category", F.struct(-F.col("n"), "item_category")).alias("item_category")
    )

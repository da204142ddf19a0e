"""Funnel reports: by segment, by week, by product category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.config import (
    OVERALL_VALUE,
    REPORT_STEPS,
    SEGMENT_TYPES,
    UNKNOWN,
    UNKNOWN_CATEGORY_SORT,
    UNKNOWN_SEGMENT_SORT,
    Settings,
)
from sessionloom.functions import newcombe, rate, week_label, week_start, wilson
from sessionloom.operators.items import modal_category

FLAGS = {step: f"reached_{step}" for step in REPORT_STEPS[1:]}
SUMS = (
    ["segment_sessions"]
    + [f"reach_{s}" for s in FLAGS]
    + [f"joint_{s}" for s in REPORT_STEPS[2:]]
)


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def step_totals(sessions: DataFrame, *by: str) -> DataFrame:
    """Additive funnel totals: sessions, per step those reaching it, and it and the one before."""
    joint = [
        F.sum(F.col(FLAGS[before]) * F.col(FLAGS[step])).alias(f"joint_{step}")
        for before, step in zip(REPORT_STEPS[1:], REPORT_STEPS[2:])
    ]
    return sessions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("segment_sessions"),
        *[F.sum(flag).alias(f"reach_{step}") for step, flag in FLAGS.items()],
        *joint,
    )


def _add_up(totals: DataFrame, *by: str) -> DataFrame:
    return totals.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS])


def channel() -> Column:
    """The medium; 'direct' where the source is direct, 'unknown' where there is no medium."""
    return (
        F.when(F.col("traffic_source") == "direct", "direct")
        .when(F.col("medium").isNull(), UNKNOWN)
        .otherwise(F.col("medium"))
    )


def dimension_totals(
    sessions: DataFrame, devices: DataFrame, traffic: DataFrame
) -> DataFrame:
    """Funnel totals by device_category, continent and channel, a row per source of a channel.

    Totals come before the joins: per device and source ahead of the device join, so a device
    with very many sessions meets it with one row per source, and per source ahead of the join
    to the traffic sources.
    """
    per_device = step_totals(sessions, "device_id", "traffic_source_key")
    attributes = devices.select("device_id", F.col("device").alias("device_category"), "continent")
    per_source = _add_up(
        per_device.join(attributes, "device_id", "left"),
        "traffic_source_key",
        "device_category",
        "continent",
    )
    return per_source.join(
        traffic.select("traffic_source_key", "medium", "traffic_source"),
        "traffic_source_key",
        "left",
    ).select("device_category", "continent", channel().alias("channel"), *SUMS)


def segment_totals(totals: DataFrame) -> DataFrame:
    """Funnel totals per segment, all segment types from one pass over the totals."""
    segments = F.array(
        *[
            F.struct(
                F.lit(kind).alias("segment_type"),
                (
                    F.lit(OVERALL_VALUE) if kind == "overall" else F.coalesce(kind, F.lit(UNKNOWN))
                ).alias("segment_value"),
            )
            for kind in SEGMENT_TYPES
        ]
    )
    spread = totals.withColumn("segment", F.explode(segments)).select("segment.*", *SUMS)
    return _add_up(spread, "segment_type", "segment_value")


def segment_totals_grouping_sets(totals: DataFrame) -> DataFrame:
    """The same by GROUPING SETS; kept to check the other form against."""
    kinds = [k for k in SEGMENT_TYPES if k != "overall"]
    filled = totals.select(*[F.coalesce(k, F.lit(UNKNOWN)).alias(k) for k in kinds], *SUMS)
    grouped = filled.groupingSets([[]] + [[F.col(k)] for k in kinds], *kinds).agg(
        *[F.sum(c).alias(c) for c in SUMS], *[F.grouping(k).alias(f"off_{k}") for k in kinds]
    )
    kind, value = F.lit("overall"), F.lit(OVERALL_VALUE)
    for k in kinds:
        on = F.col(f"off_{k}") == 0
        kind, value = F.when(on, k).otherwise(kind), F.when(on, F.col(k)).otherwise(value)
    return grouped.select(kind.alias("segment_type"), value.alias("segment_value"), *SUMS)


def by_step(segments: DataFrame, *kept: str, overall: bool = False) -> DataFrame:
    """One row per segment and step: sessions reaching it, the step before, and both.

    The base step and the first event step follow on all sessions. ``overall`` also spreads the
    totals over all sessions that ``with_overall`` put next to the segment's.
    """
    rows = []
    for n, step in enumerate(REPORT_STEPS, start=1):
        reached = "segment_sessions" if n == 1 else f"reach_{step}"
        before = "segment_sessions" if n <= 2 else f"reach_{REPORT_STEPS[n - 2]}"
        fields = {
            "sessions_reached": reached,
            "prev_step_sessions": before,
            "reached_from_prev": reached if n <= 2 else f"joint_{step}",
        }
        if overall:
            fields["all_reached"] = f"all_{reached}"
        rows.append(
            F.struct(
                F.lit(step).alias("step"),
                F.lit(n).alias("step_sort"),
                *[F.col(c).alias(name) for name, c in fields.items()],
            )
        )
    return segments.select(
        "segment_type", "segment_value", "segment_sessions", *kept, F.inline(F.array(*rows))
    )


def with_overall(segments: DataFrame) -> DataFrame:
    """Put the totals over all sessions next to each segment's, as ``all_*``.

    One window over the segments, which are few: not a function of the number of sessions.
    """
    everything = Window.partitionBy()
    is_overall = F.col("segment_type") == "overall"
    reached = ["segment_sessions"] + [f"reach_{s}" for s in FLAGS]
    return segments.withColumns(
        {f"all_{c}": F.max(F.when(is_overall, F.col(c))).over(everything) for c in reached}
    )


def funnel_report(
    sessions: DataFrame,
    devices: DataFrame,
    traffic: DataFrame,
    settings: Settings = Settings(),
) -> DataFrame:
    """Segment x step funnel with rates, 95% intervals and each segment's gap to the rest."""
    return funnel_rates(segment_totals(dimension_totals(sessions, devices, traffic)), settings)


def funnel_rates(segments: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Report rows from segment totals. Windows here see segments, not sessions."""
    # Ranked with the unknown segment in place, so the others keep a hole for it. A segment's
    # size is the same at every step, so one rank serves all steps.
    by_size = Window.partitionBy("segment_type").orderBy(F.desc("segment_sessions"))
    ranked = with_overall(segments).withColumn("_rank", F.dense_rank().over(by_size))
    placed = by_step(ranked, "all_segment_sessions", "_rank", overall=True)

    is_overall = F.col("segment_type") == "overall"
    n, reached = F.col("segment_sessions"), F.col("sessions_reached")
    before, joint = F.col("prev_step_sessions"), F.col("reached_from_prev")
    rest_n, rest_reached = F.col("all_segment_sessions") - n, F.col("all_reached") - reached
    type_sort = F.coalesce(
        *[F.when(F.col("segment_type") == k, v) for k, v in SEGMENT_TYPES.items()]
    )
    z = settings.z
    gap = (reached, n, rest_reached, rest_n)
    return placed.select(
        "segment_type",
        type_sort.alias("segment_type_sort"),
        "segment_value",
        F.when(is_overall, 0)
        .when(F.col("segment_value") == UNKNOWN, UNKNOWN_SEGMENT_SORT)
        .otherwise(F.col("_rank"))
        .alias("segment_sort"),
        "step",
        "step_sort",
        "segment_sessions",
        "sessions_reached",
        "prev_step_sessions",
        "reached_from_prev",
        rate(reached, n).alias("reach_rate"),
        wilson(reached, n, "lower", z).alias("reach_rate_lower"),
        wilson(reached, n, "upper", z).alias("reach_rate_upper"),
        rate(joint, before).alias("step_conversion"),
        wilson(joint, before, "lower", z).alias("step_conversion_lower"),
        wilson(joint, before, "upper", z).alias("step_conversion_upper"),
        rate(reached - joint, reached).alias("skipped_prev_share"),
        (rate(reached, n) - rate(rest_reached, rest_n)).alias("gap_vs_rest"),
        newcombe(*gap, "lower", z).alias("gap_vs_rest_lower"),
        newcombe(*gap, "upper", z).alias("gap_vs_rest_upper"),
        _flag(n < settings.thin_below).alias("is_thin_segment"),
        _flag(before < settings.thin_below).alias("is_thin_step"),
    )


def overall_funnel(sessions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The funnel of all sessions: share reaching each step, with its Wilson interval."""
    totals = step_totals(sessions).select(
        F.lit("overall").alias("segment_type"), F.lit(OVERALL_VALUE).alias("segment_value"), *SUMS
    )
    reached, n = F.col("sessions_reached"), F.col("segment_sessions")
    return by_step(totals).select(
        "step",
        "step_sort",
        "segment_sessions",
        "sessions_reached",
        rate(reached, n).alias("reach_rate"),
        wilson(reached, n, "lower", settings.z).alias("reach_rate_lower"),
        wilson(reached, n, "upper", settings.z).alias("reach_rate_upper"),
    )


def weekly_report(sessions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per ISO week. ``days_in_week`` counts days that have sessions.

    Summed per day first: the distinct count of days is then a plain count.
    """
    steps = ("view_item", "add_to_cart", "begin_checkout", "purchase")
    daily = sessions.groupBy("session_date").agg(
        F.count(F.lit(1)).alias("sessions"),
        *[F.sum(f"reached_{s}").alias(f"sessions_with_{s}") for s in steps],
    )
    weekly = daily.groupBy(week_start(F.col("session_date")).alias("week_start")).agg(
        F.count("session_date").alias("days_in_week"),
        F.sum("sessions").alias("sessions"),
        *[F.sum(f"sessions_with_{s}").alias(f"sessions_with_{s}") for s in steps],
    )
    k, n = F.col("sessions_with_purchase"), F.col("sessions")
    return weekly.select(
        "week_start",
        week_label(F.col("week_start")).alias("week_label"),
        F.row_number().over(Window.orderBy("week_start")).alias("week_sort"),
        "days_in_week",
        _flag(F.col("days_in_week") < settings.full_week_days).alias("is_partial_week"),
        "sessions",
        *[f"sessions_with_{s}" for s in steps],
        rate(k, n).alias("session_conversion_rate"),
        wilson(k, n, "lower", settings.z).alias("session_conversion_rate_lower"),
        wilson(k, n, "upper", settings.z).alias("session_conversion_rate_upper"),
    )


def product_report(
    items: DataFrame, events: DataFrame | None = None, settings: Settings = Settings()
) -> DataFrame:
    """View -> cart and view -> purchase by product category, products linked by name.

    Items built from sessionised events carry their session. Otherwise pass the event fact and
    the session is joined on event_id.
    """
    named = items.where(F.col("item_name").isNotNull())
    if "session_id" not in items.columns:
        sessions = events.select("event_id", F.col("session_id").alias("session_id"))
        named = named.join(sessions, "event_id", "inner")

    def on(name: str) -> Column:
        return F.col("event_name") == name

    # Per session and name first: the join to the categories then meets far fewer rows.
    per_name = named.groupBy("session_id", "item_name").agg(
        F.max(_flag(on("view_item"))).alias("viewed"),
        F.max(_flag(on("add_to_cart"))).alias("carted"),
        F.max(_flag(on("purchase"))).alias("purchased"),
        F.sum(F.when(on("purchase"), F.col("quantity")).otherwise(0)).alias("units_purchased"),
        F.sum(F.when(on("purchase"), F.col("item_revenue_in_usd")).otherwise(0.0)).alias(
            "item_revenue_in_usd"
        ),
    )
    per_category = (
        per_name.join(modal_category(items), "item_name", "left")
        .groupBy("session_id", F.coalesce("item_category", F.lit(UNKNOWN)).alias("category"))
        .agg(
            *[F.max(c).alias(c) for c in ("viewed", "carted", "purchased")],
            *[F.sum(c).alias(c) for c in ("units_purchased", "item_revenue_in_usd")],
        )
    )
    viewed = F.col("viewed")
    totals = per_category.groupBy(F.col("category").alias("item_category")).agg(
        F.sum(viewed).alias("sessions_viewed"),
        F.sum(viewed * F.col("carted")).alias("sessions_viewed_and_carted"),
        F.sum(viewed * F.col("purchased")).alias("sessions_viewed_and_purchased"),
        F.sum("purchased").alias("sessions_purchased"),
        F.sum("units_purchased").alias("units_purchased"),
        F.sum("item_revenue_in_usd").alias("item_revenue_in_usd"),
    )
    n = F.col("sessions_viewed")
    place = F.row_number().over(Window.orderBy(F.desc("sessions_viewed"), "item_category"))
    rates = []
    for goal, count in (("cart", "sessions_viewed_and_carted"),
                        ("purchase", "sessions_viewed_and_purchased")):
        k, name = F.col(count), f"view_to_{goal}_rate"
        rates += [
            rate(k, n).alias(name),
            wilson(k, n, "lower", settings.z).alias(f"{name}_lower"),
            wilson(k, n, "upper", settings.z).alias(f"{name}_upper"),
        ]
    return totals.withColumn("_place", place).select(
        "item_category",
        F.when(F.col("item_category") == UNKNOWN, UNKNOWN_CATEGORY_SORT)
        .otherwise(F.col("_place"))
        .alias("category_sort"),
        "sessions_viewed",
        "sessions_viewed_and_carted",
        "sessions_viewed_and_purchased",
        "sessions_purchased",
        "units_purchased",
        "item_revenue_in_usd",
        *rates,
        _flag(n < settings.thin_below).alias("is_thin_cell"),
    )


def daily_event_rollup(events: DataFrame, devices: DataFrame, traffic: DataFrame) -> DataFrame:
    """Events and purchase revenue per day, event, device category, continent and source.

    Only counts and sums, so any further grouping adds up to the fact. Rolled up per device ahead
    of the device join.
    """
    measures = ("events", "purchase_revenue_in_usd")
    per_device = events.groupBy("event_date", "event_name", "device_id", "traffic_source_key").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("purchase_revenue_in_usd").alias("purchase_revenue_in_usd"),
    )
    keys = ["event_date", "event_name", "device_category", "continent", "traffic_source_key"]
    per_source = (
        per_device.join(
            devices.select("device_id", F.col("device").alias("device_category"), "continent"),
            "device_id",
            "left",
        )
        .groupBy(*keys)
        .agg(*[F.sum(c).alias(c) for c in measures])
    )
    return per_source.join(
        traffic, "traffic_source_key", "left"
    ).select(*keys[:-1], "medium", "traffic_source", "source_name", *measures)


def daily_item_rollup(items: DataFrame) -> DataFrame:
    """Item rows, units and revenue per day, event and product."""
    return items.groupBy("event_date", "event_name", "item_name").agg(
        F.count(F.lit(1)).alias("item_rows"),
        F.sum("quantity").alias("quantity"),
        F.sum("item_revenue_in_usd").alias("item_revenue_in_usd"),
    )

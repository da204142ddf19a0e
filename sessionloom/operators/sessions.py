"""Inactivity sessions: event grain, session rollup, session and event facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.config import EVENT_ORDER, FUNNEL_EVENTS, TRAFFIC
from sessionloom.functions import surrogate_key
from sessionloom.functions.keys import event_key, traffic_key
from sessionloom.operators.runs import SLICE, HotKeys, number_runs
from sessionloom.operators.staging import MEASURES


def sessionise(
    events: DataFrame,
    gap_seconds: int = 1800,
    policy: HotKeys = HotKeys(),
    keep_slice: bool = False,
) -> DataFrame:
    """Attach to every event its device's session, cut where more than ``gap_seconds`` pass.

    The gap is counted in whole seconds, truncated: 1800.9 s is still 1800. ``keep_slice`` keeps
    the column by which hot devices were cut, which spares session_rollup a shuffle of events.
    """
    kept = events.columns
    runs = number_runs(
        events,
        "device_id",
        EVENT_ORDER,
        "time_stamp",
        lambda now, before: F.coalesce(
            F.timestamp_diff("SECOND", before, now) > gap_seconds, F.lit(True)
        ),
        previous="_previous",
        flag="is_new_session",
        number="session_num",
        policy=policy,
        keep_slice=keep_slice,
    )
    return runs.select(
        surrogate_key("device_id", "session_num").alias("session_key"),
        *kept,
        *([SLICE] if keep_slice else []),
        "is_new_session",
        "session_num",
        F.expr("timestampdiff(SECOND, _previous, time_stamp) div 60").alias("mins_since_prev"),
    )


def session_parts(sessionised: DataFrame, *by: str) -> DataFrame:
    """What a session's events of one slice, day or other part ``by`` add to the session; its opening event's attributes."""
    # One row of a session opens it; only that row builds the struct.
    opening = F.when(
        F.col("is_new_session") == 1,
        F.struct("session_id", "event_date", "first_touch", *TRAFFIC),
    )
    return sessionised.groupBy("device_id", *by, "session_num").agg(
        F.min("time_stamp").alias("session_start"),
        F.max("time_stamp").alias("session_end"),
        F.count(F.lit(1)).alias("event_count"),
        F.collect_set("session_id").alias("native_ids"),
        F.max(opening).alias("first"),
        *[
            F.max(F.when(F.col("event_name") == step, 1).otherwise(0)).alias(f"reached_{step}")
            for step in FUNNEL_EVENTS
        ],
    )


def merged_parts(parts: DataFrame) -> DataFrame:
    """One row per session from all of its parts, as session_rollup gives it."""
    return _rolled(
        parts.groupBy("device_id", "session_num").agg(
            F.min("session_start").alias("session_start"),
            F.max("session_end").alias("session_end"),
            F.sum("event_count").alias("event_count"),
            F.array_distinct(F.flatten(F.collect_list("native_ids"))).alias("native_ids"),
            F.max("first").alias("first"),
            *[F.max(f"reached_{step}").alias(f"reached_{step}") for step in FUNNEL_EVENTS],
        )
    )


def session_rollup(sessionised: DataFrame) -> DataFrame:
    """One row per session: span, size, first-event attributes and the presence flag per step.

    Events collapse to a row per session and slice first. Where sessionise kept the slices, they
    already lie that way and nothing moves; only those rows are shuffled to merge a device's
    slices, so a device or session of any size is safe. Keys are hashed last.
    """
    if SLICE in sessionised.columns:
        return merged_parts(session_parts(sessionised, SLICE))
    return _rolled(session_parts(sessionised))


def _rolled(rolled: DataFrame) -> DataFrame:
    rolled = rolled.withColumn("ga_session_count", F.size("native_ids").cast("bigint"))
    return rolled.select(
        surrogate_key("device_id", "session_num").alias("session_key"),
        "device_id",
        "session_num",
        "session_start",
        "session_end",
        "event_count",
        "ga_session_count",
        F.col("first.session_id").alias("ga_session_id"),
        F.col("first.event_date").alias("session_date"),
        F.col("first.first_touch").alias("first_touch"),
        *[F.col(f"first.{c}").alias(c) for c in TRAFFIC],
        *[f"reached_{step}" for step in FUNNEL_EVENTS],
    )


def funnel_steps(rollup: DataFrame) -> DataFrame:
    """Session grain: attribution of the first event and the step flags."""
    return rollup.select(
        "session_key",
        "device_id",
        "session_num",
        "session_start",
        "session_end",
        "event_count",
        "first_touch",
        F.col("medium").alias("first_touch_medium"),
        F.col("traffic_source").alias("first_touch_source"),
        F.col("source_name").alias("first_touch_source_name"),
        *[f"reached_{step}" for step in FUNNEL_EVENTS],
    )


def session_facts(rollup: DataFrame) -> DataFrame:
    """The session fact. ``session_date`` is the first event's own date, not the UTC day."""
    return rollup.select(
        F.col("session_key").alias("session_id"),
        "ga_session_id",
        "ga_session_count",
        "session_date",
        "session_start",
        "session_end",
        "event_count",
        "device_id",
        traffic_key().alias("traffic_source_key"),
        *[f"reached_{step}" for step in FUNNEL_EVENTS],
    )


def session_facts_by_join(facts_part: DataFrame, steps: DataFrame) -> DataFrame:
    """Session fact from separately stored parts: spans and keys joined to the step flags."""
    flags = steps.select(
        F.col("session_key").alias("session_id"), *[f"reached_{s}" for s in FUNNEL_EVENTS]
    )
    plain = facts_part.select([c for c in facts_part.columns if not c.startswith("reached_")])
    return plain.join(flags, "session_id", "inner")


def event_facts(sessionised: DataFrame) -> DataFrame:
    """The event fact: hash keys to session and traffic source instead of lookups, and measures."""
    return sessionised.select(
        event_key().alias("event_id"),
        F.col("session_key").alias("session_id"),
        F.col("session_id").alias("ga_session_id"),
        "device_id",
        traffic_key().alias("traffic_source_key"),
        "event_date",
        "time_stamp",
        "event_name",
        "page_title",
        "page_location",
        "transaction_id",
        *MEASURES,
    )


def with_derived_dimensions(sessions: DataFrame) -> DataFrame:
    """Add ``spans_multiple_ga_sessions``: the session holds more than one native id."""
    return sessions.withColumn("spans_multiple_ga_sessions", F.col("ga_session_count") > 1)

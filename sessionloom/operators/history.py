"""Attribution history of devices: by event time (SCD Type 2), with as-of and current lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.config import EVENT_ORDER, TRAFFIC
from sessionloom.functions import surrogate_key
from sessionloom.functions.keys import traffic_key
from sessionloom.operators.runs import (
    SLICE,
    HotKeys,
    across_slices,
    join_carry,
    next_value,
    number_runs,
    slice_window,
    with_slices,
)


def attribution_history(events: DataFrame, policy: HotKeys = HotKeys()) -> DataFrame:
    """One row per device and version: a run of events with the same traffic source.

    A return to an earlier source opens a new version. A version is valid from its first event
    until the next version's first event, which is excluded; the last one is open.
    """
    keyed = events.select(
        "device_id", *EVENT_ORDER, *TRAFFIC, traffic_key().alias("traffic_source_key")
    )
    runs = number_runs(
        keyed,
        "device_id",
        EVENT_ORDER,
        "traffic_source_key",
        lambda now, before: now != before,
        previous="_previous",
        flag="_is_change",
        number="version_num",
        policy=policy,
        keep_slice=True,
    )
    # A run's opening row holds all the version needs, so no aggregation follows.
    opened = runs.where(F.col("_is_change") == 1).select(
        "device_id",
        SLICE,
        "version_num",
        "traffic_source_key",
        *TRAFFIC,
        F.col("time_stamp").alias("valid_from"),
    )
    return next_value(opened, "device_id", "version_num", "valid_from", "valid_to").select(
        surrogate_key("device_id", "version_num").alias("attribution_version_key"),
        "device_id",
        "version_num",
        "traffic_source_key",
        *TRAFFIC,
        "valid_from",
        "valid_to",
        F.when(F.col("valid_to").isNull(), 1).otherwise(0).alias("is_current"),
    )


def asof_join(
    facts: DataFrame,
    versions: DataFrame,
    key: str,
    at: str,
    columns: Sequence[str],
    *,
    valid_from: str = "valid_from",
    valid_to: str = "valid_to",
    policy: HotKeys = HotKeys(),
) -> DataFrame:
    """Left-join to each fact the key's version with valid_from <= at < valid_to (NULL = open).

    Versions of a key must not overlap. Facts and versions are put in one time order and the
    latest version is carried forward: linear in rows, where a join on the key with a range
    condition tests every pair of a key's facts and versions. As in that join, a NULL key, time or
    ``valid_from`` matches nothing; such facts pass by the windows.
    """
    version = F.struct(F.col(valid_to).alias("_until"), *columns)
    findable = F.col(key).isNotNull() & F.col(at).isNotNull()
    left = facts.where(findable).withColumns({"_at": F.col(at), "_is_fact": F.lit(1)})
    right = versions.where(F.col(key).isNotNull() & F.col(valid_from).isNotNull()).select(
        key,
        F.col(valid_from).alias("_at"),
        F.lit(0).alias("_is_fact"),
        F.col(valid_to).alias("_until"),
        version.alias("_version"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    sliced = with_slices(both, key, ["_at", "_is_fact"], policy)

    # Of versions opened at the same instant only the last to end has any extent.
    order = ["_at", "_is_fact", F.col("_until").asc_nulls_last()]
    held = F.last("_version", ignorenulls=True).over(
        slice_window(key, order).rowsBetween(Window.unboundedPreceding, 0)
    )
    carry = (
        sliced.where(F.col(SLICE).isNotNull())
        .select(
            key,
            SLICE,
            "_version",
            F.when(
                F.col("_is_fact") == 0,
                F.struct("_at", F.col("_until").isNull().alias("open"), "_until"),
            ).alias("_place"),
        )
        .groupBy(key, SLICE)
        .agg(F.max_by("_version", "_place").alias("_last"))
        .select(
            F.col(key).alias("_of_key"),
            F.col(SLICE).alias("_of_slice"),
            F.last("_last", ignorenulls=True)
            .over(across_slices(key).rowsBetween(Window.unboundedPreceding, -1))
            .alias("_carried"),
        )
    )
    found = join_carry(
        sliced.withColumn("_held", held).where(F.col("_is_fact") == 1), carry, key
    ).withColumn("_held", F.coalesce("_held", "_carried"))
    until = F.col("_held._until")
    valid = until.isNull() | (F.col("_at") < until)
    matched = found.select(
        *facts.columns, *[F.when(valid, F.col(f"_held.{c}")).alias(c) for c in columns]
    )
    return matched.unionByName(facts.where(~findable), allowMissingColumns=True)


def current_versions(versions: DataFrame) -> DataFrame:
    """The open version of each key."""
    return versions.where(F.col("is_current") == 1)


def with_current_version(
    facts: DataFrame, versions: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """Left-join the key's open version, whatever the fact's own time."""
    return facts.join(current_versions(versions).select(key, *columns), key, "left")

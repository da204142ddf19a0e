"""Profiles of an event table: what is empty, constant, repeated, drifting or overlapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions.params import VALUE_FIELDS
from sessionloom.functions.text import MISSING_TEXTS, NO_MEDIUM_TEXT

PLACEHOLDERS = (*MISSING_TEXTS, NO_MEDIUM_TEXT)


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value) for every row and column; an array is judged by its size."""

    def value(c: str) -> Column:
        is_array = isinstance(df.schema[c].dataType, T.ArrayType)
        sized = F.when(F.col(c).isNotNull(), F.size(c)) if is_array else F.col(c)
        return sized.cast("string")

    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), value(c).alias("value")) for c in columns]
    )
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: filled rows, placeholder rows, distinct values, and what that makes it.

    Counted per (column, value) first, so distinct counts of all columns take one shuffle of
    pre-aggregated values.
    """
    names = list(columns or df.columns)
    per_value = _long(df, names).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    holds = F.col("value").isNotNull()
    empty_text = F.lower("value").isin(*PLACEHOLDERS, "<other>")
    profile = per_value.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(holds, F.col("n"))), F.lit(0)).alias("n_filled"),
        F.coalesce(F.sum(F.when(empty_text, F.col("n"))), F.lit(0)).alias("n_placeholder"),
        F.count("value").alias("n_distinct"),
    )
    verdict = (
        F.when(F.col("n_filled") == 0, "empty")
        .when(F.col("n_placeholder") == F.col("n_filled"), "placeholder only")
        .when((F.col("n_distinct") == 1) & (F.col("n_filled") == F.col("n_rows")), "constant")
        .otherwise("varies")
    )
    return profile.withColumn("verdict", verdict)


def placeholder_counts(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Rows per field (name -> column) and 'no value' text, in one pass."""
    counts = {
        (name, text): F.count_if(F.lower(F.col(column)) == text)
        for name, column in fields.items()
        for text in PLACEHOLDERS
    }
    sums = df.agg(*[c.alias(f"c{n}") for n, c in enumerate(counts.values())])
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(text).alias("placeholder"),
                F.col(f"c{n}").alias("n_rows"),
            )
            for n, (name, text) in enumerate(counts)
        ]
    )
    return sums.select(F.explode(rows).alias("r")).select("r.*").where("n_rows > 0")


def repeated_param_keys(raw: DataFrame) -> DataFrame:
    """Events whose parameters repeat a key, with the number of surplus entries. No explode."""
    keys = F.transform("event_params", lambda p: p["key"])
    surplus = F.size("event_params") - F.size(F.array_distinct(keys))
    return raw.select(
        F.lower("user_pseudo_id").alias("device_id"),
        "event_timestamp",
        surplus.alias("surplus_keys"),
    ).where("surplus_keys > 0")


def param_fields(raw: DataFrame) -> DataFrame:
    """Per parameter key: rows per value field, and whether it is spread over several fields."""
    entry = raw.select(F.explode("event_params").alias("p"))
    fields = list(VALUE_FIELDS.values())
    counted = entry.groupBy(F.col("p.key").alias("param_key")).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count(f"p.value.{f}").alias(f) for f in fields]
    )
    used = sum((F.when(F.col(f) > 0, 1).otherwise(0) for f in fields), F.lit(0))
    return counted.select(
        "param_key",
        "n_rows",
        *[F.col(f).alias(f"n_{f}") for f in fields],
        F.when(used > 1, 1).otherwise(0).alias("is_mixed"),
    )


def explode_cost(raw: DataFrame) -> DataFrame:
    """Rows before and after unnesting the parameters, without unnesting them."""
    return raw.agg(
        F.count(F.lit(1)).alias("events"),
        F.sum(F.coalesce(F.size("event_params"), F.lit(0))).alias("param_rows"),
    ).withColumn("rows_per_event", F.try_divide("param_rows", "events"))


def attribute_drift(
    events: DataFrame,
    attributes: Sequence[str],
    combinations: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Per attribute: devices seen, devices with more than one value, and the most values.

    ``combinations`` names sets of attributes that are looked at together. NULL counts as a
    value. Distinct (device, value) pairs come first.
    """
    named = {a: F.col(a).cast("string") for a in attributes}
    for name, together in (combinations or {}).items():
        named[name] = F.to_json(F.struct(*together))
    pairs = F.array(
        *[F.struct(F.lit(n).alias("attribute"), c.alias("value")) for n, c in named.items()]
    )
    distinct = (
        events.select("device_id", F.explode(pairs).alias("p"))
        .select("device_id", "p.*")
        .distinct()
    )
    per_device = distinct.groupBy("attribute", "device_id").agg(
        F.count(F.lit(1)).alias("n_values")
    )
    return per_device.groupBy("attribute").agg(
        F.count(F.lit(1)).alias("devices"),
        F.count_if(F.col("n_values") > 1).alias("devices_drifting"),
        F.max("n_values").alias("max_values"),
    )


def session_mismatch(sessionised: DataFrame) -> DataFrame:
    """Sessions holding several native ids, and native sessions split over several sessions."""
    pairs = sessionised.select("device_id", "session_num", "session_id").distinct()

    def several(by: str, label: str) -> DataFrame:
        return (
            pairs.groupBy("device_id", by)
            .agg(F.count(F.lit(1)).alias("n"))
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n") > 1).alias("mismatched"))
            .select(F.lit(label).alias("direction"), "total", "mismatched")
        )

    return several("session_num", "sessions with several native ids").unionByName(
        several("session_id", "native sessions split")
    )


def key_overlap(
    items: DataFrame, columns: Sequence[str], left: str = "purchase", right: str = "view_item"
) -> DataFrame:
    """Per item column: distinct values on ``left`` events, and how many occur on ``right`` ones."""
    seen = (
        items.where(F.col("event_name").isin(left, right))
        .select("event_name", F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"))
                      for c in columns])).alias("p"))
        .where(F.col("p.value").isNotNull())
        .groupBy("p.column_name", "p.value")
        .agg(
            F.max(F.when(F.col("event_name") == left, 1).otherwise(0)).alias("on_left"),
            F.max(F.when(F.col("event_name") == right, 1).otherwise(0)).alias("on_right"),
        )
    )
    return seen.groupBy("column_name").agg(
        F.sum("on_left").alias("n_left"),
        F.sum(F.col("on_left") * F.col("on_right")).alias("n_shared"),
    )


def step_nesting(sessions: DataFrame, steps: Sequence[str]) -> DataFrame:
    """For every later/earlier pair of steps: sessions at the later one that skipped the earlier."""
    pairs = [(late, early) for n, late in enumerate(steps) for early in steps[:n]]
    sums = sessions.agg(
        *[F.sum(f"reached_{s}").alias(s) for s in steps],
        *[
            F.sum(F.col(f"reached_{late}") * (1 - F.col(f"reached_{early}"))).alias(
                f"{late}__{early}"
            )
            for late, early in pairs
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(late).alias("step"),
                F.lit(early).alias("earlier_step"),
                F.col(late).alias("sessions_reached"),
                F.col(f"{late}__{early}").alias("skipped"),
            )
            for late, early in pairs
        ]
    )
    return (
        sums.select(F.explode(rows).alias("r"))
        .select("r.*")
        .withColumn("skipped_share", F.try_divide("skipped", "sessions_reached"))
    )

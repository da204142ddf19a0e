"""Run-time SCD Type 2: each run compares the current state with the open versions."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.config import TRAFFIC
from sessionloom.functions.keys import NULL_PART
from sessionloom.sources.tables import overwrite_partitions, read_if_there

KEY = "device_id"
CHECKED = "traffic_source_key"
STATE = (KEY, CHECKED, *TRAFFIC, "attributed_at")
VERSION = (*STATE, "valid_from", "valid_to", "attribution_version_key", "snapshot_updated_at")


def _versions(state: list[Column], run_at: Column) -> Column:
    """A version opened by this run; devices without an id and with an empty one have keys of their own."""
    version_key = F.md5(
        F.concat_ws("|", F.coalesce(state[0], F.lit(NULL_PART)), F.unix_micros(run_at).cast("string"))
    )
    return F.struct(
        *state,
        run_at.alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_to"),
        version_key.alias("attribution_version_key"),
        run_at.alias("snapshot_updated_at"),
    )


def snapshot_changes(open_versions: DataFrame, current: DataFrame, run_at: datetime) -> DataFrame:
    """Versions after a run, from the open versions before it.

    One full-outer join on the device, one row per device on both sides; rows without a device are
    one device. A changed device (the checked key compared NULL-safe) yields its closed version and a new one; a device missing
    from ``current`` stays open; unchanged rows are not touched.
    """
    at = F.lit(run_at).cast("timestamp")
    old = open_versions.select([F.col(c).alias(f"old_{c}") for c in VERSION])
    new = current.select([F.col(c).alias(f"new_{c}") for c in STATE] + [F.lit(True).alias("_is_new")])
    both = old.join(new, F.col(f"old_{KEY}").eqNullSafe(F.col(f"new_{KEY}")), "full")

    had, has = F.col("old_valid_from").isNotNull(), F.col("_is_new").isNotNull()
    changed = ~F.col(f"old_{CHECKED}").eqNullSafe(F.col(f"new_{CHECKED}"))
    closes = had & has & changed
    kept = F.struct(
        *[
            (F.when(closes, at) if c == "valid_to" else F.col(f"old_{c}")).alias(c)
            for c in VERSION
        ]
    )
    opened = _versions([F.col(f"new_{c}").alias(c) for c in STATE], at)
    rows = F.array(F.when(had, kept), F.when(has & (~had | changed), opened))
    return (
        both.select(F.explode(F.filter(rows, lambda v: v.isNotNull())).alias("v"))
        .select("v.*")
        .select(*VERSION)
    )


def _schema() -> str:
    texts = {KEY, CHECKED, *TRAFFIC, "attribution_version_key"}
    return ", ".join(f"{c} {'string' if c in texts else 'timestamp'}" for c in VERSION)


def no_versions(spark: SparkSession) -> DataFrame:
    """An empty set of open versions, for the first run."""
    return spark.createDataFrame([], _schema())


class SnapshotStore:
    """Version history in plain parquet, without MERGE.

    ``open`` holds the full set of open versions per run, ``closed`` only those the run closed, so
    a run never rewrites history. Both are partitioned by run. ``closed`` is written first; a run
    counts once its ``open`` partition is there, so a run that died half-way leaves no trace and
    can be repeated.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.open_path = f"{root}/open"
        self.closed_path = f"{root}/closed"

    def _stored(self, path: str) -> DataFrame | None:
        return read_if_there(self.spark, path, f"{_schema()}, snapshot_run bigint")

    def _open(self, before: int | None = None) -> tuple[int | None, DataFrame]:
        """The latest run (before a given one) and its open versions."""
        stored = self._stored(self.open_path)
        if stored is None:
            return None, no_versions(self.spark)
        runs = stored if before is None else stored.where(F.col("snapshot_run") < before)
        last = runs.agg(F.max("snapshot_run")).first()[0]
        return last, stored.where(F.col("snapshot_run") == last).select(*VERSION)

    def run(self, current: DataFrame, run_at: datetime) -> None:
        """Record one run; running it again with the same time replaces it."""
        run_id = run_micros(run_at)
        _, before = self._open(before=run_id)
        after = snapshot_changes(before, current, run_at).withColumn(
            "snapshot_run", F.lit(run_id).cast("bigint")
        )
        still_open = F.col("valid_to").isNull()
        after.persist(StorageLevel.MEMORY_AND_DISK)  # two writes from one join
        try:
            overwrite_partitions(after.where(~still_open), self.closed_path, "snapshot_run")
            overwrite_partitions(after.where(still_open), self.open_path, "snapshot_run")
        finally:
            after.unpersist()

    def read(self) -> DataFrame:
        """The whole history: every closed version and the open ones of the latest run."""
        last, versions = self._open()
        closed = self._stored(self.closed_path) if last is not None else None
        if closed is not None:
            versions = versions.unionByName(
                closed.where(F.col("snapshot_run") <= last).select(*VERSION)
            )
        return versions


def run_micros(run_at: datetime) -> int:
    """Microseconds since the epoch; a time without zone is taken as UTC."""
    aware = run_at if run_at.tzinfo else run_at.replace(tzinfo=timezone.utc)
    delta = aware - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def attribution_dimension(snapshot: DataFrame) -> DataFrame:
    """The snapshot as a dimension, with ``is_current``."""
    return snapshot.select(
        "attribution_version_key",
        KEY,
        CHECKED,
        *TRAFFIC,
        "valid_from",
        "valid_to",
        F.when(F.col("valid_to").isNull(), 1).otherwise(0).alias("is_current"),
    )

"""Inactivity sessions over a stream of staged events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionloom.config import EVENT_ORDER, FUNNEL_EVENTS, TRAFFIC

STREAM_SETTINGS = {
    # A device's events become partial sessions before they are shuffled.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Open sessions live on disk next to the executor, not in its heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming"
    ".state.RocksDBStateStoreProvider",
}


def stream_sessions(
    events: DataFrame, gap_seconds: int = 1800, lateness: str = "30 minutes"
) -> DataFrame:
    """Sessions of each device, emitted once the watermark has passed their end.

    A session window closes when the distance reaches its gap, the batch rule cuts when whole
    seconds exceed it: the two agree one microsecond before the next whole second. Events without
    a device are one device, as in the batch. The watermark leaves out events later than
    ``lateness`` and those without a time: they stay in the stored export, and refreshing their
    days (plans.build.refresh_days) and sessionising again takes them in.
    """
    place = F.struct(*EVENT_ORDER)
    first = F.struct("session_id", "event_date", *TRAFFIC)
    return (
        events.withWatermark("time_stamp", lateness)
        .groupBy("device_id", F.session_window("time_stamp", f"{gap_seconds}.999999 seconds"))
        .agg(
            F.min("time_stamp").alias("session_start"),
            F.max("time_stamp").alias("session_end"),
            F.count(F.lit(1)).alias("event_count"),
            F.min_by(first, place).alias("first"),
            *[
                F.max(F.when(F.col("event_name") == s, 1).otherwise(0)).alias(f"reached_{s}")
                for s in FUNNEL_EVENTS
            ],
        )
        .select(
            "device_id",
            "session_start",
            "session_end",
            "event_count",
            F.col("first.event_date").alias("session_date"),
            *[F.col(f"first.{c}").alias(c) for c in TRAFFIC],
            *[f"reached_{s}" for s in FUNNEL_EVENTS],
        )
    )


def write_available(sessions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived, append closed sessions to ``path`` and stop.

    Progress and open sessions live in ``checkpoint``; the next call goes on from there.
    """
    for name, value in STREAM_SETTINGS.items():
        sessions.sparkSession.conf.set(name, value)
    query = (
        sessions.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return query

"""Streamed sessions equal batch sessions, across restarts."""

import random

from pyspark.sql import functions as F

from sessionloom.operators.sessions import session_rollup, sessionise
from sessionloom.sources.tables import work_folder
from sessionloom.streaming.numbered import append_available, corrected, late_events, latest_sessions, number_sessions
from sessionloom.streaming.sessions import stream_sessions, write_available
from tests.test_sessions import events


def run(spark, root, schema):
    stream = spark.readStream.schema(schema).parquet(f"{root}/in")
    write_available(stream_sessions(stream), f"{root}/out", f"{root}/checkpoint")


def sessions(df):
    columns = ("device_id", "session_start", "session_end", "event_count", "medium")
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


def test_boundaries_and_restart(spark):
    rows = []
    for device, gap in (("a", 1800.0), ("b", 1800.999999), ("c", 1801.0), ("d", 86_000)):
        rows += [(device, 0, "1", "view_item", "m"), (device, gap, "1", "purchase", "n")]
    first = events(spark, [r for r in rows if r[1] == 0])
    rest = events(spark, [r for r in rows if r[1] > 0])
    closing = events(spark, [("closing", 400_000, "1", "x", "m")])

    root = work_folder(spark, "stream")
    first.write.parquet(f"{root}/in")
    run(spark, root, first.schema)
    rest.write.mode("append").parquet(f"{root}/in")
    run(spark, root, first.schema)
    closing.write.mode("append").parquet(f"{root}/in")
    run(spark, root, first.schema)

    got = spark.read.parquet(f"{root}/out").where(F.col("device_id") != "closing")
    want = session_rollup(sessionise(events(spark, rows)))
    assert sessions(got) == sessions(want)
    per_device = {r.device_id: r["count"] for r in got.groupBy("device_id").count().collect()}
    assert per_device == {"a": 1, "b": 1, "c": 2, "d": 2}
    assert got.where("reached_purchase = 1").count() == 4


def test_too_late_events_are_dropped(spark):
    root = work_folder(spark, "stream")
    early = events(spark, [("a", 0, "1", "x", "m"), ("b", 50_000, "1", "x", "m")])
    early.write.parquet(f"{root}/in")
    run(spark, root, early.schema)
    late = events(spark, [("a", 10, "1", "x", "m"), ("closing", 400_000, "1", "x", "m")])
    late.write.mode("append").parquet(f"{root}/in")
    run(spark, root, early.schema)
    got = spark.read.parquet(f"{root}/out").where("device_id = 'a'").collect()
    assert [r.event_count for r in got] == [1]


def number(spark, root, batch):
    """One more run of the numbering stream on the events of a batch."""
    batch.write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{root}/in")
    append_available(number_sessions(stream), f"{root}/out", f"{root}/checkpoint")


def rolled_rows(df):
    return sorted(str(r) for r in df.select(*sorted(df.columns)).collect())


def test_numbered_sessions_need_no_closing_event(spark):
    rows = []
    for device, gap in (("a", 1800.0), ("b", 1800.999999), ("c", 1801.0), (None, 5000.0)):
        rows += [(device, 0, "1", "view_item", "m"), (device, gap, None, "purchase", "n")]
    root = work_folder(spark, "numbered")
    number(spark, root, events(spark, rows))
    assert rolled_rows(latest_sessions(spark, f"{root}/out")) == rolled_rows(session_rollup(sessionise(events(spark, rows))))
    assert late_events(spark, f"{root}/out").count() == 0


def test_an_event_between_joins_sessions_that_were_shown(spark):
    root = work_folder(spark, "numbered")
    first = [("a", 0, "1", "x", "m"), ("a", 2000, "2", "purchase", "n"), ("b", 0, "1", "x", "m")]
    number(spark, root, events(spark, first))
    assert latest_sessions(spark, f"{root}/out").where("device_id = 'a'").count() == 2
    between = [("a", 1000, "1", "view_item", "o")]
    number(spark, root, events(spark, between))  # in time: the device's clock is at 200 s
    got = latest_sessions(spark, f"{root}/out")
    assert rolled_rows(got) == rolled_rows(session_rollup(sessionise(events(spark, first + between))))
    assert got.where("device_id = 'a'").count() == 1 and late_events(spark, f"{root}/out").count() == 0


def test_stream_and_corrections_equal_the_batch(spark):
    """Devices and times missing, ties, events out of order and events far too late, in six runs."""
    rng = random.Random(4)
    rows = []
    for i in range(500):
        second = rng.choice([rng.randrange(60_000), 600 * rng.randrange(100)])
        rows.append((rng.choice([None, "", *"aabcd"]), second, rng.choice([None, "1", "2"]), f"e{i}" if i % 7 else "purchase", rng.choice("xyz")))
    arrival = {i: (r[1] + rng.choice([0, 900, 1500, 30_000 if r[0] in (None, "b", "c") else 0])) // 10_000 for i, r in enumerate(rows)}
    untimed = F.when(~F.col("event_name").rlike("e4.$") | ~F.col("device_id").isin("b"), F.col("time_stamp"))
    lost = lambda df: df.withColumn("time_stamp", untimed)
    root = work_folder(spark, "numbered")
    for n in sorted(set(arrival.values())):
        number(spark, root, lost(events(spark, [r for i, r in enumerate(rows) if arrival[i] == n])))
    everything = lost(events(spark, rows))
    got = corrected(spark, f"{root}/out", everything)
    assert rolled_rows(got) == rolled_rows(session_rollup(sessionise(everything)))
    late = {r.device_id for r in late_events(spark, f"{root}/out").collect()}
    assert late == {None, "b", "c"}  # the other devices' sessions are the stream's own

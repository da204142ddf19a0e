"""Sessions, runs and histories: boundaries, ties, and keys cut into slices."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.config import EVENT_ORDER
from sessionloom.functions.keys import traffic_key
from sessionloom.operators.dims import current_attribution, devices
from sessionloom.operators.history import asof_join, attribution_history
from sessionloom.operators.runs import HotKeys, hot_keys, slice_cells, with_slices
from sessionloom.operators.sessions import session_facts, session_rollup, sessionise
from sessionloom.plans.queries import rolled, staged

T0 = datetime(2024, 1, 1)
SLICED = HotKeys(min_rows=20, slice_rows=4, counted_one_in=1)
EVERY_ROW = HotKeys(min_rows=1, slice_rows=1, counted_one_in=1)
SAMPLED = HotKeys(min_rows=60, slice_rows=8, counted_one_in=4)


def events(spark, rows):
    """rows: (device, seconds, session_id, event_name, medium)."""
    data = [
        (T0.date(), T0 + timedelta(microseconds=round(s * 1e6)), d, sid, name, m, m, m, None)
        for d, s, sid, name, m in rows
    ]
    schema = (
        "event_date date, time_stamp timestamp, device_id string, session_id string, "
        "event_name string, medium string, traffic_source string, source_name string, "
        "first_touch timestamp"
    )
    return spark.createDataFrame(data, schema)


def test_gap_counts_whole_seconds(spark):
    rows = []
    for device, gap in (("a", 1800.0), ("b", 1800.999999), ("c", 1801.0)):
        rows += [(device, 0, "1", "x", "m"), (device, gap, "1", "x", "m")]
    got = sessionise(events(spark, rows)).groupBy("device_id").agg(F.max("session_num").alias("n"))
    assert {r.device_id: r.n for r in got.collect()} == {"a": 1, "b": 1, "c": 2}


def test_ties_follow_session_id_then_name(spark):
    rows = [
        ("a", 0, "2", "x", "m"), ("a", 0, "1", "z", "n"), ("a", 0, "1", "y", "o"),
        ("a", 0, None, "q", "p"),
    ]
    df = events(spark, rows)
    first = session_rollup(sessionise(df)).first()
    assert (first.ga_session_id, first.medium) == (None, "p")
    assert first.ga_session_count == 2
    assert current_attribution(df).first().medium == "m"


def test_minutes_since_previous(spark):
    rows = [("a", s, "1", "x", "m") for s in (0, 59, 119, 1978)]
    got = sessionise(events(spark, rows)).orderBy("time_stamp").collect()
    assert [r.mins_since_prev for r in got] == [None, 0, 1, 30]


def random_events(spark, n=3000, seed=1):
    """One device holds a third of the rows, some of them at equal times."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        device = "hot" if i % 3 == 0 else f"d{rng.randrange(60)}"
        second = rng.choice([rng.randrange(400_000), 1000 * rng.randrange(400)])
        rows.append((device, second, str(rng.randrange(40)), f"e{i}", rng.choice("abcd")))
    return events(spark, rows)


def with_missing_times(df):
    """Some events of the hot and of other devices lose their time."""
    lost = F.col("event_name").rlike("7[13]$")
    return df.withColumn("time_stamp", F.when(~lost, F.col("time_stamp")))


def plain_sessions(df, gap=1800):
    w = Window.partitionBy("device_id").orderBy(*EVENT_ORDER)
    secs = F.timestamp_diff("SECOND", F.lag("time_stamp").over(w), F.col("time_stamp"))
    return (
        df.withColumn("secs", secs)
        .withColumn("is_new_session", F.when(F.col("secs") <= gap, 0).otherwise(1))
        .withColumn("session_num", F.sum("is_new_session").over(w))
        .withColumn("mins_since_prev", F.floor(F.col("secs") / 60))
    )


def as_set(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("policy", [HotKeys(), SLICED, EVERY_ROW, SAMPLED])
@pytest.mark.parametrize("gap", [30, 1800])
def test_sliced_sessions_equal_plain_ones(spark, policy, gap):
    df = with_missing_times(random_events(spark))
    columns = ["event_name", "device_id", "is_new_session", "session_num", "mins_since_prev"]
    got, want = sessionise(df, gap, policy), plain_sessions(df, gap)
    assert as_set(got, *columns) == as_set(want, *columns)


def brute_force(rows, gap):
    """Sessions, versions and their numbers by walking each device's events in order."""
    found = {}
    for device in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == device), key=lambda r: (r[1], r[2], r[3]))
        session = version = 0
        before = None
        for r in mine:
            session += before is None or int(r[1] - before[1]) > gap
            version += before is None or r[4] != before[4]
            found[r[3]] = (session, version)
            before = r
    return found


@pytest.mark.parametrize("policy", [HotKeys(), SLICED])
def test_against_brute_force(spark, policy):
    rng = random.Random(7)
    rows = [
        (rng.choice("aaabcd"), rng.randrange(60_000), str(rng.randrange(9)), f"e{i}",
         rng.choice("xyz"))
        for i in range(600)
    ]
    df = events(spark, rows)
    want = brute_force(rows, 600)
    sessions = {r.event_name: r.session_num for r in sessionise(df, 600, policy).collect()}
    assert sessions == {name: n for name, (n, _) in want.items()}
    last_versions = {}
    for device, *_, name, _ in rows:
        last_versions[device] = max(last_versions.get(device, 0), want[name][1])
    history = attribution_history(df, policy).groupBy("device_id").agg(F.max("version_num"))
    assert {r[0]: r[1] for r in history.collect()} == last_versions


def test_hot_keys_are_listed(spark):
    df = random_events(spark)
    found = {r[0] for r in hot_keys(df, "device_id", EVENT_ORDER, HotKeys(1, 4, 1)).collect()}
    assert found == {r[0] for r in df.select("device_id").distinct().collect()}
    assert hot_keys(df, "device_id", EVENT_ORDER, HotKeys()).count() == 0


def skewed(spark, kind, n=6000):
    """Mostly one key, whose rows crowd in one way or another."""
    t = {
        "burst": "if(id % 100 = 0, id * 1300, 4e6 + id * 0.0001)",
        "stray": "if(id < 5, id - 1.7e9, 5e6 + id * 0.5)",
        "no key": "id * 7.0",
        "no time": "cast(null as double)",
        "one instant": "1000.0",
        "many keys": "id * 3.0",
    }[kind]
    device = {"no key": "cast(null as string)", "many keys": "concat('d', id % 12)"}.get(kind, "if(id % 50 = 0, concat('d', id), 'hot')")
    return spark.range(n).selectExpr(
        f"{device} AS device_id",
        f"timestamp_micros(cast(({t}) * 1e6 + 1.7e15 as bigint)) AS time_stamp",
        "cast(id % 97 as string) AS session_id",
        "concat('e', id) AS event_name",
    )


@pytest.mark.parametrize("kind", ["burst", "stray", "no key", "no time", "one instant", "many keys"])
def test_slices_bound_a_task(spark, kind):
    df, rows = skewed(spark, kind), 100
    policy = HotKeys(min_rows=400, slice_rows=rows, counted_one_in=1)
    sliced = with_slices(df, "device_id", EVENT_ORDER, policy)
    sizes = sliced.groupBy("device_id", "_slice").count()
    assert sliced.count() == df.count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * rows
    # Slices rise with the order.
    w = Window.partitionBy("device_id").orderBy(*EVENT_ORDER)
    falls = sliced.withColumn("b", F.lag("_slice").over(w)).where("b > _slice")
    assert falls.count() == 0


@pytest.mark.parametrize("kind", ["one minute", "one instant", "no time"])
def test_windows_over_counts_are_bounded_too(spark, kind):
    """A million places of one key, all within a minute, at one instant, or without a time."""
    n, rows = 1_000_000, 5_000
    at = {"one minute": "1.7e15 + id * 59", "one instant": "1.7e15", "no time": "cast(null as bigint)"}[kind]
    df = spark.range(n).selectExpr(
        "'hot' AS device_id", f"timestamp_micros(cast({at} as bigint)) AS time_stamp", "cast(1000000 + id div 9 as string) AS session_id", "concat('e', id % 9) AS event_name"
    )
    policy = HotKeys(min_rows=100_000, slice_rows=rows)
    levels = slice_cells(df, "device_id", EVENT_ORDER, policy, hot_keys(df, "device_id", EVENT_ORDER, policy))
    for _, cells in levels:
        assert cells.groupBy("_cell_key", "_cell_parent").count().agg(F.max("count")).first()[0] <= 2 * rows
    sliced = with_slices(df, "device_id", EVENT_ORDER, policy)
    sizes = sliced.groupBy("device_id", "_slice").agg(F.count("*").alias("n"), F.min(F.struct(*EVENT_ORDER)).alias("a"), F.max(F.struct(*EVENT_ORDER)).alias("b"))
    found = sizes.orderBy("_slice").collect()
    assert sum(r.n for r in found) == n and max(r.n for r in found) <= 2 * rows
    if kind == "one minute":
        assert all(x.b < y.a for x, y in zip(found, found[1:]))
    else:
        assert all((x.b.session_id, x.b.event_name) < (y.a.session_id, y.a.event_name) for x, y in zip(found, found[1:]))


@pytest.mark.parametrize("kind", ["burst", "stray", "no key", "no time", "many keys"])
def test_skewed_sessions_equal_plain_ones(spark, kind):
    df = skewed(spark, kind, 3000)
    for c in random_events(spark, 10).columns:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(random_events(spark, 10).schema[c].dataType))
    policy = HotKeys(min_rows=400, slice_rows=100, counted_one_in=1)
    columns = ["event_name", "device_id", "is_new_session", "session_num", "mins_since_prev"]
    got, want = sessionise(df, 600, policy), plain_sessions(df, 600)
    assert as_set(got, *columns) == as_set(want, *columns)


def test_asof_matches_no_missing_key_or_time(spark):
    versions = spark.createDataFrame(
        [("a", 1, T0, None), (None, 2, T0, None), ("b", 3, None, None)],
        "device_id string, version_num int, valid_from timestamp, valid_to timestamp",
    )
    facts = spark.createDataFrame(
        [("a", T0), (None, T0), ("a", None), ("b", T0), (None, None)],
        "device_id string, at timestamp",
    )
    got = asof_join(facts, versions, "device_id", "at", ["version_num"]).collect()
    assert len(got) == 5
    assert {(r.device_id, r["at"]): r.version_num for r in got if r.version_num} == {("a", T0): 1}


def plain_history(df):
    w = Window.partitionBy("device_id").orderBy(*EVENT_ORDER)
    keyed = df.withColumn("key", traffic_key())
    change = F.when(F.col("key") == F.lag("key").over(w), 0).otherwise(1)
    versions = (
        keyed.withColumn("change", change)
        .withColumn("version_num", F.sum("change").over(w))
        .groupBy("device_id", "version_num")
        .agg(F.min("time_stamp").alias("valid_from"), F.min("medium").alias("medium"))
    )
    by_version = Window.partitionBy("device_id").orderBy("version_num")
    return versions.withColumn("valid_to", F.lead("valid_from").over(by_version))


@pytest.mark.parametrize("policy", [HotKeys(), SLICED, EVERY_ROW, SAMPLED])
def test_history_equals_plain_one(spark, policy):
    df = random_events(spark, 1500, seed=2)
    columns = ["device_id", "version_num", "valid_from", "valid_to", "medium"]
    got = attribution_history(df, policy)
    assert as_set(got, *columns) == as_set(plain_history(df), *columns)
    current = got.where("is_current = 1").groupBy("device_id").count()
    assert current.where("count <> 1").count() == 0


def test_return_to_a_source_is_a_new_version(spark):
    rows = [("a", s, "1", "x", m) for s, m in ((0, "p"), (1, "p"), (2, "q"), (3, "p"))]
    got = attribution_history(events(spark, rows)).orderBy("version_num").collect()
    assert [(r.medium, r.is_current) for r in got] == [("p", 0), ("q", 0), ("p", 1)]
    assert [r.valid_to for r in got] == [got[1].valid_from, got[2].valid_from, None]


@pytest.mark.parametrize("policy", [HotKeys(), SLICED, EVERY_ROW, SAMPLED])
def test_asof_equals_range_join(spark, policy):
    versions = attribution_history(random_events(spark, 400, seed=3))
    facts = random_events(spark, 900, seed=4).select("device_id", "time_stamp", "event_name")
    got = asof_join(facts, versions, "device_id", "time_stamp", ["version_num"], policy=policy)
    v = versions.select(
        F.col("device_id").alias("d"), "version_num", "valid_from", "valid_to"
    )
    at = F.col("time_stamp")
    within = (at >= F.col("valid_from")) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    want = facts.join(v, (F.col("device_id") == F.col("d")) & within, "left")
    columns = ["event_name", "device_id", "time_stamp", "version_num"]
    assert as_set(got, *columns) == as_set(want, *columns)


def test_asof_upper_bound_is_excluded(spark):
    versions = spark.createDataFrame(
        [("a", 1, T0, T0 + timedelta(seconds=5)),
         ("a", 2, T0 + timedelta(seconds=9), T0 + timedelta(seconds=12))],
        "device_id string, version_num int, valid_from timestamp, valid_to timestamp",
    )
    facts = spark.createDataFrame(
        [("a", T0 + timedelta(seconds=s)) for s in (-1, 0, 4, 5, 9, 12)] + [("b", T0)],
        "device_id string, at timestamp",
    )
    got = asof_join(facts, versions, "device_id", "at", ["version_num"])
    second = lambda r: int((r["at"] - T0).total_seconds())
    found = {(r.device_id, second(r)): r.version_num for r in got.collect()}
    assert found == {
        ("a", -1): None, ("a", 0): 1, ("a", 4): 1, ("a", 5): None, ("a", 9): 2, ("a", 12): None,
        ("b", 0): None,
    }


def test_session_properties(spark, folder):
    facts = rolled(staged(spark, folder))
    assert facts.count() == 946
    assert facts.agg(F.sum("event_count")).first()[0] == 1000
    numbered = session_rollup(sessionise(staged(spark, folder)))
    per_device = numbered.groupBy("device_id").agg(
        F.min("session_num").alias("lo"), F.max("session_num").alias("hi"), F.count("*").alias("n")
    )
    assert per_device.where("lo <> 1 or hi <> n").count() == 0


def test_device_takes_latest_values(spark, folder):
    df = staged(spark, folder)
    w = Window.partitionBy("device_id").orderBy(*[F.desc(c) for c in EVENT_ORDER])
    latest = df.withColumn("n", F.row_number().over(w)).where("n = 1")
    assert as_set(devices(df), "device_id", "device") == as_set(latest, "device_id", "device")


def test_events_are_shuffled_once(spark):
    """Windows and running number share one exchange of the events; no pairs are formed."""
    df = random_events(spark)
    plan = sessionise(df)._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    sessionise(df).write.format("noop").mode("overwrite").save()
    done = sessionise(df)
    done.collect()
    final = done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # No key is hot: only the (tiny) list of hot keys and the events themselves are exchanged.
    assert final.count("hashpartitioning(device_id") <= 4
    assert "SortMergeJoin" not in final

"""The log of versions: what it stores, and that no run or compaction changes what is read."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sessionloom.operators.snapshot import SnapshotStore
from sessionloom.operators.snapshot_log import SnapshotLog
from sessionloom.sources.tables import work_folder
from tests.test_snapshot import state

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
STATES = [dict(d1="A", d2="B", gone="A"), dict(d1="C", d2="B", d3="A"), dict(d1="C", d2="B", d3="A"), dict(d1="A", d2="Z", d3="A", d4="Q"), dict(d1="A", d4="R")]


def at(n):
    return T0 + timedelta(days=n)


def shown(df):
    return sorted(map(str, df.collect()))


def stored_rows(log):
    return sum(df.count() for name, df in log._tables().items() if name != "base")


@pytest.mark.parametrize("compactions", [(), (1, 3)])
def test_every_run_can_be_read_before_and_after_compaction(spark, compactions):
    plain = SnapshotStore(spark, work_folder(spark, "plain"))
    log = SnapshotLog(spark, work_folder(spark, "log"))
    assert log.read().count() == 0
    want = []
    for n, sources in enumerate(STATES):
        plain.run(state(spark, **sources), at(n))
        log.run(state(spark, **sources), at(n))
        want.append(shown(plain.read()))
        if n in compactions:
            log.compact()
        assert shown(log.read()) == want[-1]
    for n, rows in enumerate(want):
        assert shown(log.read(at(n))) == rows
        assert shown(log.read(at(n) + timedelta(hours=5))) == rows
    assert log.read(at(-1)).count() == 0


def test_storage_stays_at_one_set_without_changes(spark):
    log = SnapshotLog(spark, work_folder(spark, "log"))
    current = state(spark, **{f"d{i}": "A" for i in range(50)})
    for n in range(5):
        log.run(current, at(n))
        if n == 2:
            log.compact()
        assert stored_rows(log) == 50
    buckets = log.store.manifest()["open"]["parts"]
    log.run(state(spark, **({f"d{i}": "A" for i in range(50)} | {"d7": "B"})), at(9))
    assert stored_rows(log) == 52
    log.compact()
    after = log.store.manifest()["open"]["parts"]
    assert sum(buckets[b] != after[b] for b in buckets) == 1  # the bucket of d7
    assert stored_rows(log) == 51 and log.read().where("valid_to IS NULL").count() == 50


def test_runs_are_repeated_but_not_out_of_turn(spark):
    log = SnapshotLog(spark, work_folder(spark, "log"))
    log.run(state(spark, d1="A"), at(0))
    log.run(state(spark, d1="B"), at(1))
    log.run(state(spark, d1="A", d2="C"), at(1))
    assert sorted((r.device_id, r.traffic_source_key) for r in log.read().collect()) == [("d1", "A"), ("d2", "C")]
    with pytest.raises(ValueError):
        log.run(state(spark, d1="A"), at(0))
    log.compact()
    with pytest.raises(ValueError):
        log.run(state(spark, d1="A"), at(1))
    log.run(state(spark, d1="B"), at(2))
    assert log.read().where("valid_to IS NULL").count() == 2


def test_no_device_and_an_empty_one_are_two(spark):
    log = SnapshotLog(spark, work_folder(spark, "log"))
    both = state(spark, none="A", empty="A").withColumn("device_id", F.when(F.col("device_id") == "empty", ""))
    log.run(both, at(0))
    log.run(both.withColumn("traffic_source_key", F.when(F.col("device_id").isNull(), "B").otherwise("A")), at(1))
    found = log.read()
    assert found.count() == 3 and found.select("attribution_version_key").distinct().count() == 3
    assert {r.device_id for r in found.where("valid_to IS NULL AND traffic_source_key = 'A'").collect()} == {""}

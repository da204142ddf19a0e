from datetime import datetime, timezone

from pyspark.sql import functions as F

from sessionloom.operators.snapshot import SnapshotStore, attribution_dimension
from sessionloom.sources.tables import overwrite_partitions, work_folder

RUN1 = datetime(2024, 1, 1, tzinfo=timezone.utc)
RUN2 = datetime(2024, 1, 2, tzinfo=timezone.utc)


def state(spark, **sources):
    rows = [(d, s, s, s, s, datetime(2023, 12, 31)) for d, s in sources.items()]
    return spark.createDataFrame(
        rows,
        "device_id string, traffic_source_key string, medium string, traffic_source string, "
        "source_name string, attributed_at timestamp",
    )


def versions(store):
    rows = attribution_dimension(store.read()).orderBy("device_id", "valid_from").collect()
    return [(r.device_id, r.traffic_source_key, r.valid_from.day, r.is_current) for r in rows]


def test_two_runs(spark):
    store = SnapshotStore(spark, work_folder(spark, "snapshot"))
    assert store.read().count() == 0
    store.run(state(spark, d1="A", d2="B", gone="A"), RUN1)
    assert versions(store) == [("d1", "A", 1, 1), ("d2", "B", 1, 1), ("gone", "A", 1, 1)]
    second = state(spark, d1="C", d2="B", d3="A")
    expected = [
        ("d1", "A", 1, 0), ("d1", "C", 2, 1), ("d2", "B", 1, 1), ("d3", "A", 2, 1),
        ("gone", "A", 1, 1),
    ]
    store.run(second, RUN2)
    assert versions(store) == expected
    store.run(second, RUN2)  # repeated, as after a failure
    assert versions(store) == expected
    closed = store.read().where("valid_to is not null").first()
    assert closed.valid_to.replace(tzinfo=timezone.utc) == RUN2 or closed.valid_to.day == 2


def test_null_safe_comparison(spark):
    store = SnapshotStore(spark, work_folder(spark, "snapshot"))
    none = state(spark, d1="A").withColumn("traffic_source_key", F.lit(None).cast("string"))
    store.run(none, RUN1)
    store.run(none, RUN2)
    assert store.read().count() == 1
    store.run(state(spark, d1="A"), datetime(2024, 1, 3, tzinfo=timezone.utc))
    assert store.read().count() == 2


def test_half_finished_run_is_ignored(spark):
    store = SnapshotStore(spark, work_folder(spark, "snapshot"))
    store.run(state(spark, d1="A"), RUN1)
    partial = store.read().withColumn("snapshot_run", F.lit(10**18))
    overwrite_partitions(partial, store.closed_path, "snapshot_run")
    assert versions(store) == [("d1", "A", 1, 1)]

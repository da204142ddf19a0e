"""What the plans read and move, and whole builds."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sessionloom.config import Settings
from sessionloom.operators.runs import HotKeys
from sessionloom.operators.staging import stage_events
from sessionloom.plans.build import build, build_window
from sessionloom.plans.queries import WINDOW, staged
from sessionloom.sources.adapter import raw_export
from sessionloom.sources.export import read_export, read_sharded_export, write_export
from sessionloom.sources.tables import overwrite_partitions, overwrite_table, work_folder


@pytest.fixture(scope="module")
def export(spark, folder):
    root = work_folder(spark, "export")
    write_export(raw_export(spark, folder, with_items=True), root)
    return root


def formatted(df):
    mode = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_only_asked_days_and_fields_are_read(spark, export):
    df = stage_events(read_export(spark, export, *WINDOW)).select("device_id", "session_id")
    plan = formatted(df)
    assert f"(event_date#" in plan.split("PartitionFilters")[1] and WINDOW[0] in plan
    schema = plan.split("ReadSchema: ")[1].splitlines()[0]
    assert schema == (
        "struct<user_pseudo_id:string,event_params:array<struct<key:string,"
        "value:struct<int_value:bigint>>>>"
    )
    assert "Exchange" not in plan


def test_window_holds_just_its_days(spark, export):
    days = read_export(spark, export, "20240105", "20240107").select("event_date").distinct()
    assert sorted(r[0] for r in days.collect()) == ["20240105", "20240106", "20240107"]
    none = read_export(spark, export, "20300101", "20300102")
    assert none.count() == 0


def test_missing_shards_are_skipped(spark, folder):
    root = work_folder(spark, "shards")
    raw = raw_export(spark, folder).where(F.col("event_date").isin("20240102", "20240104"))
    overwrite_partitions(raw.withColumn("events_day", F.col("event_date")), root, "events_day")
    got = read_sharded_export(spark, root, "20240101", "20240104", prefix="events_day=")
    assert got.count() == raw.count() > 0


def test_table_round_trip_keeps_types_and_nulls(spark, folder):
    df = staged(spark, folder).withColumn(
        "event_date", F.when(F.col("device") != "tablet", F.col("event_date"))
    )
    again = overwrite_table(df, work_folder(spark, "table"), "event_date")
    assert again.dtypes == df.dtypes
    assert again.exceptAll(df).count() == 0 and df.exceptAll(again).count() == 0


def test_partitions_not_written_stay(spark):
    path = work_folder(spark, "parts")
    overwrite_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "d int, v string"), path, "d")
    overwrite_partitions(spark.createDataFrame([(2, "c")], "d int, v string"), path, "d")
    assert sorted(map(tuple, spark.read.parquet(path).select("d", "v").collect())) == [
        (1, "a"), (2, "c")
    ]


def test_build_with_cut_keys_equals_plain_build(spark, export):
    settings = Settings(start_date=WINDOW[0], end_date=WINDOW[1])
    plain = build_window(spark, export, work_folder(spark, "plain"), settings)
    cut = build_window(
        spark, export, work_folder(spark, "cut"), settings, HotKeys(20, 5, counted_one_in=1)
    )
    for name in ("fct_sessions", "fct_events", "attribution_history", "rpt_funnel_weekly"):
        assert plain[name].count() > 0
        assert plain[name].exceptAll(cut[name]).count() == 0, name
    days = plain["dim_date"].agg(F.min("date_day"), F.max("date_day"), F.count("*")).first()
    assert (str(days[0]), str(days[1]), days[2]) == ("2024-01-08", "2024-01-21", 14)


def test_rebuild_replaces_the_tables(spark, export):
    root = work_folder(spark, "again")
    build(read_export(spark, export, "20240101", "20240131"), root, whole_span=True)
    build(read_export(spark, export, "20240103", "20240103"), root, whole_span=True)
    assert spark.read.parquet(f"{root}/stg_events").select("event_date").distinct().count() == 1


def test_work_folder_follows_the_cluster_setting():
    def session(master, **settings):
        get = lambda name, default: settings.get(name.replace(".", "_"), default)
        return SimpleNamespace(
            conf=SimpleNamespace(get=get), sparkContext=SimpleNamespace(master=master)
        )

    cluster = session("spark://host", spark_checkpoint_dir="hdfs://shared/work/")
    assert work_folder(cluster, "x").startswith("hdfs://shared/work/x-")
    with pytest.raises(ValueError):
        work_folder(session("spark://host"), "x")

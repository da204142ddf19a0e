"""Days of the export are picked ahead of its joins."""

from datetime import datetime

from pyspark.sql import functions as F

from sessionloom.session import configure
from sessionloom.sources.adapter import SCHEMAS, raw_export


def _tables(spark, folder):
    rows = {
        "events": [(n, datetime(2024, 1, 1 + n % 4, 23, 59, n % 60), n % 3 if n % 5 else None, ("view", "click", "purchase")[n % 3], 1.5, f'{{"k": {n % 9}}}') for n in range(60)],
        "customer": [(n, f"C{n}", n, 1.0, "AUTO") for n in range(3)],
        "nation": [(n, f"N{n}", 0) for n in range(3)],
        "region": [(0, "R")],
        "part": [(n, f"part {n}", "B", "T", n, 2.0) for n in range(7)],
    }
    for name, values in rows.items():
        spark.createDataFrame(values, SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_days_of_an_export_are_the_rows_of_the_whole_with_those_days(spark, tmp_path):
    folder = _tables(configure(spark), tmp_path)
    whole = raw_export(spark, folder, with_items=True).where(F.col("event_date").between("20240102", "20240103"))
    some = raw_export(spark, folder, with_items=True, days=("20240102", "20240103"))
    assert some.count() == 30 and some.where("size(items) > 0").count() > 0
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.collect()))

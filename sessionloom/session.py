"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Times are UTC; local timestamps and date texts are read as such.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: small sides become broadcasts, skewed join partitions are split, and
    # the hot-key branch is dropped when no key is hot.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot does not compile methods above this size. Wide projections beyond it are better
    # off as split, compiled functions than as one interpreted method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
# Fixed when a session starts: no call-site capture per column expression.
STARTUP_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session; all can be changed at run time."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark

"""Run-time SCD Type 2 as a log: a run appends the versions it opens and closes, nothing else.

Tables of a TableStore, changed as one:

* ``open``: the versions open at the base run, in buckets by a hash of the device;
* ``closed``: versions closed up to the base run, by the compaction that put them there;
* ``log``: versions opened and closed since, by run (a closed version comes with its end);
* ``base``: the run up to which the log has been compacted.

A run reads the open versions and the log, never the closed ones. Compaction moves the log into the
base and writes only buckets whose devices changed. Versions carry the times of the runs that
opened and closed them, so the state after any run can be read before and after a compaction.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators.snapshot import KEY, VERSION, no_versions, run_micros, snapshot_changes
from sessionloom.sources.versions import Change, TableStore

BUCKETS = 32
RUN = "snapshot_run"


def _bucketed(versions: DataFrame) -> DataFrame:
    return versions.withColumn("bucket", F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).cast("int"))


class SnapshotLog:
    """Version history whose storage grows with changes, not with runs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.store = TableStore(spark, root)

    def _change(self) -> Change:
        change = self.store.change()
        if not change.tables:
            none = no_versions(self.spark)
            change.write("open", _bucketed(none), "bucket")
            change.write("closed", none.withColumn("closed_in", F.lit(0).cast("bigint")), "closed_in")
            change.write("log", none.withColumn(RUN, F.lit(0).cast("bigint")), RUN)
            change.write("base", self.spark.createDataFrame([(0,)], f"{RUN} bigint"))
        return change

    def _tables(self) -> dict[str, DataFrame] | None:
        manifest = self.store.manifest()
        return {t: self.store._table(t, manifest) for t in manifest} or None

    @staticmethod
    def _since_base(opened: DataFrame, log: DataFrame, run_id: int | None = None) -> DataFrame:
        """Versions open at the base or opened since, up to before a run, each with its end."""
        before = log if run_id is None else log.where(F.col(RUN) < run_id)
        new = before.where(F.col("valid_to").isNull()).select(*VERSION)
        ends = before.where(F.col("valid_to").isNotNull()).select("attribution_version_key", F.col("valid_to").alias("_end"))
        versions = opened.select(*VERSION).unionByName(new).join(ends, "attribution_version_key", "left")
        return versions.withColumn("valid_to", F.col("_end")).select(*VERSION)

    def run(self, current: DataFrame, run_at: datetime) -> None:
        """Record a run; the last one can be repeated with the same time and is replaced.

        Earlier ones can't: later runs were compared with what they left.
        """
        run_id = run_micros(run_at)
        change = self._change()
        runs = [int(v) for v in change.tables["log"]["parts"]]
        base = change.read("base").first()[0]
        if run_id <= base or any(r > run_id for r in runs):
            raise ValueError("a later run has been recorded, or this one compacted")
        versions = self._since_base(change.read("open"), change.read("log"), run_id)
        after = snapshot_changes(versions.where(F.col("valid_to").isNull()), current, run_at)
        at = F.lit(run_at).cast("timestamp")
        changed = after.where((F.col("valid_from") == at) | (F.col("valid_to") == at))
        change.write("log", changed.withColumn(RUN, F.lit(run_id).cast("bigint")), RUN, replace=[run_id])
        change.commit()

    def read(self, at: datetime | None = None) -> DataFrame:
        """The whole history now, or as the runs up to ``at`` left it."""
        tables = self._tables()
        if tables is None:
            return no_versions(self.spark)
        versions = self._since_base(tables["open"], tables["log"]).unionByName(tables["closed"].select(*VERSION))
        if at is None:
            return versions
        until = F.lit(at).cast("timestamp")
        end = F.when(F.col("valid_to") <= until, F.col("valid_to")).alias("valid_to")
        return versions.where(F.col("valid_from") <= until).select(*[end if c == "valid_to" else c for c in VERSION])

    def compact(self) -> None:
        """Move the log into the base. Buckets without a change in it are not written."""
        change = self._change()
        runs = [int(v) for v in change.tables["log"]["parts"]]
        if not runs:
            return
        log = change.read("log")
        versions = self._since_base(change.read("open"), log)
        buckets = [r[0] for r in _bucketed(log).select("bucket").distinct().collect()]
        still = _bucketed(versions.where(F.col("valid_to").isNull())).where(F.col("bucket").isin(buckets))
        ended = versions.where(F.col("valid_to").isNotNull())
        change.write("closed", ended.withColumn("closed_in", F.lit(max(runs)).cast("bigint")), "closed_in", replace=[max(runs)])
        change.write("open", still, "bucket", replace=buckets)
        change.write("log", log.limit(0), RUN, replace=runs)
        change.write("base", self.spark.createDataFrame([(max(runs),)], f"{RUN} bigint"))
        change.commit()

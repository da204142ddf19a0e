"""A build that is refreshed by day: what a day's new events don't change is not done again.

Sessions and versions run on from day to day, so the days of a device are slices like those of a
hot device (operators.runs): each day keeps what its successors need, first and last time, session
numbers, latest attributes, openings of versions, and a refresh works on those rows:

* devices whose events in the refreshed days are the same rows as before are left alone;
* the others are sessionised again from a day at which all earlier events come before all later
  ones, with the state the day before left, up to such a day after the refreshed ones;
* there the first later event tells whether numbering agrees with what is stored. If it does, later
  days stay; if not, their events move by one and the same number, without being sorted again;
* sessions are merged from their parts per day, so one over midnight needs no events of other days.

Partitions with changed rows are written anew in full. All tables of a build or refresh become
visible together (sources.versions), and only if their rows pass the checks.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sessionloom.config import EVENT_ORDER, TRAFFIC, Settings
from sessionloom.functions import surrogate_key
from sessionloom.functions.keys import traffic_key
from sessionloom.operators.checks import BUILD_CHECKS, Check
from sessionloom.operators.dims import DEVICE_COLUMNS, calendar, calendar_of, traffic_sources
from sessionloom.operators.history import attribution_history
from sessionloom.operators.items import item_facts
from sessionloom.operators.runs import HotKeys, number_runs
from sessionloom.operators.sessions import event_facts, merged_parts, session_facts, session_parts, sessionise
from sessionloom.operators.staging import stage_events
from sessionloom.plans.reports import funnel_report, product_report, weekly_report
from sessionloom.sources.tables import overwrite_table, work_folder
from sessionloom.sources.versions import Change, TableStore, days_of

DAY = "event_date"
#: Partitions of the tables that hold a device's rows of all days, by a hash of the device.
BUCKETS = 32
#: Checks a build must pass to be committed; test data may lack some columns' values by intent.
ROW_CHECKS = tuple(c for c in BUILD_CHECKS if c.kind in ("not_null", "accepted_values"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("device_id"), F.lit(BUCKETS)).cast("int")


def _place() -> Column:
    return F.struct(*EVENT_ORDER)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _splits(before: Column, now: Column, gap_seconds: int) -> Column:
    """Does an event open a session, given the time of the one before? Also where a time is missing."""
    return F.coalesce(F.timestamp_diff("SECOND", before, now) > gap_seconds, F.lit(True))


def _minutes(before: str, now: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, {before}, {now}) div 60")


# --- tables of the days -------------------------------------------------------------------------


def device_days(sessionised: DataFrame) -> DataFrame:
    """Per device and day what later days go on from, and its latest attributes."""
    return sessionised.groupBy("device_id", DAY).agg(
        F.min("time_stamp").alias("first_time"),
        F.max("time_stamp").alias("last_time"),
        F.max(F.col("time_stamp").isNull()).alias("untimed"),
        F.min("session_num").alias("first_num"),
        F.max("session_num").alias("last_num"),
        F.min(_place()).alias("first_place"),
        F.min_by("is_new_session", _place()).alias("opens"),
        F.min_by("mins_since_prev", _place()).alias("first_mins"),
        F.max(_place()).alias("last_place"),
        F.max_by(F.struct(*DEVICE_COLUMNS), _place()).alias("attributes"),
    )


def version_heads(staged: DataFrame, policy: HotKeys = HotKeys()) -> DataFrame:
    """Events that differ in traffic source or day from the device's event before them.

    Leaving the others out changes no run, as long as a device's days come one after another.
    """
    named = staged.select("device_id", DAY, *EVENT_ORDER, *TRAFFIC, F.concat(traffic_key(), F.col(DAY).cast("string")).alias("_of"))
    runs = number_runs(
        named, "device_id", EVENT_ORDER, "_of", lambda now, before: now != before,
        previous="_previous", flag="_opens", number="_run", policy=policy,
    )
    return runs.where(F.col("_opens") == 1).select("device_id", DAY, *EVENT_ORDER, *TRAFFIC)


def _by_device(days: DataFrame) -> DataFrame:
    """dim_devices from the days' latest attributes."""
    latest = days.groupBy("device_id").agg(F.max_by("attributes", "last_place").alias("last"))
    return latest.select("device_id", *[F.col(f"last.{c}").alias(c) for c in DEVICE_COLUMNS], _bucket().alias("bucket"))


def _history(events: DataFrame, policy: HotKeys) -> DataFrame:
    return attribution_history(events, policy).withColumn("bucket", _bucket())


def _cuts(days: DataFrame) -> DataFrame:
    """days with ``clean``: all events of the device's earlier days come before all of this and later ones.

    Events without a time come first, so only a device's first days may hold some. A window holds
    a row per day of a device.
    """
    w = Window.partitionBy("device_id").orderBy(DAY)
    earlier, later = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    before = F.max("last_time").over(earlier)
    return days.select(
        "*",
        before.alias("before_time"),
        F.max("last_num").over(earlier).alias("before_num"),
        (F.row_number().over(w) == 1).alias("_first"),
        (~F.max("untimed").over(later) & (before.isNull() | (before < F.min("first_time").over(later)))).alias("_after"),
    ).select("*", (F.col("_first") | F.coalesce("_after", F.lit(False))).alias("clean")).drop("_first", "_after")


# --- a whole build ------------------------------------------------------------------------------


def full_build(
    store: TableStore,
    raw: DataFrame,
    settings: Settings = Settings(),
    policy: HotKeys = HotKeys(),
    whole_span: bool = False,
    checks: tuple[Check, ...] = (),
) -> int:
    """All tables anew from an export; the version they are committed as."""
    change = store.change()
    staged = change.write("stg_events", stage_events(raw), DAY, checks=checks)
    sessionised = change.write("events_sessionised", sessionise(staged, settings.gap_seconds, policy), DAY, checks=checks)
    days = change.write("device_days", device_days(sessionised), DAY)
    parts = change.write("session_parts", session_parts(sessionised, DAY), DAY)
    rollup = change.write("session_rollup", merged_parts(parts), "session_date")
    change.write("fct_sessions", session_facts(rollup), "session_date", checks=checks, in_order=True)
    change.write("fct_events", event_facts(sessionised), DAY, checks=checks, in_order=True)
    change.write("fct_event_items", item_facts(sessionised), DAY, checks=checks, in_order=True)
    change.write("dim_devices", _by_device(days), "bucket", checks=checks)
    change.write("traffic_days", staged.select(DAY, *TRAFFIC).distinct(), DAY)
    heads = change.write("version_heads", version_heads(staged, policy), DAY)
    mixed = _mixed_devices(days)
    change.write("attribution_history", _history(_history_events(heads, staged, mixed), policy), "bucket", checks=checks)
    _small_tables(change, settings, whole_span, checks)
    return change.commit()


def _mixed_devices(days: DataFrame) -> DataFrame:
    """Devices whose days overlap in time."""
    return _cuts(days).where(~F.col("clean")).select(F.col("device_id").alias("_mixed")).distinct()


def _history_events(heads: DataFrame, staged: DataFrame, mixed: DataFrame) -> DataFrame:
    """Enough events for the history: openings by day, all events of devices whose days overlap."""
    on = _same("device_id", "_mixed")
    columns = ["device_id", *EVENT_ORDER, *TRAFFIC]
    return heads.join(mixed, on, "left_anti").select(*columns).unionByName(
        staged.join(mixed, on, "left_semi").select(*columns)
    )


def _small_tables(change: Change, settings: Settings, whole_span: bool, checks: tuple[Check, ...]) -> None:
    """Tables that are aggregates of others throughout: sources, calendar, reports."""
    spark = change.store.spark
    sources = change.write("dim_traffic_source", traffic_sources(change.read("traffic_days")), checks=checks)
    span = calendar_of(change.read("traffic_days")) if whole_span else calendar(spark, settings.start_date, settings.end_date)
    change.write("dim_date", span, checks=checks)
    sessions, devices = change.read("fct_sessions"), change.read("dim_devices").drop("bucket")
    change.write("rpt_funnel", funnel_report(sessions, devices, sources, settings), checks=checks)
    change.write("rpt_funnel_weekly", weekly_report(sessions, settings), checks=checks)
    change.write("rpt_product_funnel", product_report(change.read("fct_event_items"), settings=settings), checks=checks)


# --- a refresh ----------------------------------------------------------------------------------


def _kept(df: DataFrame, name: str) -> DataFrame:
    return overwrite_table(df, work_folder(df.sparkSession, name))


def changed_devices(old: DataFrame, new: DataFrame) -> DataFrame:
    """Devices (_device) whose rows are not the same in both, by counts and sums of row hashes."""

    def digest(df: DataFrame, name: str) -> DataFrame:
        row = F.xxhash64(*sorted(df.columns))
        both = F.struct(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("rows"))
        return df.groupBy(F.col("device_id").alias(f"_{name}")).agg(both.alias(name))

    both = digest(old, "old").join(digest(new, "new"), _same("_old", "_new"), "full")
    differs = both.where(~F.col("old").eqNullSafe(F.col("new")))
    return differs.select(F.when(F.col("old").isNull(), F.col("_new")).otherwise(F.col("_old")).alias("_device"))


def _regions(days: DataFrame, redone: DataFrame, touched: DataFrame, start: date, end: date) -> DataFrame:
    """Per touched device where it is sessionised again and what comes before and after.

    ``days`` are stored, ``redone`` new rows of the refreshed days. (_device; begin, stop: the days
    done again are begin <= day < stop, NULL without later ones; before_time, before_num: what the
    events before leave; old_*: the first event from ``stop`` on, as it is stored.)
    """
    mine = days.join(touched, _same("device_id", "_device"), "left_semi")
    inside = F.col(DAY).between(F.lit(start), F.lit(end))
    times = ["device_id", DAY, "first_time", "last_time", "untimed"]
    stored = mine.select(*times, "first_num", "last_num", "opens", "first_mins", "first_place", F.lit(False).alias("is_new"))
    fresh = redone.groupBy("device_id", DAY).agg(
        F.min("time_stamp").alias("first_time"),
        F.max("time_stamp").alias("last_time"),
        F.max(F.col("time_stamp").isNull()).alias("untimed"),
    ).withColumn("is_new", F.lit(True))
    both = stored.unionByName(fresh, allowMissingColumns=True)
    merged = both.groupBy("device_id", DAY).agg(
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
        F.max("untimed").alias("untimed"),
        *[F.max(c).alias(c) for c in ("first_num", "last_num", "opens", "first_mins", "first_place")],
    )
    cut = _cuts(merged)
    w = Window.partitionBy("device_id")
    changed_from = F.min(F.when(inside, F.col(DAY))).over(w)
    located = cut.withColumn("_from", changed_from)
    located = located.withColumn("begin", F.max(F.when(F.col("clean") & (F.col(DAY) <= F.col("_from")), F.col(DAY))).over(w))
    located = located.withColumn("stop", F.min(F.when(F.col("clean") & (F.col(DAY) > F.lit(end)), F.col(DAY))).over(w))
    at_begin, at_stop = F.col(DAY) == F.col("begin"), F.col(DAY) == F.col("stop")
    return located.groupBy(F.col("device_id").alias("_device")).agg(
        F.max("begin").alias("begin"),
        F.max("stop").alias("stop"),
        F.max(F.when(at_begin, F.col("before_time"))).alias("before_time"),
        F.coalesce(F.max(F.when(at_begin, F.col("before_num"))), F.lit(0)).alias("before_num"),
        *[F.max(F.when(at_stop, F.col(c))).alias(f"old_{c}") for c in ("first_time", "first_num", "opens", "first_mins", "first_place")],
    )


def _with_tails(regions: DataFrame, local: DataFrame, gap: int) -> DataFrame:
    """regions with what the sessions done again (numbered from 1 in ``local``) mean for later events."""
    done = local.groupBy(F.col("device_id").alias("_done")).agg(
        F.min("time_stamp").alias("_first"),
        F.max("time_stamp").alias("_last"),
        F.max(F.col("time_stamp").isNull()).alias("_untimed"),
        F.max("session_num").alias("_sessions"),
        F.count(F.lit(1)).alias("_events"),
    )
    joined = regions.join(done, _same("_device", "_done"), "left")
    # The days done again and the first event after them say by how much all later numbers move.
    some = F.col("_events").isNotNull()
    opens = F.when(F.col("_untimed"), F.lit(True)).otherwise(_splits(F.col("before_time"), F.col("_first"), gap))
    state = joined.withColumn("first_opens", opens.cast("int"))
    last = F.when(some, F.col("before_num") + F.col("_sessions") - 1 + F.col("first_opens")).otherwise(F.col("before_num"))
    state = state.withColumn("last_time", F.coalesce("_last", "before_time")).withColumn("last_num", last)
    tail = F.col("stop").isNotNull()
    state = state.withColumn("next_opens", F.when(tail, _splits(F.col("last_time"), F.col("old_first_time"), gap).cast("int")))
    state = state.withColumn("next_mins", F.when(tail, _minutes("last_time", "old_first_time")))
    state = state.withColumn("shift", F.col("last_num") + F.col("next_opens") - F.col("old_first_num"))
    first_differs = (F.col("next_opens") != F.col("old_opens")) | ~F.col("next_mins").eqNullSafe(F.col("old_first_mins"))
    never = F.lit(date(9999, 12, 31))
    return state.select(
        "_device",
        "begin",
        F.coalesce("stop", never).alias("stop"),
        F.when(~tail | (F.col("shift") != 0), never).when(first_differs, F.date_add("stop", 1)).otherwise(F.col("stop")).alias("until"),
        "before_time",
        "before_num",
        "first_opens",
        "next_opens",
        "next_mins",
        F.coalesce("shift", F.lit(0)).alias("shift"),
        F.col("old_first_place").alias("next_place"),
        # Sessions from before_num to here may differ; without bound where all later ones move.
        F.when(tail & (F.col("shift") == 0), F.col("old_first_num")).alias("last_changed"),
    )


def _as(df: DataFrame, schema: StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def _renumbered(local: DataFrame, state: DataFrame, schema: StructType) -> DataFrame:
    """Events done again, with the numbers that go on from the events before them."""
    joined = local.join(state, _same("device_id", "_device"))
    first = (F.col("session_num") == 1) & (F.col("is_new_session") == 1)
    number = F.col("before_num") + F.col("session_num") - 1 + F.col("first_opens")
    changed = joined.withColumns(
        {
            "is_new_session": F.when(first, F.col("first_opens")).otherwise(F.col("is_new_session")),
            "mins_since_prev": F.when(first, _minutes("before_time", "time_stamp")).otherwise(F.col("mins_since_prev")),
            "session_num": number,
        }
    )
    return _as(changed.withColumn("session_key", surrogate_key("device_id", "session_num")), schema)


def _moved(stored: DataFrame, state: DataFrame, schema: StructType) -> DataFrame:
    """Stored events after the ones done again whose number, or first event, changes."""
    later = (F.col(DAY) >= F.col("stop")) & (F.col(DAY) < F.col("until"))
    joined = stored.join(state, _same("device_id", "_device") & later)
    may_be_first = (F.col(DAY) == F.col("stop")) & _place().eqNullSafe(F.col("next_place"))
    # Of events equal in all of their place one is the first.
    nth = F.row_number().over(Window.partitionBy("device_id", "_may").orderBy(F.desc("is_new_session"), F.desc("mins_since_prev")))
    marked = joined.withColumn("_may", may_be_first)
    heads = marked.where("_may").withColumn("_first", nth == 1)
    both = heads.unionByName(marked.where("NOT _may").withColumn("_first", F.lit(False)))
    changed = both.withColumns(
        {
            "is_new_session": F.when(F.col("_first"), F.col("next_opens")).otherwise(F.col("is_new_session")),
            "mins_since_prev": F.when(F.col("_first"), F.col("next_mins")).otherwise(F.col("mins_since_prev")),
            "session_num": F.col("session_num") + F.col("shift"),
        }
    )
    return _as(changed.withColumn("session_key", surrogate_key("device_id", "session_num")), schema)


def refresh(
    store: TableStore,
    raw: DataFrame,
    start: str,
    end: str,
    settings: Settings = Settings(),
    policy: HotKeys = HotKeys(),
    whole_span: bool = False,
    checks: tuple[Check, ...] = (),
) -> int:
    """Take in the export's events of the days ``start`` to ``end`` ('yyyyMMdd'), in place of those stored.

    ``raw`` holds those days only. Afterwards all tables are what a full build would make of the
    stored days and these. Returns the version committed.
    """
    change = store.change()
    gap = settings.gap_seconds
    first, last = (datetime.strptime(d, "%Y%m%d").date() for d in (start, end))
    inside = F.col(DAY).between(F.lit(first), F.lit(last))

    old_staged, old_events, old_days = (change.read(t) for t in ("stg_events", "events_sessionised", "device_days"))
    old_inside = old_staged.where(inside)
    fresh = _kept(stage_events(raw).where(inside), "fresh")
    refreshed = sorted({*days_of(old_inside, DAY), *days_of(fresh, DAY)})
    staged = change.write("stg_events", fresh, DAY, replace=refreshed, checks=checks)
    if not refreshed:
        return change.commit()

    touched = _kept(changed_devices(old_inside, fresh), "touched")
    mine = fresh.join(touched, _same("device_id", "_device"), "left_semi")
    regions = _kept(_regions(old_days, mine, touched, first, last), "regions")
    low, high = regions.agg(F.min("begin"), F.max(F.coalesce("stop", F.lit(date(9999, 12, 31))))).first()
    if low is None:  # the same events again
        return change.commit()

    between = staged.where(F.col(DAY).between(F.lit(low), F.lit(high)))
    here = (F.col(DAY) >= F.col("begin")) & (F.col("stop").isNull() | (F.col(DAY) < F.col("stop")))
    redone = between.join(regions, _same("device_id", "_device") & here, "left_semi")
    local = _kept(sessionise(redone, gap, policy), "redone")
    state = _kept(_with_tails(regions, local, gap), "state")

    schema = old_events.schema
    later = old_events.where(F.col(DAY) > F.lit(last))
    new = _kept(_renumbered(local, state, schema).unionByName(_moved(later, state, schema)), "renumbered")
    replaced = _same("device_id", "_device") & (F.col(DAY) >= F.col("begin")) & (F.col(DAY) < F.col("until"))
    gone_days = days_of(old_days.join(state, replaced, "left_semi"), DAY)
    dirty = sorted({*refreshed, *gone_days, *days_of(new, DAY)})
    in_dirty = F.col(DAY).isin(dirty)
    stays = old_events.where(in_dirty).join(state, replaced, "left_anti")
    events = change.write("events_sessionised", stays.unionByName(new), DAY, replace=dirty, checks=checks).where(in_dirty)

    days = change.write("device_days", device_days(events), DAY, replace=dirty)
    parts = change.write("session_parts", session_parts(events, DAY), DAY, replace=dirty)
    change.write("fct_events", event_facts(events), DAY, replace=dirty, checks=checks, in_order=True)
    change.write("fct_event_items", item_facts(events), DAY, replace=dirty, checks=checks, in_order=True)
    change.write("traffic_days", fresh.select(DAY, *TRAFFIC).distinct(), DAY, replace=refreshed)
    heads = change.write("version_heads", version_heads(fresh, policy), DAY, replace=refreshed)

    _sessions(change, old_days, parts, state, checks)

    # A device's rows of all days: only buckets that hold touched devices.
    buckets = [r[0] for r in touched.select(F.pmod(F.xxhash64("_device"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
    is_touched, in_buckets = _same("device_id", "_device"), F.col("bucket").isin(buckets)
    my_days = days.join(touched, is_touched, "left_semi")
    others = change.read("dim_devices").where(in_buckets).join(touched, is_touched, "left_anti")
    change.write("dim_devices", others.unionByName(_by_device(my_days)), "bucket", replace=buckets, checks=checks)
    mixed = _mixed_devices(my_days)
    mine = _history_events(heads.join(touched, is_touched, "left_semi"), staged.join(touched, is_touched, "left_semi"), mixed)
    others = change.read("attribution_history").where(in_buckets).join(touched, is_touched, "left_anti")
    change.write("attribution_history", others.unionByName(_history(mine, policy)), "bucket", replace=buckets, checks=checks)
    _small_tables(change, settings, whole_span, checks)
    return change.commit()


def _sessions(change: Change, old_days: DataFrame, parts: DataFrame, state: DataFrame, checks: tuple[Check, ...]) -> None:
    """Merge the sessions that may differ from their parts, and write their days of the session tables."""
    among = (F.col("session_num") >= F.col("before_num")) & (F.col("last_changed").isNull() | (F.col("session_num") <= F.col("last_changed")))
    mine = _same("device_id", "_device") & among
    # The session that was open before may have begun days earlier; its days bound what is read.
    open_ = old_days.join(state, _same("device_id", "_device") & (F.col("last_num") >= F.col("before_num")))
    low = open_.agg(F.least(F.min(DAY), F.min("begin"))).first()[0]
    low = low or state.agg(F.min("begin")).first()[0]
    merged = _kept(merged_parts(parts.where(F.col(DAY) >= F.lit(low)).join(state, mine, "left_semi")), "sessions")
    old = change.read("session_rollup")
    dates = sorted({*days_of(old.join(state, mine, "left_semi"), "session_date"), *days_of(merged, "session_date")})
    in_dates = F.col("session_date").isin(dates)
    stays = old.where(in_dates).join(state, mine, "left_anti")
    rollup = change.write("session_rollup", stays.unionByName(merged), "session_date", replace=dates)
    change.write("fct_sessions", session_facts(rollup.where(in_dates)), "session_date", replace=dates, checks=checks, in_order=True)


#: Tables of a build that users read; the others serve refreshes.
TABLES = (
    "stg_events events_sessionised fct_sessions fct_events fct_event_items dim_devices dim_traffic_source dim_date "
    "attribution_history rpt_funnel rpt_funnel_weekly rpt_product_funnel"
).split()


def tables(store: TableStore, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a build, now or at an earlier version."""
    manifest = store.manifest(version)
    return {t: store._table(t, manifest).drop("bucket") for t in TABLES}

"""Every operator as a query over the test tables: (spark, folder) -> DataFrame.

Each reads whole tables. Results are made portable: dates as ISO text, times as microseconds,
booleans as 0/1, doubles rounded, so that another engine's result compares value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.config import REPORT_STEPS, TRAFFIC, Settings
from sessionloom.functions import (
    calendar_columns,
    clean_item_string,
    clean_string,
    event_param,
    newcombe,
    rate,
    surrogate_key,
    week_label,
    week_start,
    wilson,
)
from sessionloom.functions.keys import traffic_key
from sessionloom.operators import checks, profiling
from sessionloom.operators.dims import (
    calendar_of,
    current_attribution,
    devices,
    traffic_sources,
)
from sessionloom.operators.history import asof_join, attribution_history, with_current_version
from sessionloom.operators.items import ITEM_TEXTS, item_facts, modal_category
from sessionloom.operators.metrics import METRICS, Facts, Ratio, metric
from sessionloom.operators.sessions import (
    event_facts,
    funnel_steps,
    session_facts,
    session_facts_by_join,
    session_rollup,
    sessionise,
    with_derived_dimensions,
)
from sessionloom.operators.snapshot import SnapshotStore, attribution_dimension
from sessionloom.operators.snapshot_log import SnapshotLog
from sessionloom.operators.staging import TEXT_FIELDS, stage_events
from sessionloom.plans import dashboard, reports
from sessionloom.plans.build import build, build_window, refresh_days
from sessionloom.plans.incremental import full_build, refresh
from sessionloom.plans.incremental import tables as built_tables
from sessionloom.session import configure
from sessionloom.sources.adapter import raw_export, table
from sessionloom.sources.export import read_export, read_sharded_export, write_export
from sessionloom.sources.tables import (
    export_report,
    overwrite_partitions,
    overwrite_table,
    work_folder,
)
from sessionloom.sources.versions import TableStore
from sessionloom.streaming.numbered import append_available, corrected, number_sessions
from sessionloom.streaming.sessions import stream_sessions, write_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DAY = 86_400
# Days the two-run and windowed queries are cut at.
CUT_DAY = "20240116"
WINDOW = ("20240108", "20240121")
RUNS = (
    datetime(2024, 1, 16, tzinfo=timezone.utc),
    datetime(2024, 2, 1, tzinfo=timezone.utc),
)


def digits(column: str) -> int:
    """Decimals compared: sums of money depend on the order of addition sooner than rates do."""
    return 4 if "revenue" in column or column.endswith("_total") else 9


def portable(df: DataFrame) -> DataFrame:
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, T.DoubleType):
            n = digits(f.name)
            c = F.when(F.abs(c) < 0.5 * 10**-n, 0.0).otherwise(F.round(c, n))
        columns.append(c.alias(f.name))
    return df.select(*columns)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, folder: portable(f(configure(spark), folder))
    return f


# --- shared inputs ------------------------------------------------------------------------


def staged(spark, folder, with_items=False) -> DataFrame:
    return stage_events(raw_export(spark, folder, with_items))


def sessions_of(spark, folder, gap=1800) -> DataFrame:
    return rolled(staged(spark, folder), gap)


def rolled(events, gap=1800) -> DataFrame:
    return session_facts(session_rollup(sessionise(events, gap, keep_slice=True)))


def funnel_of(spark, folder, gap=1800) -> DataFrame:
    events = kept(staged(spark, folder), "staged")
    sessions = kept(rolled(events, gap), "sessions")
    return reports.funnel_report(sessions, devices(events), traffic_sources(events))


def kept(df: DataFrame, name: str) -> DataFrame:
    """An intermediate that is read several times, written once, as in a build."""
    return overwrite_table(df, work_folder(df.sparkSession, name))


def items_of(spark, folder, gap=1800) -> DataFrame:
    return kept(item_facts(sessionise(staged(spark, folder, True), gap)), "items")


def products_of(spark, folder, gap=DAY) -> DataFrame:
    return reports.product_report(items_of(spark, folder, gap))


def facts_of(events, gap=1800) -> Facts:
    events = kept(events, "staged")
    sessionised = kept(sessionise(events, gap), "sessionised")
    return Facts(
        session_facts(session_rollup(sessionised)),
        event_facts(sessionised),
        devices(events),
        traffic_sources(events),
    )


# --- column functions ---------------------------------------------------------------------


@query
def text_cleaning(spark, folder):
    """clean_string on every exported text field and on the page URLs."""
    raw = raw_export(spark, folder)
    fields = F.array(
        *[
            F.struct(F.lit(n).alias("field"), F.col(c).alias("raw_text"))
            for n, c in TEXT_FIELDS.items()
        ]
    )
    urls = table(spark, folder, "pages").select(
        F.lit("url").alias("field"), F.col("url").alias("raw_text")
    )
    return (
        raw.select(F.explode(fields).alias("f"))
        .select("f.*")
        .unionByName(urls)
        .groupBy("field", "raw_text")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("cleaned", clean_string("raw_text"))
    )


@query
def item_text_cleaning(spark, folder):
    raw = raw_export(spark, folder, with_items=True)
    fields = F.array(
        *[F.struct(F.lit(n).alias("field"), F.col(f"item.{n}").alias("raw_text")) for n in ITEM_TEXTS]
    )
    return (
        raw.select(F.explode("items").alias("item"))
        .select(F.explode(fields).alias("f"))
        .select("f.*")
        .groupBy("field", "raw_text")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("cleaned", clean_item_string("raw_text"))
    )


@query
def event_params(spark, folder):
    """Parameters by key and type: present, absent, and asked for in another field."""
    return raw_export(spark, folder).select(
        F.lower("user_pseudo_id").alias("device_id"),
        "event_timestamp",
        event_param("page_title").alias("page_title"),
        event_param("page_location").alias("page_location"),
        event_param("ga_session_id", "int").alias("ga_session_id"),
        event_param("ga_session_id", "string").alias("wrong_field"),
        event_param("value", "double").alias("value_double"),
        event_param("value", "float").alias("value_float"),
        event_param("no_such_key").alias("absent"),
    )


@query
def surrogate_keys(spark, folder):
    """Keys of every combination of three part columns, with NULL and empty parts."""
    return (
        table(spark, folder, "part")
        .select(
            "p_brand",
            F.nullif("p_type", F.lit("SMALL")).alias("p_type"),
            F.when(F.col("p_size") < 10, "").otherwise(F.col("p_name")).alias("p_name"),
        )
        .distinct()
        .withColumn("part_group_key", surrogate_key("p_brand", "p_type", "p_name"))
    )


def _purchases_by_user(spark, folder):
    bought = F.count_if(F.col("event_type") == "purchase")
    return (
        table(spark, folder, "events")
        .groupBy("user_id")
        .agg(bought.alias("k"), F.count(F.lit(1)).alias("n"))
    )


@query
def wilson_intervals(spark, folder):
    """Purchases among the events of each user; also of none (n = 0)."""
    k, n = F.col("k"), F.col("n")
    return _purchases_by_user(spark, folder).select(
        "user_id",
        "k",
        "n",
        rate(k, n).alias("share"),
        wilson(k, n, "lower").alias("lower"),
        wilson(k, n, "upper").alias("upper"),
        wilson(k, n - n, "lower").alias("no_trials"),
    )


@query
def newcombe_intervals(spark, folder):
    """Each priority's share of finished orders against all other orders."""
    finished = F.count_if(F.col("o_orderstatus") == "F")
    per = (
        table(spark, folder, "orders")
        .groupBy("o_orderpriority")
        .agg(finished.alias("k"), F.count(F.lit(1)).alias("n"))
    )
    everyone = Window.partitionBy()
    k, n = F.col("k"), F.col("n")
    rest_k, rest_n = F.col("rest_k"), F.col("rest_n")
    return per.withColumns(
        {"rest_k": F.sum("k").over(everyone) - k, "rest_n": F.sum("n").over(everyone) - n}
    ).select(
        "o_orderpriority",
        "k",
        "n",
        "rest_k",
        "rest_n",
        newcombe(k, n, rest_k, rest_n, "lower").alias("lower"),
        newcombe(k, n, rest_k, rest_n, "upper").alias("upper"),
        newcombe(rest_k, rest_n, k, n, "lower").alias("swapped_lower"),
        newcombe(k, n, rest_k, rest_n - rest_n, "upper").alias("no_rest"),
    )


@query
def calendar_parts(spark, folder):
    """Calendar attributes of every order date."""
    day = F.col("day")
    return (
        table(spark, folder, "orders")
        .select(F.to_date("o_orderdate").alias("day"))
        .distinct()
        .select(
            "day",
            *calendar_columns(day),
            week_start(day).alias("week_start"),
            week_label(week_start(day)).alias("week_label"),
        )
    )


# --- staging and facts --------------------------------------------------------------------


@query
def stg_events(spark, folder):
    events = staged(spark, folder, with_items=True)
    n = F.coalesce(F.size("items"), F.lit(0))
    return events.withColumn("n_items", n).drop("items")


@query
def stg_events_window(spark, folder):
    """Export stored one partition per day, read back for two weeks: other days are pruned."""
    root = work_folder(spark, "export")
    write_export(raw_export(spark, folder, by_day=True), root, in_order=True)
    events = stage_events(read_export(spark, root, *WINDOW))
    return events.groupBy("event_date", "event_name").agg(
        F.count(F.lit(1)).alias("n_events"), F.countDistinct("device_id").alias("n_devices")
    )


@query
def stg_events_shards(spark, folder):
    """The same window from one folder per day."""
    root = work_folder(spark, "shards")
    raw = raw_export(spark, folder, by_day=True).withColumn("shard", F.col("event_date"))
    overwrite_partitions(raw, root, "shard", in_order=True)
    events = stage_events(read_sharded_export(spark, root, *WINDOW, prefix="shard="))
    return events.groupBy("event_date").agg(F.count(F.lit(1)).alias("n_events"))


@query
def events_sessionised(spark, folder):
    return sessionise(staged(spark, folder)).drop("items")


@query
def events_sessionised_day_gap(spark, folder):
    return sessionise(staged(spark, folder), DAY).select(
        "session_key", "device_id", "time_stamp", "is_new_session", "session_num", "mins_since_prev"
    )


@query
def session_funnel_steps(spark, folder):
    return funnel_steps(session_rollup(sessionise(staged(spark, folder), DAY, keep_slice=True)))


@query
def fct_sessions(spark, folder):
    return with_derived_dimensions(sessions_of(spark, folder))


@query
def fct_sessions_day_gap(spark, folder):
    return with_derived_dimensions(sessions_of(spark, folder, DAY))


@query
def fct_sessions_by_join(spark, folder):
    """Spans and flags kept apart and joined on the session."""
    rollup = session_rollup(sessionise(staged(spark, folder), DAY, keep_slice=True))
    return session_facts_by_join(session_facts(rollup), funnel_steps(rollup))


@query
def fct_events(spark, folder):
    return event_facts(sessionise(staged(spark, folder)))


@query
def fct_event_items(spark, folder):
    return item_facts(staged(spark, folder, with_items=True))


@query
def dim_devices(spark, folder):
    return devices(staged(spark, folder))


@query
def dim_traffic_source(spark, folder):
    return traffic_sources(staged(spark, folder))


@query
def dim_date(spark, folder):
    return calendar_of(staged(spark, folder))


# --- attribution --------------------------------------------------------------------------


@query
def attribution_versions(spark, folder):
    return attribution_history(staged(spark, folder))


@query
def attribution_asof(spark, folder):
    """Every event with the attribution version valid at its time."""
    events = staged(spark, folder)
    facts = events.select("device_id", "time_stamp", "event_name", traffic_key().alias("event_key"))
    return asof_join(
        facts,
        kept(attribution_history(events), "history"),
        "device_id",
        "time_stamp",
        ["version_num", "traffic_source_key", "valid_from"],
    )


@query
def attribution_asof_sessions(spark, folder):
    """Sessions with the version valid just before they start (none before a device's first)."""
    events = staged(spark, folder)
    before = F.col("session_start") - F.expr("interval 1 microsecond")
    facts = rolled(events).select(
        "session_id", "device_id", before.alias("looked_up_at")
    )
    return asof_join(
        kept(facts, "sessions"),
        kept(attribution_history(events), "history"),
        "device_id",
        "looked_up_at",
        ["version_num"],
    )


@query
def attribution_current(spark, folder):
    return current_attribution(staged(spark, folder))


@query
def attribution_current_lookup(spark, folder):
    """Each session with its device's open version."""
    events = staged(spark, folder)
    facts = rolled(events).select("session_id", "device_id")
    return with_current_version(
        facts, attribution_history(events), "device_id", ["version_num", "medium"]
    )


def _two_runs(spark, folder) -> DataFrame:
    """Snapshot history after two runs: up to the cut day, then over everything."""
    store = SnapshotStore(spark, work_folder(spark, "snapshot"))
    events = staged(spark, folder)
    cut = F.to_date(F.lit(CUT_DAY), "yyyyMMdd")
    store.run(current_attribution(events.where(F.col("event_date") < cut)), RUNS[0])
    store.run(current_attribution(events), RUNS[1])
    return store.read()


@query
def attribution_snapshot(spark, folder):
    return _two_runs(spark, folder)


@query
def dim_attribution(spark, folder):
    return attribution_dimension(_two_runs(spark, folder))


@query
def attribution_snapshot_asof(spark, folder):
    """Sessions with the version of the run-time dimension valid when they start."""
    facts = sessions_of(spark, folder).select("session_id", "device_id", "session_start")
    dimension = attribution_dimension(_two_runs(spark, folder))
    found = asof_join(
        facts, dimension, "device_id", "session_start", ["attribution_version_key", "medium"]
    )
    return found


@query
def attribution_snapshot_current(spark, folder):
    """Sessions with their device's open version in the run-time dimension."""
    facts = sessions_of(spark, folder).select("session_id", "device_id")
    dimension = attribution_dimension(_two_runs(spark, folder))
    return with_current_version(
        facts, dimension, "device_id", ["attribution_version_key", "medium"]
    )


@query
def attribution_missing_keys(spark, folder):
    """As-of and current lookup where every ninth device and every eleventh time is missing."""
    events = staged(spark, folder)
    versions = kept(attribution_history(events), "history")
    facts = events.select(
        "device_id", "time_stamp", "event_name", "session_id"
    ).withColumns(
        {
            "device_id": F.when(~F.col("device_id").endswith("9"), F.col("device_id")),
            "time_stamp": F.when(~F.col("session_id").endswith("7"), F.col("time_stamp")),
        }
    )
    found = asof_join(facts, versions, "device_id", "time_stamp", ["version_num"])
    current = versions.select("device_id", "is_current", F.col("version_num").alias("current_num"))
    return with_current_version(found, current, "device_id", ["current_num"])


@query
def incremental_overwrite(spark, folder):
    """Day-partitioned staging, then a window whose export changed is restaged; other days stay."""
    root = work_folder(spark, "incremental")
    raw = raw_export(spark, folder)
    write_export(raw, f"{root}/export")
    refresh_days(spark, f"{root}/export", f"{root}/staged", "00000101", "99991231")
    changed = raw.where((F.col("event_name") == "purchase") & F.col("event_date").between(*WINDOW))
    write_export(changed, f"{root}/export")
    refresh_days(spark, f"{root}/export", f"{root}/staged", *WINDOW)
    return (
        spark.read.parquet(f"{root}/staged")
        .groupBy("event_date", "event_name")
        .agg(F.count(F.lit(1)).alias("n_events"))
    )


@query
def built_window(spark, folder):
    """A build over two weeks of a stored export; its session fact."""
    root = work_folder(spark, "window")
    write_export(raw_export(spark, folder, by_day=True), f"{root}/export", in_order=True)
    window = Settings(start_date=WINDOW[0], end_date=WINDOW[1], gap_seconds=DAY)
    return build_window(spark, f"{root}/export", f"{root}/tables", window)["fct_sessions"]


# --- reports ------------------------------------------------------------------------------


@query
def funnel_overall(spark, folder):
    return reports.overall_funnel(sessions_of(spark, folder, DAY))


@query
def rpt_funnel(spark, folder):
    return funnel_of(spark, folder)


@query
def rpt_funnel_day_gap(spark, folder):
    return funnel_of(spark, folder, DAY)


@query
def funnel_grouping_sets(spark, folder):
    """Segment totals by GROUPING SETS; must equal the one-pass form."""
    events = staged(spark, folder)
    totals = reports.dimension_totals(
        rolled(events, DAY), devices(events), traffic_sources(events)
    )
    return reports.by_step(reports.segment_totals_grouping_sets(totals))


@query
def rpt_funnel_weekly(spark, folder):
    return reports.weekly_report(sessions_of(spark, folder))


@query
def rpt_funnel_weekly_day_gap(spark, folder):
    return reports.weekly_report(sessions_of(spark, folder, DAY))


@query
def product_category(spark, folder):
    return modal_category(item_facts(staged(spark, folder, True)))


@query
def rpt_product_funnel(spark, folder):
    return products_of(spark, folder)


@query
def rpt_product_funnel_from_facts(spark, folder):
    """The same report from the stored facts, items joined to events on event_id."""
    events = staged(spark, folder, True)
    return reports.product_report(item_facts(events), event_facts(sessionise(events, DAY)))


@query
def rpt_events_daily(spark, folder):
    events = staged(spark, folder)
    facts = event_facts(sessionise(events))
    return reports.daily_event_rollup(facts, devices(events), traffic_sources(events))


@query
def rpt_event_items_daily(spark, folder):
    return reports.daily_item_rollup(item_facts(staged(spark, folder, True)))


# --- figures read off the reports -----------------------------------------------------------


@query
def gap_significance(spark, folder):
    return dashboard.gap_significance(funnel_of(spark, folder, DAY))


@query
def headline_tiles(spark, folder):
    return dashboard.headline_tiles(funnel_of(spark, folder, DAY))


@query
def overall_steps(spark, folder):
    return dashboard.overall_steps(funnel_of(spark, folder, DAY))


@query
def segments_at_step(spark, folder):
    return dashboard.segments_at_step(funnel_of(spark, folder, DAY), "purchase")


@query
def weekly_trend(spark, folder):
    weekly = dashboard.full_weeks(reports.weekly_report(sessions_of(spark, folder, DAY)))
    return dashboard.error_bars(weekly, "session_conversion_rate").select(
        "week_start",
        "sessions",
        "session_conversion_rate",
        "session_conversion_err_minus",
        "session_conversion_err_plus",
    )


@query
def weekly_peak_low(spark, folder):
    weekly = reports.weekly_report(sessions_of(spark, folder, DAY))
    return dashboard.peak_and_low(dashboard.full_weeks(weekly))


@query
def funnel_error_bars(spark, folder):
    """The funnel's rates with the distances to their bounds."""
    return dashboard.error_bars(
        funnel_of(spark, folder, DAY), "reach_rate", "step_conversion", "gap_vs_rest"
    ).select(
        "segment_type", "segment_value", "step", "reach_err_minus", "reach_err_plus",
        "step_conversion_err_minus", "step_conversion_err_plus", "gap_vs_rest_err_minus",
        "gap_vs_rest_err_plus",
    )


@query
def product_error_bars(spark, folder):
    """The categories' rates with the distances to their bounds."""
    return dashboard.error_bars(
        products_of(spark, folder), "view_to_cart_rate", "view_to_purchase_rate"
    ).select(
        "item_category", "view_to_cart_err_minus", "view_to_cart_err_plus",
        "view_to_purchase_err_minus", "view_to_purchase_err_plus",
    )


@query
def top_categories(spark, folder):
    return dashboard.top_categories(products_of(spark, folder))


@query
def revenue_share(spark, folder):
    return dashboard.revenue_share(products_of(spark, folder))


@query
def exported_report(spark, folder):
    """The weekly report written as one CSV file and read back."""
    path = work_folder(spark, "report")
    export_report(reports.weekly_report(sessions_of(spark, folder, DAY)), path)
    schema = "week_start date, week_label string, week_sort int, days_in_week bigint, " \
        "is_partial_week int, sessions bigint, sessions_with_view_item bigint, " \
        "sessions_with_add_to_cart bigint, sessions_with_begin_checkout bigint, " \
        "sessions_with_purchase bigint, session_conversion_rate double, " \
        "session_conversion_rate_lower double, session_conversion_rate_upper double"
    return spark.read.schema(schema).option("header", True).csv(path)


# --- metrics ------------------------------------------------------------------------------

SESSION_METRICS = [
    n
    for n, m in METRICS.items()
    if (METRICS[m.numerator] if isinstance(m, Ratio) else m).fact == "sessions"
]


@query
def metrics_by_day(spark, folder):
    """All metrics by day, on the calendar as time spine."""
    events = staged(spark, folder)
    return metric(facts_of(events, DAY), list(METRICS), grain="day", spine=calendar_of(events))


@query
def metrics_by_week(spark, folder):
    return metric(facts_of(staged(spark, folder), DAY), list(METRICS), grain="week")


@query
def metrics_by_segment(spark, folder):
    names = ["sessions", "devices", "session_conversion_rate", "events_per_session",
             "avg_session_duration_min"]
    return metric(
        facts_of(staged(spark, folder), DAY), names, by=["device_category", "continent", "source"]
    )


@query
def metrics_by_geography(spark, folder):
    names = ["sessions", "devices", "view_item_rate", "events"]
    by = ["sub_continent", "country", "region", "city", "brand"]
    return metric(facts_of(staged(spark, folder), DAY), names, by=by, grain="month")


@query
def metrics_by_native_span(spark, folder):
    names = ["sessions", "devices", "events", "add_to_cart_rate"]
    return metric(
        facts_of(staged(spark, folder), DAY),
        names,
        by=["spans_multiple_ga_sessions", "campaign"],
        where={"medium": ["organic", "cpc", None]},
    )


@query
def metrics_in_window(spark, folder):
    """Rates of two weeks by native-id span and quarter."""
    first, last = (datetime.strptime(d, "%Y%m%d").date() for d in WINDOW)
    return metric(
        facts_of(staged(spark, folder), DAY),
        ["sessions", "events", "begin_checkout_rate", "session_start_rate"],
        by=["spans_multiple_ga_sessions"],
        grain="quarter",
        start=first,
        end=last,
    )


@query
def metric_events(spark, folder):
    """Events by name and the event's own medium, per month."""
    return metric(
        facts_of(staged(spark, folder)), ["events"], by=["event_name", "medium"], grain="month"
    )


@query
def metrics_overall(spark, folder):
    return metric(facts_of(staged(spark, folder), DAY), list(METRICS))


# --- data quality -------------------------------------------------------------------------


@query
def dq_failures(spark, folder):
    """A whole build is written; every declared check counts its failures."""
    raw = raw_export(spark, folder, with_items=True, by_day=True)
    tables = build(raw, work_folder(spark, "build"), whole_span=True, in_order=True)
    staged_events = tables["stg_events"]
    store = SnapshotStore(spark, work_folder(spark, "snapshot"))
    tables["current_attribution"] = current_attribution(staged_events)
    cut = F.to_date(F.lit(CUT_DAY), "yyyyMMdd")
    store.run(current_attribution(staged_events.where(F.col("event_date") < cut)), RUNS[0])
    store.run(tables["current_attribution"], RUNS[1])
    tables["attribution_snapshot"] = store.read()
    tables["dim_attribution"] = attribution_dimension(tables["attribution_snapshot"])
    return checks.run_checks(tables, checks.BUILD_CHECKS + checks.SNAPSHOT_CHECKS)


@query
def dq_failing_rows(spark, folder):
    """Each kind of check on the relational tables, where some of them do fail."""
    t = {n: table(spark, folder, n) for n in ("lineitem", "orders", "customer", "part", "events")}
    line_key = checks.unique(t["lineitem"], ["l_orderkey", "l_linenumber"])
    name = checks.unique(t["part"], "p_name", where="p_size > 25")
    status = checks.accepted_values(t["orders"], "o_orderstatus", ["F", "O"])
    buyers = checks.relationships(t["customer"], "c_custkey", t["orders"], "o_custkey")
    no_k = checks.not_null(t["part"].select(F.nullif("p_brand", F.lit("Brand#1")).alias("b")), "b")
    found = {
        "unique_combination(l_orderkey, l_linenumber)": line_key.select(
            F.concat_ws("/", "l_orderkey", "l_linenumber").alias("failing"), "n_rows"
        ),
        "unique(p_name) where p_size > 25": name.select(F.col("p_name").alias("failing"), "n_rows"),
        "accepted_values(o_orderstatus)": status.select(F.col("value").alias("failing"), "n_rows"),
        "relationships(c_custkey)": buyers.select(
            F.col("orphan").cast("string").alias("failing"), "n_rows"
        ),
        "not_null(p_brand)": no_k.groupBy(F.col("b").alias("failing")).agg(
            F.count(F.lit(1)).alias("n_rows")
        ),
    }
    return reduce(
        DataFrame.unionByName,
        [df.select(F.lit(n).alias("check_name"), "failing", "n_rows") for n, df in found.items()],
    )


# True figures of the hundredth-scale test tables, but for the last two, which must be reported.
FIGURES = [
    checks.Figure("sessions", "funnel", "segment_type = 'overall' and step = 'sessions'",
                  "segment_sessions", 1214, 0),
    checks.Figure("purchasing sessions", "funnel",
                  "segment_type = 'overall' and step = 'purchase'", "sessions_reached", 817, 0),
    checks.Figure("conversion", "funnel", "segment_type = 'overall' and step = 'purchase'",
                  "reach_rate", 0.6730, 0.0001),
    checks.Figure("never viewing", "funnel", "segment_type = 'overall' and step = 'view_item'",
                  "1 - reach_rate", 0.328, 0.001),
    checks.Figure("view to cart", "funnel", "segment_type = 'overall' and step = 'add_to_cart'",
                  "step_conversion", 0.748, 0.001),
    checks.Figure("checkouts without cart", "funnel",
                  "segment_type = 'overall' and step = 'begin_checkout'",
                  "skipped_prev_share", 0.231, 0.001),
    checks.Figure("referral gap", "funnel", "segment_type = 'channel' and "
                  "segment_value = 'referral' and step = 'purchase'", "gap_vs_rest", 0.0136, 0.0001),
    checks.Figure("unknown channel", "funnel", "segment_type = 'channel' and "
                  "segment_value = 'unknown' and step = 'purchase'", "reach_rate", 0.702, 0.001),
    checks.Figure("week of 8 Jan", "weekly", "week_start = date '2024-01-08'",
                  "session_conversion_rate", 0.7015, 0.0001),
    checks.Figure("week of 22 Jan", "weekly", "week_start = date '2024-01-22'",
                  "session_conversion_rate", 0.6181, 0.0001),
    checks.Figure("large: view to purchase", "product", "item_category = 'home/large/'",
                  "view_to_purchase_rate", 0.5, 0.0001),
    checks.Figure("large: share of revenue", "product", "item_category = 'home/large/'",
                  "item_revenue_in_usd / sum(item_revenue_in_usd) over ()", 0.35, 0.005),
]


@query
def figure_parity(spark, folder):
    """Twelve headline figures against stated values; those outside their tolerance."""
    events = kept(staged(spark, folder, with_items=True), "staged")
    sessionised = kept(sessionise(events, DAY), "sessionised")
    sessions = kept(session_facts(session_rollup(sessionised)), "sessions")
    tables = {
        "funnel": reports.funnel_report(sessions, devices(events), traffic_sources(events)),
        "weekly": reports.weekly_report(sessions),
        "product": reports.product_report(item_facts(sessionised)),
    }
    return checks.drifted(checks.figures(tables, FIGURES))


@query
def reconciliation(spark, folder):
    """Totals of the daily rollups against the facts."""
    events = kept(staged(spark, folder, True), "staged")
    facts = kept(event_facts(sessionise(events)), "facts")
    daily = reports.daily_event_rollup(facts, devices(events), traffic_sources(events))
    items = item_facts(events)
    return checks.reconcile(
        facts,
        daily,
        {
            "events": ("count(1)", "sum(events)"),
            "purchase_revenue": (
                "sum(purchase_revenue_in_usd)",
                "sum(purchase_revenue_in_usd)",
            ),
        },
    ).unionByName(
        checks.reconcile(
            items,
            reports.daily_item_rollup(items),
            {
                "item_rows": ("count(1)", "sum(item_rows)"),
                "item_revenue": (
                    "sum(item_revenue_in_usd)",
                    "sum(item_revenue_in_usd)",
                ),
            },
        )
    )


# --- profiles -----------------------------------------------------------------------------


@query
def profile_columns(spark, folder):
    """All columns of staged events; the items by their number."""
    return profiling.column_profile(staged(spark, folder, True))


@query
def profile_placeholders(spark, folder):
    return profiling.placeholder_counts(raw_export(spark, folder), TEXT_FIELDS)


@query
def profile_natural_key(spark, folder):
    """Event keys held by more than one row, on too few columns (the full key has none)."""
    return checks.unique(staged(spark, folder), ["device_id", "session_id", "event_name"])


@query
def profile_repeated_params(spark, folder):
    return profiling.repeated_param_keys(raw_export(spark, folder))


@query
def profile_param_fields(spark, folder):
    return profiling.param_fields(raw_export(spark, folder))


@query
def profile_explode_cost(spark, folder):
    return profiling.explode_cost(raw_export(spark, folder))


@query
def profile_attribute_drift(spark, folder):
    """All ten attributes of a device, and the traffic attributes together."""
    attributes = ["device", "brand", "continent", "sub_continent", "country", "region", "city"]
    return profiling.attribute_drift(
        staged(spark, folder), [*attributes, *TRAFFIC], {"traffic combination": TRAFFIC}
    )


@query
def profile_session_mismatch(spark, folder):
    return profiling.session_mismatch(sessionise(staged(spark, folder)))


@query
def profile_key_overlap(spark, folder):
    return profiling.key_overlap(
        item_facts(staged(spark, folder, True)), ["item_name", "item_id", "item_category"]
    )


@query
def profile_step_nesting(spark, folder):
    return profiling.step_nesting(sessions_of(spark, folder, DAY), REPORT_STEPS[1:])


# --- streams ------------------------------------------------------------------------------


@query
def streamed_sessions(spark, folder):
    """Sessions from a file stream in two runs on one checkpoint: the first half of the days,
    then the rest and a far-off event that closes what is open."""
    root = work_folder(spark, "stream")
    events = staged(spark, folder).drop("items")
    cut = F.to_date(F.lit(CUT_DAY), "yyyyMMdd")

    def run():
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        write_available(stream_sessions(stream), f"{root}/out", f"{root}/checkpoint")

    events.where(F.col("event_date") < cut).write.parquet(f"{root}/in")
    run()
    later = F.col("time_stamp") + F.expr("interval 2 days")
    closing = events.orderBy(F.desc("time_stamp")).limit(1).withColumns(
        {"device_id": F.lit("closing"), "time_stamp": later}
    )
    late = events.where(F.col("event_date") >= cut).unionByName(closing)
    late.write.mode("append").parquet(f"{root}/in")
    run()
    return spark.read.parquet(f"{root}/out").where(~F.col("device_id").eqNullSafe("closing"))


def with_gaps(events) -> DataFrame:
    """Staged events of which some have no device and some no time."""
    return events.withColumns(
        {
            "device_id": F.when(~F.col("device_id").endswith("9"), F.col("device_id")),
            "time_stamp": F.when(~F.col("page_location").endswith("?k=13"), F.col("time_stamp")),
        }
    )


@query
def streamed_numbered_sessions(spark, folder):
    """Numbered sessions from a stream in three runs, with devices and times missing; every fourth
    event of the first half of the days comes with the second half, and some with the last run."""
    root = work_folder(spark, "numbered")
    events = kept(with_gaps(staged(spark, folder).drop("items")), "gaps")
    nth = F.pmod(F.xxhash64("device_id", "session_id", "event_name"), F.lit(40))
    early = F.col("event_date") < F.to_date(F.lit(CUT_DAY), "yyyyMMdd")
    arrival = F.when(nth == 0, 2).when(early & (nth >= 10), 0).otherwise(1)
    for n in range(3):
        events.where(arrival == n).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        append_available(number_sessions(stream), f"{root}/out", f"{root}/checkpoint")
    return session_facts(corrected(spark, f"{root}/out", events))


# --- builds that are refreshed --------------------------------------------------------------


@lru_cache(maxsize=1)
def _refreshed(spark, folder) -> TableStore:
    """A build over an export that lacks purchases in two weeks, then a refresh of those days with them."""
    raw = raw_export(spark, folder, with_items=True)
    inside = F.col("event_date").between(*WINDOW)
    lacking = raw.where(~(inside & (F.col("event_name") == "purchase")))
    store = TableStore(spark, work_folder(spark, "refreshed"))
    full_build(store, lacking, whole_span=True)
    refresh(store, raw_export(spark, folder, with_items=True, days=WINDOW), *WINDOW, whole_span=True)
    return store


@query
def refreshed_sessions(spark, folder):
    return with_derived_dimensions(built_tables(_refreshed(spark, folder))["fct_sessions"])


@query
def refreshed_events(spark, folder):
    return built_tables(_refreshed(spark, folder))["fct_events"]


@query
def refreshed_attribution(spark, folder):
    return built_tables(_refreshed(spark, folder))["attribution_history"]


@query
def refreshed_devices(spark, folder):
    return built_tables(_refreshed(spark, folder))["dim_devices"]


@query
def refreshed_funnel(spark, folder):
    return built_tables(_refreshed(spark, folder))["rpt_funnel"]


def _logged(spark, folder) -> SnapshotLog:
    """Two runs and a compaction between, and a run after which nothing has changed."""
    log = SnapshotLog(spark, work_folder(spark, "log"))
    events = staged(spark, folder)
    cut = F.to_date(F.lit(CUT_DAY), "yyyyMMdd")
    log.run(current_attribution(events.where(F.col("event_date") < cut)), RUNS[0])
    log.compact()
    log.run(current_attribution(events), RUNS[1])
    log.run(current_attribution(events), RUNS[1] + timedelta(days=1))
    return log


@query
def attribution_log(spark, folder):
    return _logged(spark, folder).read()


@query
def attribution_log_before(spark, folder):
    """The history as the first run left it, read after the later runs."""
    return _logged(spark, folder).read(RUNS[0])

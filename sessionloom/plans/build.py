"""A whole build: every table written once, later tables read from the earlier ones."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.config import Settings
from sessionloom.operators.dims import calendar, calendar_of, devices, traffic_sources
from sessionloom.operators.history import attribution_history
from sessionloom.operators.items import item_facts
from sessionloom.operators.runs import HotKeys
from sessionloom.operators.sessions import (
    event_facts,
    funnel_steps,
    session_facts,
    session_rollup,
    sessionise,
)
from sessionloom.operators.staging import stage_events
from sessionloom.plans.reports import funnel_report, product_report, weekly_report
from sessionloom.sources.export import read_export
from sessionloom.sources.tables import overwrite_partitions, overwrite_table

#: Tables of a build that are written at the same time, at most.
SIDE_BY_SIDE = 4


def build(
    raw: DataFrame,
    root: str,
    settings: Settings = Settings(),
    policy: HotKeys = HotKeys(),
    whole_span: bool = False,
    in_order: bool = False,
) -> dict[str, DataFrame]:
    """Write staging, facts, dimensions, history and reports under ``root``; return them.

    Sessionised events are stored, so the device shuffle happens once for the facts that share
    it. Event and session tables are partitioned by day. Tables that do not need each other are
    written side by side, so that the last tasks of one leave no cores idle. ``whole_span`` takes
    the calendar from the events instead of the configured window; ``in_order`` says that ``raw``
    lies by day.
    """
    spark = raw.sparkSession

    def store(
        name: str, df: DataFrame, by: str | None = None, in_order: bool = False
    ) -> DataFrame:
        return overwrite_table(df, f"{root}/{name}", by, in_order)

    def days(staged: DataFrame) -> DataFrame:
        if whole_span:
            return calendar_of(staged)
        return calendar(spark, settings.start_date, settings.end_date)

    def by_day(events: DataFrame) -> DataFrame:
        """Rows to lie by day before keys are hashed and items unnested, which makes them longer."""
        return events.hint("rebalance", "event_date")

    staged = store("stg_events", stage_events(raw), "event_date", in_order)
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:

        def begin(name: str, make: Callable[[], DataFrame], *layout) -> Future[DataFrame]:
            """Plans are made in the thread too, since some look at the data for hot keys."""
            write = inheritable_thread_target(spark)(lambda: store(name, make(), *layout))
            return pool.submit(write)

        sessionised = begin(
            "events_sessionised", lambda: sessionise(staged, settings.gap_seconds, policy)
        )
        history = begin("attribution_history", lambda: attribution_history(staged, policy))
        device_dim = begin("dim_devices", lambda: devices(staged))
        traffic = begin("dim_traffic_source", lambda: traffic_sources(staged))
        dates = begin("dim_date", lambda: days(staged))

        events = sessionised.result()
        rollup = begin("session_rollup", lambda: session_rollup(events))
        with_items = events.where(F.size("items") > 0)
        items = begin(
            "fct_event_items", lambda: item_facts(by_day(with_items)), "event_date", True
        )
        facts = begin("fct_events", lambda: event_facts(by_day(events)), "event_date", True)

        rolled = rollup.result()
        sessions = begin("fct_sessions", lambda: session_facts(rolled), "session_date").result()
        weekly = begin("rpt_funnel_weekly", lambda: weekly_report(sessions, settings))
        dims = device_dim.result(), traffic.result()
        funnel = begin("rpt_funnel", lambda: funnel_report(sessions, *dims, settings))
        unnested = items.result()
        product = begin("rpt_product_funnel", lambda: product_report(unnested, settings=settings))

    return {
        "stg_events": staged,
        "events_sessionised": events,
        "session_rollup": rolled,
        "session_funnel_steps": funnel_steps(rolled),
        "fct_sessions": sessions,
        "fct_events": facts.result(),
        "fct_event_items": unnested,
        "dim_devices": dims[0],
        "dim_traffic_source": dims[1],
        "dim_date": dates.result(),
        "attribution_history": history.result(),
        "rpt_funnel": funnel.result(),
        "rpt_funnel_weekly": weekly.result(),
        "rpt_product_funnel": product.result(),
    }


def build_window(
    spark: SparkSession,
    export: str,
    root: str,
    settings: Settings = Settings(),
    policy: HotKeys = HotKeys(),
) -> dict[str, DataFrame]:
    """A full refresh over the configured window: afterwards the tables hold just those days."""
    raw = read_export(spark, export, settings.start_date, settings.end_date)
    return build(raw, root, settings, policy, in_order=True)


def refresh_days(
    spark: SparkSession, export: str, staged_path: str, start: str, end: str
) -> None:
    """Restage the days ``start`` to ``end`` of a day-partitioned staging table; others stay."""
    staged = stage_events(read_export(spark, export, start, end))
    overwrite_partitions(staged, staged_path, "event_date", in_order=True)

"""Reports on literal sessions and against each other."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from sessionloom.config import FUNNEL_EVENTS
from sessionloom.operators.checks import (
    accepted_values,
    not_null,
    reconcile,
    relationships,
    unique,
)
from sessionloom.operators.items import modal_category
from sessionloom.operators.metrics import Facts, metric
from sessionloom.plans import dashboard, reports
from sessionloom.plans.queries import DAY, rolled, staged


def session_rows(spark, rows):
    """rows: (device, date, reached steps)."""
    flags = ", ".join(f"reached_{s} int" for s in FUNNEL_EVENTS)
    data = [
        (str(n), d, day, f"k{d}", *[int(s in steps) for s in FUNNEL_EVENTS])
        for n, (d, day, steps) in enumerate(rows)
    ]
    schema = "session_id string, device_id string, session_date date, traffic_source_key string"
    return spark.createDataFrame(data, f"{schema}, {flags}")


def dims(spark, devices, channels):
    device = spark.createDataFrame(devices, "device_id string, device string, continent string")
    traffic = spark.createDataFrame(
        channels, "traffic_source_key string, medium string, traffic_source string"
    )
    return device, traffic


def test_unknown_takes_a_rank_and_is_shown_last(spark):
    day = date(2024, 1, 1)
    sizes = {"a": 10, "b": 8, "c": 5, "d": 5}
    sessions = session_rows(spark, [(d, day, ()) for d, n in sizes.items() for _ in range(n)])
    device, traffic = dims(
        spark,
        [("a", "desktop", None), ("b", None, None), ("c", "tablet", None), ("d", "mobile", None)],
        [("ka", None, "direct"), ("kb", None, None), ("kc", "cpc", "x"), ("kd", "cpc", "y")],
    )
    got = reports.funnel_report(sessions, device, traffic).where("step = 'sessions'")
    sort = {(r.segment_type, r.segment_value): r.segment_sort for r in got.collect()}
    assert sort == {
        ("overall", "all sessions"): 0,
        ("device_category", "desktop"): 1,
        ("device_category", "unknown"): 99,
        ("device_category", "tablet"): 3,
        ("device_category", "mobile"): 3,
        ("continent", "unknown"): 99,
        ("channel", "direct"): 1,
        ("channel", "cpc"): 1,
        ("channel", "unknown"): 99,
    }


def test_funnel_is_presence_and_steps_may_be_skipped(spark):
    day = date(2024, 1, 1)
    rows = [
        ("a", day, ("view_item", "add_to_cart", "begin_checkout")),
        ("a", day, ("begin_checkout",)),
        ("a", day, ("purchase",)),
        ("a", day, ()),
    ]
    device, traffic = dims(spark, [("a", "desktop", "asia")], [("ka", "cpc", "x")])
    got = reports.funnel_report(session_rows(spark, rows), device, traffic)
    step = {r.step: r for r in got.where("segment_type = 'overall'").collect()}
    checkout = step["begin_checkout"]
    assert (checkout.sessions_reached, checkout.prev_step_sessions, checkout.reached_from_prev) == (
        2, 1, 1
    )
    assert checkout.step_conversion == 1.0 and checkout.skipped_prev_share == 0.5
    assert step["purchase"].step_conversion is None and step["purchase"].prev_step_sessions == 0
    assert step["add_shipping_info"].skipped_prev_share is None
    assert step["sessions"].gap_vs_rest is None and step["sessions"].gap_vs_rest_lower is None
    assert step["sessions"].is_thin_segment == 1


@pytest.mark.parametrize("gap", [1800, DAY])
def test_segments_add_up_to_overall(spark, folder, gap):
    from sessionloom.plans.queries import funnel_of

    sums = (
        funnel_of(spark, folder, gap)
        .groupBy("segment_type", "step")
        .agg(F.sum("segment_sessions").alias("n"), F.sum("sessions_reached").alias("k"))
        .groupBy("step")
        .agg(F.countDistinct("n", "k").alias("different"))
    )
    assert sums.where("different <> 1").count() == 0


def test_funnel_matches_weeks_and_metrics(spark, folder):
    events = staged(spark, folder)
    sessions = rolled(events, DAY)
    weekly = reports.weekly_report(sessions).agg(F.sum("sessions"), F.sum("sessions_with_purchase"))
    overall = {r.step: r.sessions_reached for r in reports.overall_funnel(sessions).collect()}
    assert tuple(weekly.first()) == (overall["sessions"], overall["purchase"])
    facts = Facts(sessions, events, events, events)
    got = metric(facts, ["sessions", "sessions_with_purchase"]).first()
    assert tuple(got) == (overall["sessions"], overall["purchase"])


def test_week_counts_days_with_sessions(spark):
    rows = [("a", date(2020, 11, d), ()) for d in (1, 2, 2, 5)]
    got = reports.weekly_report(session_rows(spark, rows)).orderBy("week_sort").collect()
    assert [(r.week_label, r.days_in_week, r.is_partial_week, r.sessions) for r in got] == [
        ("26 Oct", 1, 1, 1), ("02 Nov", 2, 1, 3)
    ]


def item_rows(spark, rows):
    return spark.createDataFrame(
        rows,
        "session_id string, event_name string, item_name string, item_category string, "
        "quantity bigint, item_revenue_in_usd double",
    )


def test_modal_category_breaks_ties_alphabetically(spark):
    rows = [("s", "view_item", "n", c, None, None) for c in ("b", "a", "a", "b", None, None, None)]
    rows += [("s", "purchase", "n", "z", None, None)] * 9
    assert [tuple(r) for r in modal_category(item_rows(spark, rows)).collect()] == [("n", "a")]


def test_products_are_linked_by_name(spark):
    rows = [
        ("s1", "view_item", "cap", "home/hats/", None, None),
        ("s1", "purchase", "cap", "hats", 2, 30.0),
        ("s2", "view_item", "cap", "home/hats/", None, None),
        ("s2", "add_to_cart", "cap", "home/hats/", 1, None),
        ("s3", "purchase", "cap", "hats", None, None),
        ("s3", "purchase", "pen", "office", 1, 5.0),
        ("s3", "view_item", None, "home/hats/", None, None),
    ]
    got = {r.item_category: r for r in reports.product_report(item_rows(spark, rows)).collect()}
    hats, unknown = got["home/hats/"], got["unknown"]
    assert (hats.sessions_viewed, hats.sessions_viewed_and_carted,
            hats.sessions_viewed_and_purchased, hats.sessions_purchased) == (2, 1, 1, 2)
    assert (hats.units_purchased, hats.item_revenue_in_usd, hats.category_sort) == (2, 30.0, 1)
    assert (unknown.category_sort, unknown.view_to_cart_rate, unknown.units_purchased) == (
        999, None, 1
    )


def test_significance(spark):
    rows = [(0.1, 0.2), (-0.2, -0.1), (-0.1, 0.1), (None, None)]
    df = spark.createDataFrame(rows, "lo double, hi double")
    got = df.select(dashboard.significance(F.col("lo"), F.col("hi"))).collect()
    assert [r[0] for r in got] == ["differs", "differs", "within_noise", None]


def test_checks_return_failing_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "b"), (None, "c")], "k int, v string")
    assert not_null(df, "v").count() == 1
    assert [tuple(r) for r in unique(df, "k").collect()] == [(1, 2)]
    assert unique(df, "k", where="v is not null").count() == 0
    assert unique(df.select("k"), ["k"]).count() == 2  # a combination counts NULL like a value
    assert [tuple(r) for r in accepted_values(df, "v", ["a", "b"]).collect()] == [("c", 1)]
    parent = spark.createDataFrame([(2,)], "id int")
    assert [tuple(r) for r in relationships(df, "k", parent, "id").collect()] == [(1, 2)]
    totals = {"rows": ("count(1)", "count(1)")}
    assert [r.reconciles for r in reconcile(df, df.limit(3), totals).collect()] == [False]


def test_metric_arguments(spark, folder):
    events = staged(spark, folder)
    facts = Facts(rolled(events), events, events, events)
    with pytest.raises(ValueError):
        metric(facts, ["no_such_metric"])
    with pytest.raises(ValueError):
        metric(facts, ["sessions"], by=["event_name"])
    with pytest.raises(ValueError):
        metric(facts, ["sessions"], grain="hour")


def test_metrics_over_no_rows(spark, folder):
    events = staged(spark, folder)
    facts = Facts(rolled(events).where("false"), events, events, events)
    got = metric(facts, ["sessions", "devices", "sessions_with_purchase", "view_item_rate"])
    assert [tuple(r) for r in got.collect()] == [(0, 0, None, None)]
    assert metric(facts, ["sessions"], grain="day").count() == 0

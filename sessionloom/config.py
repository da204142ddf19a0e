"""Parameters shared by the operators. Every default is the value the reports are defined with."""

from __future__ import annotations

from dataclasses import dataclass

# The funnel events, in funnel order, that sessions carry a flag for.
FUNNEL_EVENTS = (
    "session_start",
    "view_item",
    "add_to_cart",
    "begin_checkout",
    "add_shipping_info",
    "add_payment_info",
    "purchase",
)

# The report's steps. The base step "sessions" comes first, session_start is no step.
REPORT_STEPS = ("sessions",) + FUNNEL_EVENTS[1:]

# Segment types of the funnel report with their display order.
SEGMENT_TYPES = {"overall": 1, "device_category": 2, "continent": 3, "channel": 4}
OVERALL_VALUE = "all sessions"
UNKNOWN = "unknown"
UNKNOWN_SEGMENT_SORT = 99
UNKNOWN_CATEGORY_SORT = 999

# Two-sided 95% critical value of the normal distribution.
Z_95 = 1.959964

# Events of one device are ordered by these columns everywhere.
EVENT_ORDER = ("time_stamp", "session_id", "event_name")
TRAFFIC = ("medium", "traffic_source", "source_name")


@dataclass(frozen=True)
class Settings:
    """Window and thresholds of one build."""

    start_date: str = "20201101"
    end_date: str = "20210131"
    gap_seconds: int = 1800
    thin_below: int = 100
    full_week_days: int = 7
    z: float = Z_95

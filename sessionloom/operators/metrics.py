"""Named metrics over the session and event facts, sliced by dimensions and time grain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.config import FUNNEL_EVENTS
from sessionloom.operators.sessions import with_derived_dimensions

GRAINS = {"day": None, "week": "week", "month": "month", "quarter": "quarter", "year": "year"}
TIME = "metric_time"

# Dimension name -> column of its table.
DEVICE_DIMENSIONS = {
    "device_category": "device",
    "continent": "continent",
    "sub_continent": "sub_continent",
    "country": "country",
    "region": "region",
    "city": "city",
    "brand": "brand",
}
TRAFFIC_DIMENSIONS = {
    "medium": "medium",
    "source": "traffic_source",
    "campaign": "source_name",
}
SESSION_DIMENSIONS = ("spans_multiple_ga_sessions",)
EVENT_DIMENSIONS = ("event_name",)


@dataclass(frozen=True)
class Simple:
    """A sum over rows of a fact. ``distinct`` counts distinct devices instead.

    A ``count`` is 0, not NULL, over no rows at all.
    """

    fact: str
    value: str = ""
    distinct: bool = False
    count: bool = False


@dataclass(frozen=True)
class Ratio:
    numerator: str
    denominator: str


def _catalogue() -> dict[str, Simple | Ratio]:
    metrics: dict[str, Simple | Ratio] = {
        "sessions": Simple("sessions", "cast(session_id is not null as int)", count=True),
        "devices": Simple("sessions", distinct=True),
        "session_events_total": Simple("sessions", "event_count"),
        "session_duration_min_total": Simple(
            "sessions", "timestampdiff(SECOND, session_start, session_end) / 60D"
        ),
        "events": Simple("events", "cast(event_id is not null as int)", count=True),
        "events_per_session": Ratio("session_events_total", "sessions"),
        "avg_session_duration_min": Ratio("session_duration_min_total", "sessions"),
    }
    for step in FUNNEL_EVENTS:
        metrics[f"sessions_with_{step}"] = Simple("sessions", f"reached_{step}")
        share = "session_conversion_rate" if step == "purchase" else f"{step}_rate"
        metrics[share] = Ratio(f"sessions_with_{step}", "sessions")
    return metrics


METRICS = _catalogue()


@dataclass(frozen=True)
class Facts:
    """The tables metrics are computed from."""

    sessions: DataFrame
    events: DataFrame
    devices: DataFrame
    traffic: DataFrame


def _simple_parts(names: Sequence[str]) -> list[str]:
    parts: list[str] = []
    for name in names:
        if name not in METRICS:
            raise ValueError(f"unknown metric {name!r}")
        metric = METRICS[name]
        wanted = [name] if isinstance(metric, Simple) else [metric.numerator, metric.denominator]
        parts += [w for w in wanted if w not in parts]
    return parts


def _time(column: str, grain: str) -> Column:
    unit = GRAINS[grain]
    return F.col(column) if unit is None else F.trunc(column, unit)


def _fact_totals(
    facts: Facts,
    fact: str,
    parts: Sequence[str],
    by: Sequence[str],
    grain: str | None,
    where: Mapping[str, Sequence],
    days: tuple[date | None, date | None],
) -> DataFrame:
    """The parts that belong to one fact, per group.

    Rows are summed per device and source before any dimension is joined; only the joins the
    asked dimensions need are made. Distinct devices are counted at the end, over device rows.
    """
    dims = list(dict.fromkeys([*by, *where]))
    own = SESSION_DIMENSIONS if fact == "sessions" else (*EVENT_DIMENSIONS, *SESSION_DIMENSIONS)
    known = {*own, *DEVICE_DIMENSIONS, *TRAFFIC_DIMENSIONS}
    if unknown := set(dims) - known:
        raise ValueError(f"no path from {fact} to {', '.join(sorted(unknown))}")

    rows = with_derived_dimensions(facts.sessions) if fact == "sessions" else facts.events
    day = "session_date" if fact == "sessions" else "event_date"
    first, last = days
    if first is not None:
        rows = rows.where(F.col(day) >= F.lit(first))
    if last is not None:
        rows = rows.where(F.col(day) <= F.lit(last))
    if fact == "events" and "spans_multiple_ga_sessions" in dims:
        flags = with_derived_dimensions(facts.sessions).select("session_id", *SESSION_DIMENSIONS)
        # Events of one session are joined as one row.
        inner = ["session_id", "device_id", "traffic_source_key", day, *EVENT_DIMENSIONS]
        rows = (
            rows.groupBy(*inner)
            .agg(*[F.sum(F.expr(METRICS[p].value)).alias(p) for p in parts])
            .join(flags, "session_id", "left")
        )
        values = {p: p for p in parts}
    else:
        values = {p: METRICS[p].value for p in parts if not METRICS[p].distinct}

    time = [_time(day, grain).alias(TIME)] if grain else []
    groups = [TIME] if grain else []
    device_dims = [d for d in dims if d in DEVICE_DIMENSIONS]
    traffic_dims = [d for d in dims if d in TRAFFIC_DIMENSIONS]
    own_dims = [d for d in dims if d in own]
    distinct = [p for p in parts if METRICS[p].distinct]

    keys = own_dims + (["device_id"] if device_dims or distinct else [])
    keys += ["traffic_source_key"] if traffic_dims else []
    totals = rows.groupBy(*time, *keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(F.expr(v)).alias(p) for p, v in values.items()],
    )
    if device_dims:
        named = [F.col(DEVICE_DIMENSIONS[d]).alias(d) for d in device_dims]
        totals = totals.join(facts.devices.select("device_id", *named), "device_id", "left")
    if traffic_dims:
        if not distinct:
            # Nothing needs the device any more: one row per source and group meets the join.
            group = [*groups, *own_dims, *device_dims, "traffic_source_key"]
            totals = totals.groupBy(*group).agg(
                *[F.sum(c).alias(c) for c in ["_rows", *values]]
            )
        named = [F.col(TRAFFIC_DIMENSIONS[d]).alias(d) for d in traffic_dims]
        totals = totals.join(
            facts.traffic.select("traffic_source_key", *named), "traffic_source_key", "left"
        )
    for dim, accepted in where.items():
        wanted = F.col(dim).isin([v for v in accepted if v is not None])
        totals = totals.where(wanted | F.col(dim).isNull() if None in accepted else wanted)
    sums = {p: F.coalesce(F.sum(p), F.lit(0)) if METRICS[p].count else F.sum(p) for p in values}
    return totals.groupBy(*groups, *by).agg(
        *[total.alias(p) for p, total in sums.items()],
        *[F.countDistinct("device_id").alias(p) for p in distinct],
    )


def metric(
    facts: Facts,
    names: Sequence[str],
    by: Sequence[str] = (),
    grain: str | None = None,
    where: Mapping[str, Sequence] | None = None,
    spine: DataFrame | None = None,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """One row per group (``by`` dimensions and ``metric_time`` at ``grain``), one column per name.

    Simple metrics are computed in one pass per fact, ratios from their sums afterwards. ``where``
    maps a dimension to the values kept; ``start`` and ``end`` (inclusive) bound the days read.
    With ``spine`` (a calendar) every period of it appears; that needs a grain and no ``by``.
    """
    if grain is not None and grain not in GRAINS:
        raise ValueError(f"grain must be one of {', '.join(GRAINS)}")
    if spine is not None and (by or not grain):
        raise ValueError("a spine needs a grain and no further dimensions")
    parts = _simple_parts(names)
    groups = ([TIME] if grain else []) + list(by)
    per_fact = []
    for fact in ("sessions", "events"):
        mine = [p for p in parts if METRICS[p].fact == fact]
        if mine:
            per_fact.append(_fact_totals(facts, fact, mine, by, grain, where or {}, (start, end)))
    if len(per_fact) == 1:
        joined = per_fact[0]
    else:
        # Aligned by a union and one more grouping: groups only one fact has stay, NULLs match.
        both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), per_fact)
        joined = both.groupBy(*groups).agg(*[F.max(p).alias(p) for p in parts])
    if spine is not None:
        periods = spine.select(_time("date_day", grain).alias(TIME)).distinct()
        joined = periods.join(joined, TIME, "left")
    columns = []
    for name in names:
        m = METRICS[name]
        value = F.col(name) if isinstance(m, Simple) else F.try_divide(m.numerator, m.denominator)
        columns.append(value.alias(name))
    return joined.select(*groups, *columns)

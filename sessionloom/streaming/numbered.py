"""Numbered sessions over a stream, corrected as events come in, equal to the batch in the end.

Every device has a state and a clock, its latest event less the time events may come out of order:
the sessions that are final up to the clock, and the events after it. So a device is never late
because of others, and a device's clock needs no watermark and no timer. Each run of a device walks on from the
final part and appends the sessions it makes of all known events, with a rising revision; a number
that an event in between takes away again is appended with no events. Readers take a number's
latest revision, so open sessions are there too and nothing has to be invented to close them.

An event that belongs before the final part, or has no time (those come first of all), can't be
placed any more. It goes to the same table as a late row, and ``corrected`` takes the sessions of
such devices from the stored events, as a refresh does.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionloom.config import FUNNEL_EVENTS, TRAFFIC
from sessionloom.functions import surrogate_key
from sessionloom.operators.runs import HotKeys
from sessionloom.operators.sessions import session_rollup, sessionise

FIRST = ("session_id", "event_date", "first_touch", *TRAFFIC)
_IN = ("at", "session_id", "event_name", "event_date", "first_touch", *TRAFFIC)
_OUT = (
    "device_id string, kind string, revision bigint, session_num bigint, start bigint, end bigint, event_count bigint, ga_session_count bigint, "
    + ", ".join(f"first_{c} string" for c in FIRST)
    + ", "
    + ", ".join(f"reached_{s} int" for s in FUNNEL_EVENTS)
)
_NAMES = [c.strip().split(" ")[0] for c in _OUT.split(",")]


class Sessions:
    """The sessions of one device's events, taken in their order."""

    def __init__(self, last: int | None = None, number: int = 0, open_: dict | None = None):
        self.last, self.number, self.open = last, number, open_

    def copy(self) -> Sessions:
        open_ = self.open and self.open | {"native": set(self.open["native"]), "steps": set(self.open["steps"])}
        return Sessions(self.last, self.number, open_)

    def take(self, event: dict[str, Any], gap_seconds: int) -> dict | None:
        """Add an event; the session that it ends, if any. Whole seconds decide, as in the batch."""
        at, ended = event["at"], None
        if self.last is None or (at - self.last) // 1_000_000 > gap_seconds:
            ended, self.number = self.open, self.number + 1
            self.open = {"number": self.number, "start": at, "end": at, "events": 0, "native": set(), "steps": set(), "first": tuple(event[c] for c in FIRST)}
        own = self.open
        own["end"], own["events"] = at, own["events"] + 1
        if event["session_id"] is not None:
            own["native"].add(event["session_id"])
        if event["event_name"] in FUNNEL_EVENTS:
            own["steps"].add(event["event_name"])
        self.last = at
        return ended


def _place(event: dict[str, Any]) -> tuple:
    """Its place among the device's events; missing parts come first."""
    return event["at"], *((event[c] is not None, event[c] or "") for c in ("session_id", "event_name"))


def _session_row(device: str | None, revision: int, s: dict) -> tuple:
    steps = [int(step in s["steps"]) for step in FUNNEL_EVENTS]
    return device, "session", revision, s["number"], s["start"], s["end"], s["events"], len(s["native"]), *s["first"], *steps


def _device(gap_seconds: int, lateness_seconds: int):
    def run(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        device = key[0] if isinstance(key[0], str) else None
        known = pickle.loads(state.get[0]) if state.exists else {"sessions": (None, 0, None), "frontier": None, "waiting": [], "revision": 0, "shown": 0}
        final, waiting, frontier = Sessions(*known["sessions"]), known["waiting"], known["frontier"]
        rows: list[tuple] = []
        for frame in frames:
            frame = frame.astype(object).where(frame.notna(), None)
            for values in frame[["timed", *_IN]].itertuples(index=False, name=None):
                event = dict(zip(_IN, values[1:]))
                if not values[0] or (frontier is not None and _place(event) < frontier):
                    at = int(event["at"]) if values[0] else None
                    rows.append((device, "late", None, None, at, None, 1, None, *(event[c] for c in FIRST), *[None] * len(FUNNEL_EVENTS)))
                else:
                    waiting.append(event | {"at": int(event["at"])})
        waiting.sort(key=_place)
        passed = waiting[-1]["at"] - lateness_seconds * 1_000_000 if waiting else 0
        revision, made = known["revision"] + 1, []
        n = 0
        for n, event in enumerate(waiting + [None]):
            if event is None or event["at"] >= passed:
                break
            made.append(final.take(event, gap_seconds))
            frontier = _place(event)
        waiting = waiting[n:]
        known_now = final.copy()
        made += [known_now.take(event, gap_seconds) for event in waiting] + [known_now.open]
        rows += [_session_row(device, revision, s) for s in made if s]
        nothing = {"start": None, "end": None, "events": 0, "native": (), "steps": (), "first": (None,) * len(FIRST)}
        rows += [_session_row(device, revision, nothing | {"number": k}) for k in range(known_now.number + 1, known["shown"] + 1)]
        kept = {"sessions": (final.last, final.number, final.open), "frontier": frontier, "waiting": waiting, "revision": revision, "shown": known_now.number}
        state.update((pickle.dumps(kept),))
        yield pd.DataFrame(rows, columns=_NAMES, dtype=object)

    return run


def number_sessions(events: DataFrame, gap_seconds: int = 1800, lateness_seconds: int = 1800) -> DataFrame:
    """Revisions of sessions and late events of a stream of staged events.

    Events may come out of order by ``lateness_seconds`` without being late, and later too where
    nothing of their device that is final comes after them. Events without a device are one device.
    A device's new events are walked in one task, which holds them and those after its clock.
    """
    micros = F.unix_micros("time_stamp")
    rows = events.select(
        "device_id",
        micros.isNotNull().alias("timed"),
        F.coalesce(micros, F.lit(0)).alias("at"),
        "session_id",
        "event_name",
        F.col("event_date").cast("string").alias("event_date"),
        F.unix_micros("first_touch").cast("string").alias("first_touch"),
        *TRAFFIC,
    )
    return rows.groupBy("device_id").applyInPandasWithState(_device(gap_seconds, lateness_seconds), _OUT, "state binary", "append", "NoTimeout")


def append_available(revisions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived, append to ``path`` and stop; the next call goes on from ``checkpoint``."""
    query = (
        revisions.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return query


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def latest_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The sessions that the stream knows, one row each, with the columns of session_rollup."""
    rows = spark.read.schema(_OUT).parquet(path).where("kind = 'session'")
    values = F.struct(*[c for c in _NAMES if c not in ("device_id", "kind", "session_num")])
    last = rows.groupBy("device_id", "session_num").agg(F.max_by(values, "revision").alias("s")).where("s.event_count > 0")
    return last.select(
        surrogate_key("device_id", "session_num").alias("session_key"),
        "device_id",
        "session_num",
        F.timestamp_micros("s.start").alias("session_start"),
        F.timestamp_micros("s.end").alias("session_end"),
        F.col("s.event_count").alias("event_count"),
        F.col("s.ga_session_count").alias("ga_session_count"),
        F.col("s.first_session_id").alias("ga_session_id"),
        F.col("s.first_event_date").cast("date").alias("session_date"),
        F.timestamp_micros(F.col("s.first_first_touch").cast("bigint")).alias("first_touch"),
        *[F.col(f"s.first_{c}").alias(c) for c in TRAFFIC],
        *[F.col(f"s.reached_{s}").alias(f"reached_{s}") for s in FUNNEL_EVENTS],
    )


def late_events(spark: SparkSession, path: str) -> DataFrame:
    """(device_id, event_date, time_stamp) of the events that came too late to be placed; NULL times among them."""
    rows = spark.read.schema(_OUT).parquet(path).where("kind = 'late'")
    return rows.select("device_id", F.col("first_event_date").cast("date").alias("event_date"), F.timestamp_micros("start").alias("time_stamp"))


def corrected(spark: SparkSession, path: str, events: DataFrame, gap_seconds: int = 1800, policy: HotKeys = HotKeys()) -> DataFrame:
    """The stream's sessions, and those of devices with late events from all stored events.

    The days of late_events are those whose stored tables plans.incremental.refresh brings up to date.
    """
    late = late_events(spark, path).select(F.col("device_id").alias("_late")).distinct()
    on = _same("device_id", "_late")
    again = session_rollup(sessionise(events.join(late, on, "left_semi"), gap_seconds, policy, keep_slice=True))
    return latest_sessions(spark, path).join(late, on, "left_anti").unionByName(again)

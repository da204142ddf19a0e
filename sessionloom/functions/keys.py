"""Hash keys over natural-key columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token a NULL part hashes as, and the separator between parts.
NULL_PART = "_dbt_utils_surrogate_key_null_"
SEPARATOR = "-"


def surrogate_key(*parts: Column | str) -> Column:
    """md5 hex over the parts as text; a NULL part differs from an empty one.

    Pass timestamps as ``F.unix_micros``: their text form depends on the session time zone.
    """
    texts = [
        F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit(NULL_PART))
        for p in parts
    ]
    return F.md5(F.concat_ws(SEPARATOR, *texts))


def event_key() -> Column:
    """Key of one event: device, native session id, time and name."""
    return surrogate_key(
        "device_id", "session_id", F.unix_micros("time_stamp"), "event_name"
    )


def traffic_key(prefix: str = "") -> Column:
    """Key of one medium / source / campaign combination, NULL parts included."""
    return surrogate_key(
        f"{prefix}medium", f"{prefix}traffic_source", f"{prefix}source_name"
    )

"""Lookups in the key/value array an event carries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Value type -> field of the value struct.
VALUE_FIELDS = {
    "string": "string_value",
    "int": "int_value",
    "float": "float_value",
    "double": "double_value",
}


def event_param(key: str, value_type: str = "string", params: str = "event_params") -> Column:
    """The value stored under ``key``, read from one field of the value struct.

    NULL when the key is absent or its value sits in another field; the query fails when an
    event repeats the key. Plain array functions in the projection: rows do not multiply, the
    lookup stays in generated code, and a scan reads only the value fields asked for.
    """
    if value_type not in VALUE_FIELDS:
        raise ValueError(
            f"value_type must be one of {', '.join(VALUE_FIELDS)}; got {value_type!r}"
        )
    keys = F.col(f"{params}.key")
    at = F.array_position(keys, key).cast("int") - 1
    value = F.get(F.col(f"{params}.value.{VALUE_FIELDS[value_type]}"), at)
    hits = F.size(keys) - F.size(F.array_remove(keys, key))
    return F.when(
        hits > 1, F.raise_error(F.lit(f"event carries the key {key} more than once"))
    ).otherwise(value)

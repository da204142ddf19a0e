"""Column builders. All are built-in expressions, so they stay inside generated code."""

from sessionloom.functions.calendar import calendar_columns, week_label, week_start
from sessionloom.functions.intervals import newcombe, rate, wilson
from sessionloom.functions.keys import surrogate_key
from sessionloom.functions.params import event_param
from sessionloom.functions.text import clean_item_string, clean_string

__all__ = [
    "calendar_columns",
    "clean_item_string",
    "clean_string",
    "event_param",
    "newcombe",
    "rate",
    "surrogate_key",
    "week_label",
    "week_start",
    "wilson",
]

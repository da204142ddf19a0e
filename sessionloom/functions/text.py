"""Cleaning of exported string dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts the export writes where it has no value.
MISSING_TEXTS = ("(not set)", "(data deleted)")
NO_MEDIUM_TEXT = "(none)"
NO_MEDIUM_LABEL = "direct"
MISSING_ITEM_TEXTS = ("", "not available in demo dataset")

# One opening bracket, anything without a line break, one closing bracket, end of text.
# Pairing is not checked. \z rather than $, which in Java also stops before a final newline.
BRACKETED = r"^[(<]([^\n]*)[)>]\z"


def clean_lowered(low: Column) -> Column:
    """clean_string for lower-case text. Uses ``low`` several times, so pass a plain column."""
    # Few values open with a bracket; only those pay for the pattern.
    return (
        F.when(~(low.startswith("(") | low.startswith("<")), low)
        .when(low.isin(*MISSING_TEXTS), F.lit(None).cast("string"))
        .when(low == NO_MEDIUM_TEXT, F.lit(NO_MEDIUM_LABEL))
        .otherwise(F.regexp_replace(low, BRACKETED, "$1"))
    )


def clean_string(column: Column | str) -> Column:
    """Lower-case; missing-value texts become NULL, '(none)' becomes 'direct', outer brackets go."""
    return clean_lowered(F.lower(F.col(column) if isinstance(column, str) else column))


def clean_item_lowered(low: Column) -> Column:
    """clean_item_string for text that is lower-case already."""
    cleaned = clean_lowered(low)
    return F.when(~cleaned.isin(*MISSING_ITEM_TEXTS), cleaned)


def clean_item_string(column: Column | str) -> Column:
    """As clean_string; the further texts that item fields use for 'no value' become NULL too."""
    return clean_item_lowered(F.lower(F.col(column) if isinstance(column, str) else column))

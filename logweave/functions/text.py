"""Normalisation, level classification and display helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions.parse import PY_SPACE

# Level markers, checked on lower-cased text in this order.
CRITICAL_MARKERS = ["possible break-in attempt", "too many authentication failures"]
ERROR_MARKERS = [
    "failed password", "authentication failure", "fatal", "error", "invalid user", "user unknown",
]
WARNING_MARKERS = ["disconnect", "closed by", "preauth", "reverse mapping"]
LEVELS = ["CRITICAL", "ERROR", "WARNING", "INFO"]


def _any_contains(text: Column, markers: list[str]) -> Column:
    cond = text.contains(markers[0])
    for m in markers[1:]:
        cond = cond | text.contains(m)
    return cond


def classify_level(message: Column) -> Column:
    """CRITICAL > ERROR > WARNING > INFO by substring of the lower-cased text."""
    low = F.lower(message)
    return (
        F.when(_any_contains(low, CRITICAL_MARKERS), F.lit("CRITICAL"))
        .when(_any_contains(low, ERROR_MARKERS), F.lit("ERROR"))
        .when(_any_contains(low, WARNING_MARKERS), F.lit("WARNING"))
        .otherwise(F.lit("INFO"))
    )


def normalize_storage(event_template: Column, raw_message: Column) -> Column:
    """Storage form — template when known, whitespace collapsed, lower, no strip."""
    return F.lower(F.regexp_replace(F.coalesce(event_template, raw_message), r"\s+", " "))


def normalize_message(message: Column) -> Column:
    """Embedding form — collapse (Unicode) whitespace, strip, lower; NULL -> ''."""
    collapsed = F.regexp_replace(message, f"{PY_SPACE}+", " ")
    return F.coalesce(F.lower(F.trim(collapsed)), F.lit(""))


def iso_text(ts: Column) -> Column:
    """Python isoformat() text of a timestamp (fraction only when non-zero)."""
    full = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(full, r"\.000000$", "")


def truncate_ts(ts: Column, granularity: str) -> Column:
    """hour/day bucket, kept as timestamp_ntz; other granularities are an error."""
    if granularity not in ("hour", "day"):
        raise ValueError("granularity must be 'hour' or 'day'")
    return F.date_trunc(granularity, ts).cast("timestamp_ntz")

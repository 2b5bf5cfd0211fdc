"""Alert rows from anomaly scores (L1, L2, F8, M5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.config import DEFAULT
from logweave.functions.severity import at_least

TITLE_PREFIX = "Anomalous log detected — "  # fixed value (reference wording)


def anomaly_alerts(scores: DataFrame, message_col: str = "message", source: str | Column = "unknown",
                   ts: Column | None = None) -> DataFrame:
    """L1: one alert per scored row: title with the upper-cased severity,
    default source 'unknown', metadata (probability, raw score) as columns.
    ``ts`` defaults to the processing time, as in the reference."""
    src = F.lit(source) if isinstance(source, str) else source
    when = ts if ts is not None else F.current_timestamp().cast("timestamp_ntz")
    return scores.select(
        F.concat(F.lit(TITLE_PREFIX), F.upper(F.coalesce(F.col("severity"), F.lit("unknown")))).alias("title"),
        F.coalesce(F.col("severity"), F.lit("low")).alias("severity"),
        F.coalesce(F.col(message_col), F.lit("")).alias("message"),
        src.alias("source"),
        when.alias("timestamp"),
        F.col("anomaly_probability").alias("anomaly_probability"),
        F.col("raw_score").alias("raw_score"),
    )


def alert_gate(alerts: DataFrame, threshold: str = DEFAULT.alert_severity_threshold) -> DataFrame:
    """L2/F8: ``dispatched`` when severity rank >= threshold rank (unknown
    names rank 0), else reason 'below threshold'.  Delivery (mail) is a side
    effect left to the caller; here alerts end in a table."""
    ok = at_least(F.col("severity"), threshold)
    return alerts.withColumn("dispatched", ok).withColumn(
        "reason", F.when(~ok, F.lit("below threshold"))
    )


def recent_anomalies(scores: DataFrame, ts_col: str = "ts", min_severity: str = "high",
                     limit: int = 50, key: str = "event_id") -> DataFrame:
    """M5: newest scores at or above ``min_severity`` (a top-N report)."""
    return (
        scores.filter(at_least(F.col("severity"), min_severity))
        .orderBy(F.col(ts_col).desc_nulls_last(), F.col(key))
        .limit(limit)
    )


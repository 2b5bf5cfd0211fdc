"""Anomaly probability, severity and alert ranks (M4, F8, L2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity order and probability cut-offs of the reference.
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
CRITICAL_ABOVE = 0.8
HIGH_ABOVE = 0.65
MEDIUM_ABOVE = 0.5


def anomaly_probability(raw_score: Column) -> Column:
    """clip(0.5 - decision_value, 0, 1): higher = more anomalous."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) - raw_score))


def severity(prob: Column) -> Column:
    """Strict thresholds on the unrounded probability."""
    return (
        F.when(prob > CRITICAL_ABOVE, F.lit("critical"))
        .when(prob > HIGH_ABOVE, F.lit("high"))
        .when(prob > MEDIUM_ABOVE, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def severity_rank(sev: Column) -> Column:
    """Rank of a severity name; unknown names rank 0 (as 'low')."""
    ranks = F.create_map(*[x for k, v in SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(ranks[sev], F.lit(0))


def at_least(sev: Column, threshold: str) -> Column:
    """F8: severity rank >= threshold rank (unknown threshold -> 0)."""
    return severity_rank(sev) >= F.lit(SEVERITY_RANK.get(threshold, 0))

"""Aggregates over ``log_entries`` (A1-A9, F1, F3, F5, F7, timeline).

All are hash aggregations: Spark runs a partial aggregate in every map task
before the shuffle, so a hot template or level only costs one partial row
per task, whatever its share of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.config import DEFAULT
from logweave.functions.text import iso_text, truncate_ts

DEFAULT_ERROR_LEVELS = ["ERROR", "CRITICAL", "WARNING"]


def filter_level(df: DataFrame, level: str | None) -> DataFrame:
    """``None`` and ``'ALL'`` mean no filter (prunes the ``level`` folders)."""
    if level and level != "ALL":
        return df.filter(F.col("level") == F.lit(level))
    return df


def display_template(df: DataFrame) -> Column:
    """Template when known, else the normalised message."""
    return F.coalesce(df["event_template"], df["normalized_message"])


def frequent_errors(
    logs: DataFrame, limit: int = DEFAULT.frequent_errors_limit, level: str | None = None
) -> DataFrame:
    """A2: most frequent (event_id, template, level) among error levels.

    A given level *replaces* the default level set (so INFO is allowed).
    Ties on count are broken by the keys so the top-``limit`` is stable.
    """
    if int(limit) < 1:
        raise ValueError("limit must be at least 1")
    if level and level != "ALL":
        rows = logs.filter(F.col("level") == F.lit(level))
    else:
        rows = logs.filter(F.col("level").isin(DEFAULT_ERROR_LEVELS))
    return (
        rows.groupBy("event_id", display_template(rows).alias("template"), "level")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(
            F.col("count").desc(), F.col("event_id").asc_nulls_last(),
            F.col("template").asc_nulls_last(), F.col("level").asc_nulls_last(),
        )
        .limit(limit)
    )


def timeline(
    logs: DataFrame,
    granularity: str = "day",
    event_id: str | None = None,
    event_ids: list[str] | None = None,
    level: str | None = None,
) -> DataFrame:
    """A3: row count per hour/day bucket, optional event and level filters."""
    rows = logs.filter(F.col("log_timestamp").isNotNull())
    if event_id:
        rows = rows.filter(F.col("event_id") == F.lit(event_id))
    elif event_ids:
        rows = rows.filter(F.col("event_id").isin(list(event_ids)))
    rows = filter_level(rows, level)
    return (
        rows.groupBy(truncate_ts(F.col("log_timestamp"), granularity).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("bucket")
    )


def level_distribution(logs: DataFrame) -> DataFrame:
    """A4: rows per level, largest first."""
    return (
        logs.groupBy("level").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col("level"))
    )


def volume_hour_level(logs: DataFrame, pivot: bool = False) -> DataFrame:
    """A5: hourly volume by level (dashboard time series); optional pivot."""
    rows = logs.filter(F.col("log_timestamp").isNotNull()).withColumn(
        "time", truncate_ts(F.col("log_timestamp"), "hour")
    )
    if pivot:
        from logweave.functions.text import LEVELS

        # pivot values are listed, so no extra job discovers them; empty cells count 0
        return rows.groupBy("time").pivot("level", LEVELS).count().na.fill(0, LEVELS).orderBy("time")
    return (
        rows.groupBy("time", "level").agg(F.count(F.lit(1)).alias("count"))
        .orderBy("time", "level")
    )


def top_error_templates(logs: DataFrame, limit: int = 20) -> DataFrame:
    """ERROR rows per template (NULL template is its own group)."""
    return (
        logs.filter(F.col("level") == "ERROR")
        .groupBy("event_template").agg(F.count(F.lit(1)).alias("occurrences"))
        .orderBy(F.col("occurrences").desc(), F.col("event_template").asc_nulls_last())
        .limit(limit)
    )


def errors_last_24h(logs: DataFrame, ref_ts: str | None = None, hours: int = 24) -> DataFrame:
    """ERROR rows newer than ``ref_ts - hours`` (``ref_ts`` defaults to now)."""
    ref = (F.lit(ref_ts).cast("timestamp_ntz") if ref_ts
           else F.current_timestamp().cast("timestamp_ntz"))
    return logs.filter(
        (F.col("level") == "ERROR")
        & (F.col("log_timestamp") > ref - F.make_dt_interval(F.lit(0), F.lit(hours)))
    ).agg(F.count(F.lit(1)).alias("count"))


def panel_totals(logs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Total rows and distinct message patterns (two scalar subqueries)."""
    spark = logs.sparkSession
    return spark.range(1).select(
        logs.agg(F.count(F.lit(1))).scalar().alias("total_logs"),
        embeddings.agg(F.count(F.lit(1))).scalar().alias("distinct_patterns"),
    )


def distinct_messages(logs: DataFrame, limit: int | None = None, ordered: bool = True) -> DataFrame:
    """One row per normalised message with MIN(event_id), MIN(level)
    (alphabetical, as in SQL) and its count, most frequent first.

    ``ordered=False`` skips the global sort when only the set matters."""
    out = logs.groupBy("normalized_message").agg(
        F.min("event_id").alias("representative_event_id"),
        F.min("level").alias("representative_level"),
        F.count(F.lit(1)).alias("occurrences"),
    )
    if ordered or limit:
        out = out.orderBy(F.col("occurrences").desc(), F.col("normalized_message"))
    return out.limit(limit) if limit else out


def embedded_log_count(logs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """J4 as a count: rows are first counted per message (partial aggregation
    in every task), so the semi join sees one row per message and a message
    holding a third of all rows cannot skew it."""
    per_msg = logs.groupBy("normalized_message").agg(F.count(F.lit(1)).alias("_n"))
    hit = per_msg.join(embeddings.select("normalized_message"), "normalized_message", "left_semi")
    return hit.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("embedded_logs"))


def stats_overview(logs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """A1: one row of global statistics, levels as ``LEVEL=count`` text.

    The logs are scanned once, into counts per (level, event, message) with
    partial aggregation in every task; all figures come from those counts.
    """
    counts = logs.groupBy("level", "event_id", "normalized_message").agg(
        F.count(F.lit(1)).alias("n"), F.min("log_timestamp").alias("lo"), F.max("log_timestamp").alias("hi"))
    return stats_of_counts(counts, embeddings)


def stats_of_counts(counts: DataFrame, embeddings: DataFrame) -> DataFrame:
    """A1 from counts (level, event_id, normalized_message, n, lo, hi: first and last time)."""
    known = embeddings.select("normalized_message", F.lit(True).alias("_known")).distinct()
    marked = counts.join(known, "normalized_message", "left")
    by_event = marked.groupBy("level", "event_id").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("_known"), F.col("n")).otherwise(0)).alias("e"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # totals of each level, each event and all rows in one pass over the small table
    sets = by_event.cube("level", "event_id").agg(
        F.grouping_id().alias("g"), F.sum("n").alias("n"), F.sum("e").alias("e"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    item = F.struct((-F.col("n")).alias("neg"), F.col("level").alias("level"), F.col("n").alias("n"))
    row = sets.agg(
        F.coalesce(F.max(F.when(F.col("g") == 3, F.col("n"))), F.lit(0)).alias("total_logs"),
        F.coalesce(F.max(F.when(F.col("g") == 3, F.col("e"))), F.lit(0)).alias("embedded_logs"),
        F.count(F.when((F.col("g") == 2) & F.col("event_id").isNotNull(), 1)).alias("event_count"),
        F.max(F.when(F.col("g") == 3, F.col("lo"))).alias("lo"),
        F.max(F.when(F.col("g") == 3, F.col("hi"))).alias("hi"),
        F.sort_array(F.collect_list(F.when(F.col("g") == 1, item))).alias("items"),
    )
    levels = F.concat_ws(",", F.transform("items", lambda s: F.concat(s["level"], F.lit("="), s["n"].cast("string"))))
    return row.select(
        "total_logs", "embedded_logs",
        embeddings.agg(F.count(F.lit(1))).scalar().alias("embedded_messages"),
        "event_count", iso_text(F.col("lo")).alias("first_log"), iso_text(F.col("hi")).alias("last_log"), levels.alias("levels"),
    )

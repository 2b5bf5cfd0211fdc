"""Hourly counts of the logs, kept by appended batch and read in their place.

A batch becomes one row for each (hour, level, event, template, message) with
its count and its first and last time.  Rows of batches add up, so the reports
below read a table that grows with distinct messages and hours and not with
log rows.  Batches carry increasing numbers: one that comes again (a replayed
stream batch) replaces its own rows, and one that was merged already is left
out.  ``compact`` merges batches, so that files don't grow with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.config import DEFAULT
from logweave.functions.text import LEVELS, truncate_ts
from logweave.operators.analytics import DEFAULT_ERROR_LEVELS, display_template, filter_level, stats_of_counts
from logweave.sources.versioned import TableSet

KEY = ["hour", "level", "event_id", "event_template", "normalized_message"]


def counted(logs: DataFrame) -> DataFrame:
    """Hourly counts of log rows; rows without a time count under a null hour."""
    rows = logs.withColumn("hour", truncate_ts(F.col("log_timestamp"), "hour"))
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("log_timestamp").alias("lo"), F.max("log_timestamp").alias("hi"))


def merged(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _batch(name: str) -> tuple[int, int]:
    """First and last batch number of a stored part."""
    first, last = name.removeprefix("counts-").split("-")
    return int(first), int(last)


def _parts(tables: TableSet, version: int | None = None) -> dict[str, list[str]]:
    return {k: v for k, v in tables.tables(version).items() if k.startswith("counts-")}


def add_batch(tables: TableSet, batch: int, logs: DataFrame) -> bool:
    """Counts the rows of a batch.  False, and nothing is written, for a batch that was merged already; one
    that is stored alone is replaced."""
    base = tables.version()
    if any(first < last and first <= batch <= last for first, last in map(_batch, _parts(tables, base))):
        return False
    path, _ = tables.stage(counted(logs), "counts")
    tables.commit({f"counts-{batch}-{batch}": [path]}, base)
    return True


def compact(tables: TableSet, until: int) -> bool:
    """Merges the parts of batches up to ``until``, all of which have to be in; later replays of them are left
    out.  False if there are fewer than two."""
    base = tables.version()
    old = {k: v for k, v in _parts(tables, base).items() if _batch(k)[1] <= until}
    if len(old) < 2:
        return False
    first, last = min(_batch(k)[0] for k in old), max(_batch(k)[1] for k in old)
    spark = tables.spark
    path, _ = tables.stage(merged(spark.read.parquet(*[p for ps in old.values() for p in ps])), "counts")
    tables.commit({**dict.fromkeys(old), f"counts-{first}-{last}": [path]}, base)
    return True


def read_counts(tables: TableSet) -> DataFrame:
    """Rows of all parts (a key can have one in each): every report adds them up."""
    folders = [p for ps in _parts(tables).values() for p in ps]
    if not folders:
        raise KeyError(f"no counts under {tables.root}")
    return tables.spark.read.parquet(*folders)


def _total() -> Column:
    return F.coalesce(F.sum("n"), F.lit(0)).cast("long")


def stats_overview(counts: DataFrame, embeddings: DataFrame) -> DataFrame:
    """A1."""
    by_message = counts.groupBy("level", "event_id", "normalized_message").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return stats_of_counts(by_message, embeddings)


def frequent_errors(counts: DataFrame, limit: int = DEFAULT.frequent_errors_limit, level: str | None = None) -> DataFrame:
    """A2: as over the logs, ties included."""
    if int(limit) < 1:
        raise ValueError("limit must be at least 1")
    rows = counts.filter(F.col("level") == level) if level and level != "ALL" else counts.filter(F.col("level").isin(DEFAULT_ERROR_LEVELS))
    order = [F.col(c).asc_nulls_last() for c in ("event_id", "template", "level")]
    found = rows.groupBy("event_id", display_template(rows).alias("template"), "level").agg(_total().alias("count"))
    return found.orderBy(F.col("count").desc(), *order).limit(limit)


def timeline(counts: DataFrame, granularity: str = "day", event_id: str | None = None, event_ids: list[str] | None = None,
             level: str | None = None) -> DataFrame:
    """A3: rows a day or hour."""
    rows = filter_level(counts.filter(F.col("hour").isNotNull()), level)
    wanted = [event_id] if event_id else event_ids
    if wanted:
        rows = rows.filter(F.col("event_id").isin(list(wanted)))
    return rows.groupBy(truncate_ts(F.col("hour"), granularity).alias("bucket")).agg(_total().alias("count")).orderBy("bucket")


def level_distribution(counts: DataFrame) -> DataFrame:
    """A4."""
    return counts.groupBy("level").agg(_total().alias("count")).orderBy(F.col("count").desc(), F.col("level"))


def volume_hour_level(counts: DataFrame, pivot: bool = False) -> DataFrame:
    """A5."""
    rows = counts.filter(F.col("hour").isNotNull()).withColumnRenamed("hour", "time")
    if pivot:
        return rows.groupBy("time").pivot("level", LEVELS).agg(_total()).na.fill(0, LEVELS).orderBy("time")
    return rows.groupBy("time", "level").agg(_total().alias("count")).orderBy("time", "level")


def top_error_templates(counts: DataFrame, limit: int = 20) -> DataFrame:
    """A6."""
    found = counts.filter(F.col("level") == "ERROR").groupBy("event_template").agg(_total().alias("occurrences"))
    return found.orderBy(F.col("occurrences").desc(), F.col("event_template").asc_nulls_last()).limit(limit)


def panel_totals(counts: DataFrame, embeddings: DataFrame) -> DataFrame:
    """A7."""
    return counts.sparkSession.range(1).select(
        counts.agg(_total()).scalar().alias("total_logs"),
        embeddings.agg(F.count(F.lit(1))).scalar().alias("distinct_patterns"))

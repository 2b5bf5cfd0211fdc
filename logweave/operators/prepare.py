"""Batch preparation of ``log_entries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.config import DEFAULT
from logweave.functions.parse import openssh_prefix, prefix_groups
from logweave.functions.text import classify_level, normalize_storage
from logweave.sources.lines import limit_lines

LOG_COLUMNS = [
    "line_id", "source", "log_timestamp", "month", "day", "time_text", "host", "service",
    "process_id", "level", "event_id", "raw_message", "normalized_message", "event_template",
]


def parse_prefix(lines: DataFrame, year: int = DEFAULT.log_year) -> DataFrame:
    """The OpenSSH prefix fields of every raw line (NULL where no match)."""
    p = openssh_prefix(F.col("raw_line"), year, F.col("_prefix"))
    return lines.select("line_id", "raw_line", prefix_groups("raw_line").alias("_prefix")).select(
        "line_id",
        *[p[f].alias(f) for f in ("month", "day", "time_text", "host", "service", "process_id",
                                   "content", "log_timestamp")],
    )


def prepare_log_entries(
    lines: DataFrame,
    structured: DataFrame | None = None,
    year: int = DEFAULT.log_year,
    limit: int | None = None,
    source: str = DEFAULT.source_name,
) -> DataFrame:
    """Raw lines LEFT JOIN structured rows on ``line_id`` -> 14 log columns.

    The join shuffles both sides on ``line_id`` (sort-merge at scale, AQE may
    switch it); the limit is one predicate that Catalyst copies to the
    structured side.  Parsing, fallback and classification are narrow
    column expressions in the same stage.
    """
    lines = limit_lines(lines, limit)
    if structured is None:
        joined = lines.select(
            "line_id", "raw_line",
            F.lit(None).cast("string").alias("raw_message"),
            F.lit(None).cast("string").alias("event_id"),
            F.lit(None).cast("string").alias("event_template"),
        )
    else:
        structured = limit_lines(structured, limit).select(
            "line_id", "raw_message", "event_id", "event_template"
        )
        joined = lines.select("line_id", "raw_line").join(structured, "line_id", "left")
    # the pattern is evaluated once a line, in a step of its own
    joined = joined.withColumn("_prefix", prefix_groups("raw_line"))
    p = openssh_prefix(F.col("raw_line"), year, F.col("_prefix"))
    raw_message = F.coalesce(F.col("raw_message"), p["content"], F.col("raw_line"))  # N4
    staged = joined.select(
        "line_id",
        F.lit(source).alias("source"),
        p["log_timestamp"].alias("log_timestamp"),
        p["month"].alias("month"),
        p["day"].alias("day"),
        p["time_text"].alias("time_text"),
        p["host"].alias("host"),
        p["service"].alias("service"),
        p["process_id"].alias("process_id"),
        "event_id",
        raw_message.alias("raw_message"),
        "event_template",
    )
    return staged.select(
        *LOG_COLUMNS[:9],
        classify_level(F.col("raw_message")).alias("level"),
        "event_id",
        "raw_message",
        normalize_storage(F.col("event_template"), F.col("raw_message")).alias("normalized_message"),
        "event_template",
    )


def prepare_dataset(
    entries: DataFrame,
    templates: DataFrame,
    parquet_dir: str,
    csv_dir: str,
    templates_csv_dir: str,
) -> DataFrame:
    """S5 + S6 + S9: write the entries once to Parquet (partitioned by level),
    export CSV from the written Parquet instead of re-running the parse, and
    count rows with ``observe`` during the writes (no extra scan).  Gives one
    row: log_rows, template_rows."""
    from pyspark.sql import Observation

    from logweave.sources.csv import write_csv
    from logweave.sources.parquet import read_log_entries, write_log_entries

    spark = entries.sparkSession
    obs_logs = Observation("log_rows")
    write_log_entries(entries.observe(obs_logs, F.count(F.lit(1)).alias("n")), parquet_dir)
    stored = read_log_entries(spark, parquet_dir).select(*LOG_COLUMNS)
    write_csv(stored, csv_dir)
    obs_tpl = Observation("template_rows")
    write_csv(templates.observe(obs_tpl, F.count(F.lit(1)).alias("n")), templates_csv_dir)
    counts = (int(obs_logs.get["n"]), int(obs_tpl.get["n"]))
    return spark.createDataFrame([counts], "log_rows long, template_rows long")

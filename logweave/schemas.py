"""Table schemas (S8) as StructType constants.

The relational DDL of the reference becomes typed DataFrame schemas;
``create_empty_tables`` materialises them as empty Parquet tables.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

EVENT_TEMPLATES = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("event_template", T.StringType(), False),
    T.StructField("occurrences", T.IntegerType(), False),
])

LOG_ENTRIES = T.StructType([
    T.StructField("line_id", T.LongType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("log_timestamp", T.TimestampNTZType(), True),
    T.StructField("month", T.StringType(), True),
    T.StructField("day", T.IntegerType(), True),
    T.StructField("time_text", T.StringType(), True),
    T.StructField("host", T.StringType(), True),
    T.StructField("service", T.StringType(), True),
    T.StructField("process_id", T.IntegerType(), True),
    T.StructField("level", T.StringType(), False),
    T.StructField("event_id", T.StringType(), True),
    T.StructField("raw_message", T.StringType(), False),
    T.StructField("normalized_message", T.StringType(), False),
    T.StructField("event_template", T.StringType(), True),
])


def message_embeddings_schema(dim: int = 384) -> T.StructType:
    # the vector dimension is a parameter; Q4 checks size(embedding) = dim
    return T.StructType([
        T.StructField("normalized_message", T.StringType(), False),
        T.StructField("representative_event_id", T.StringType(), True),
        T.StructField("representative_level", T.StringType(), True),
        T.StructField("occurrences", T.LongType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
        T.StructField("updated_at", T.TimestampNTZType(), False),
    ])


MESSAGE_EMBEDDINGS = message_embeddings_schema()

PIPELINE_RUNS = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("command", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("details", T.StringType(), False),
    T.StructField("started_at", T.TimestampNTZType(), False),
    T.StructField("finished_at", T.TimestampNTZType(), True),
])

STRUCTURED_CSV = T.StructType([
    T.StructField("LineId", T.LongType(), True),
    T.StructField("Content", T.StringType(), True),
    T.StructField("EventId", T.StringType(), True),
    T.StructField("EventTemplate", T.StringType(), True),
])

TEMPLATES_CSV = T.StructType([
    T.StructField("EventId", T.StringType(), True),
    T.StructField("EventTemplate", T.StringType(), True),
    T.StructField("Occurrences", T.IntegerType(), True),
])

TABLES = {
    "event_templates": EVENT_TEMPLATES,
    "log_entries": LOG_ENTRIES,
    "message_embeddings": MESSAGE_EMBEDDINGS,
    "pipeline_runs": PIPELINE_RUNS,
}

REQUIRED_LOG_COLUMNS = ("line_id", "level", "raw_message", "normalized_message")


def create_empty_tables(spark: SparkSession, root: str) -> dict[str, str]:
    """(Re)create every table as an empty Parquet folder under ``root``."""
    paths = {}
    for name, schema in TABLES.items():
        path = f"{root}/{name}"
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
        paths[name] = path
    return paths

"""Parquet sink partitioned by level; the log rows in the order that searches look them up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_log_entries(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Partition by ``level`` (level filters prune folders) and sort each file
    by time so row-group min/max statistics skip on time ranges."""
    (
        df.sortWithinPartitions("level", "log_timestamp")
        .write.mode(mode)
        .partitionBy("level")
        .parquet(path)
    )
    return path


def read_log_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_search_store(logs: DataFrame, path: str, files: int | None = None, row_group_bytes: int = 8 << 20,
                       page_rows: int = 1_000) -> str:
    """Log rows clustered by message for K1, K3 and K5: a search pushes its messages as literals, and
    Parquet's statistics (row groups and pages, ``page_rows`` rows each) and Bloom filters skip the rest.

    Rows are sorted by message, time and line in ranges of that order, so the rows of one message,
    a third of the table or not, spread over as many files as they need.  Bloom filters on the message
    and on ``id`` (the row that K3 starts from) leave the row groups that may hold them.
    """
    keyed = logs if "id" in logs.columns else logs.withColumn("id", F.col("line_id"))
    order = ["normalized_message", "log_timestamp", "line_id"]
    n = files or int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    options = {"parquet.block.size": str(row_group_bytes), "parquet.page.row.count.limit": str(page_rows)}
    for column in ("normalized_message", "id"):
        options[f"parquet.bloom.filter.enabled#{column}"] = "true"
        options[f"parquet.bloom.filter.adaptive.enabled#{column}"] = "true"
    keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").options(**options).parquet(path)
    return path

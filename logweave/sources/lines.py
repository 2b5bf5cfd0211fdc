"""Text-line source numbered 1..n in file order, and the line limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.session import written


#: Splits whose offsets are broadcast (24 bytes each); beyond, the join is left to the planner.
BROADCAST_SPLITS = 2_000_000


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_id, raw_line)`` with ``line_id`` = 1-based position in file order.

    Spark packs file splits into partitions by size, so partition order is
    not file order.  Each row carries its split (a hash of file and block
    start, from the hidden ``_metadata`` column) and a per-partition increasing
    id; one small aggregate per split gives its row count, a running sum over
    the splits in (file, start) order gives each split's offset.  The offsets
    (three numbers a split) are written and broadcast, so the text is read
    twice but neither stored nor shuffled.  The packing is pinned for both
    scans; a row without an offset stops the job.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # else it follows the cores that happen to be there when a scan is planned
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = spark.read.text(path)
    keyed = lines.select(file.alias("_file"), start.alias("_start"), F.xxhash64(file, start).alias("_split"), F.monotonically_increasing_id().alias("_mono"))
    splits = keyed.groupBy("_file", "_start", "_split").agg(F.min("_mono").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(splits.select("_split", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift")), "line-offsets")
    n, distinct = offsets.agg(F.count(F.lit(1)), F.count_distinct("_split")).first()
    if n != distinct:
        raise RuntimeError("two splits have one hash")
    raw = lines.select(F.col("value").alias("raw_line"), F.xxhash64(file, start).alias("_split"), F.monotonically_increasing_id().alias("_mono"))
    joined = raw.join(F.broadcast(offsets) if n <= BROADCAST_SPLITS else offsets, "_split", "left")
    shift = F.coalesce("_shift", F.raise_error(F.lit("the text changed between its two scans")).cast("long"))
    return joined.select((F.col("_mono") + shift).alias("line_id"), "raw_line")


def limit_lines(df: DataFrame, limit: int | None, column: str = "line_id") -> DataFrame:
    """Keep ``line_id <= limit`` (a predicate, not LIMIT, so it prunes both join sides)."""
    if not limit:
        return df
    return df.filter(F.col(column) <= F.lit(int(limit)))


def write_lines(df: DataFrame, path: str, column: str = "raw_line", order_by: str = "line_id") -> str:
    """Write one text column in ``order_by`` order (range-partitioned part files)."""
    df.orderBy(order_by).select(column).write.mode("overwrite").text(path)
    return path

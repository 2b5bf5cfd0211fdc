"""Keyed tables in hash buckets: an upsert rewrites the buckets of the changed keys alone.

A table is a folder with one sub-folder a bucket; the bucket follows from the
key's hash and the table's number of buckets.  An upsert reads those buckets,
puts new rows over old ones of their key, writes the result to a table of its
own and then replaces the buckets' folders (dynamic partition overwrite).
Files of all other buckets stay untouched.  If a job dies while it replaces
them, the same upsert run again gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.session import written

BUCKETS = 64
#: rows of a bucket that one task sorts and writes, about
PART_ROWS = 100_000


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _place(df: DataFrame, path: str, key: str, buckets: int, touched: int) -> None:
    """Writes the ``touched`` buckets that ``df`` has rows of, each by as many tasks as its rows need."""
    parts = max(1, -(-df.count() // (PART_ROWS * max(1, touched))))
    part = F.pmod(F.xxhash64(F.lit("part"), F.col(key)), F.lit(parts)).cast("int")
    placed = df.withColumn("bucket", bucket_of(key, buckets))
    # by number: two buckets never meet in one task, as their hashes would
    placed = placed.repartitionById(buckets * parts, F.col("bucket") * parts + part).sortWithinPartitions("bucket", key)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def upsert_bucketed(spark: SparkSession, path: str, new: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The table at ``path`` (made if it isn't there) after ``new``, one row a key, has replaced the rows of
    its keys.  ``buckets`` has to be that of the table's first upsert.

    Read the table again after each upsert: frames over it name the files that were there before.
    Null keys are one key.  Without new rows nothing is written.  Bucket numbers of the new keys (up to
    ``buckets`` of them) reach the driver.
    """
    new = written(new, "upsert-new")
    touched = [r.bucket for r in new.select(bucket_of(key, buckets).alias("bucket")).distinct().collect()]
    if not exists(spark, path):
        _place(new, path, key, buckets, len(touched))
        return read_bucketed(spark, path)
    if touched:
        old = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).drop("bucket")
        other = new.select(F.col(key).alias("_key"))
        kept = old.join(other, old[key].eqNullSafe(other["_key"]), "left_anti")
        # a table of its own first: a bucket isn't replaced while it is read
        _place(written(kept.unionByName(new), "upsert-merged"), path, key, buckets, len(touched))
    return read_bucketed(spark, path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder))

"""Table loading, keyed upsert, index stats and the run ledger.

Tables are Parquet folders under a root (on a cluster: a folder in the
shared storage, e.g. under ``spark.checkpoint.dir`` or a warehouse path).
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave import schemas
from logweave.sources.bucketed import BUCKETS, upsert_bucketed
from logweave.sources.versioned import TableSet


def conform(df: DataFrame, schema) -> DataFrame:
    """Select and cast ``df`` to a table schema (column order and types)."""
    return df.select(*[F.col(f.name).cast(f.dataType.simpleString()).alias(f.name) for f in schema.fields])


def load_table(df: DataFrame, path: str, reset: bool = True, partition_by: str | None = None) -> int:
    """Overwrite (reset) or append; returns the rows written, counted by
    an ``observe`` on the write itself (no second scan)."""
    from pyspark.sql import Observation

    obs = Observation(f"load_{uuid.uuid4().hex[:8]}")
    writer = df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("overwrite" if reset else "append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return int(obs.get["n"])


def load_processed(spark: SparkSession, logs: DataFrame, templates: DataFrame, root: str,
                   reset: bool = True) -> dict[str, int]:
    """event_templates then log_entries; a reset empties the embeddings of the old entries too."""
    if reset:
        load_table(spark.createDataFrame([], schemas.MESSAGE_EMBEDDINGS), f"{root}/message_embeddings", True)
    return {
        "event_templates": load_table(conform(templates, schemas.EVENT_TEMPLATES), f"{root}/event_templates", reset),
        "log_entries": load_table(conform(logs, schemas.LOG_ENTRIES), f"{root}/log_entries", reset),
    }


def load_versioned(tables: TableSet, logs: DataFrame, templates: DataFrame, reset: bool = True) -> dict[str, int]:
    """S7 as one commit: readers see both tables of a load or the former ones, also if it fails half-way.
    A reset takes out the embeddings of the old entries, an append keeps them."""
    base = tables.version()
    before = {} if reset else tables.tables(base)
    changes: dict[str, list[str] | None] = {"message_embeddings": None} if reset else {}
    counts = {}
    for name, df, schema in (("event_templates", templates, schemas.EVENT_TEMPLATES), ("log_entries", logs, schemas.LOG_ENTRIES)):
        path, counts[name] = tables.stage(conform(df, schema), name)
        changes[name] = [*before.get(name, []), path]
    tables.commit(changes, base)
    return counts


def accepted_documents(docs: DataFrame, key: str = "id", dim: int | None = None, order_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(one row a key, one-row {indexed, errors})`` of a batch of documents, as ``upsert_documents`` says."""
    bad = F.col(key).isNull() | F.col("embedding").isNull()
    if dim is not None:
        bad = bad | (F.size("embedding") != dim)
    flagged = docs.withColumn("_bad", F.coalesce(bad, F.lit(True)))
    good = flagged.filter(~F.col("_bad")).drop("_bad")
    counts = flagged.agg(
        F.coalesce(F.sum((~F.col("_bad")).cast("long")), F.lit(0)).alias("indexed"),
        F.coalesce(F.sum(F.col("_bad").cast("long")), F.lit(0)).alias("errors"),
    )
    rank = [F.col(order_by)] if order_by else []
    last = F.max_by(F.struct(*docs.columns), F.struct(*rank, F.xxhash64(*docs.columns)))
    # dealt by key before they are sorted: a task that reads much would else sort all that it reads
    good = good.repartition(key).groupBy(key).agg(last.alias("_d")).select(*[F.col("_d")[c].alias(c) for c in docs.columns])
    return good, counts


def upsert_documents(existing: DataFrame | None, docs: DataFrame, key: str = "id",
                     dim: int | None = None, order_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Keyed upsert of search documents.  Rows with a NULL key or a
    vector of the wrong dimension are errors and are not indexed.  Of several
    rows with one key the last by ``order_by`` stays (NULL first; ties and no
    column: by a hash of the row), so the index holds one document a key.
    Returns ``(index after upsert, one-row {indexed, errors})``; ``indexed``
    counts the accepted rows."""
    good, counts = accepted_documents(docs, key, dim, order_by)
    if existing is None:
        return good, counts
    kept = existing.join(good.select(key), key, "left_anti")
    return kept.unionByName(good), counts


def upsert_index(spark: SparkSession, path: str, docs: DataFrame, key: str = "id", dim: int | None = None,
                 order_by: str | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """S11 on a stored index in hash buckets: as ``upsert_documents``, but only the files of buckets with
    changed keys are rewritten."""
    good, counts = accepted_documents(docs, key, dim, order_by)
    return upsert_bucketed(spark, path, good, key, buckets), counts


def index_stats(spark: SparkSession, path: str) -> DataFrame:
    """Exists, document count and stored bytes of an index table (file
    sizes from the hidden ``_metadata`` column; no extra file-system calls)."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([(False, None, None)], "exists boolean, doc_count long, store_size_bytes long")
    files = df.select("_metadata.file_path", "_metadata.file_size").distinct()
    return spark.range(1).select(
        F.lit(True).alias("exists"),
        df.agg(F.count(F.lit(1))).scalar().alias("doc_count"),
        files.agg(F.sum("file_size")).scalar().cast("long").alias("store_size_bytes"),
    )


def drop_index(spark: SparkSession, path: str) -> bool:
    """Delete an index folder (Hadoop FileSystem of the session)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jvm_path) and fs.delete(jvm_path, True))


def record_run(spark: SparkSession, ledger_path: str, command: str, status: str,
               details: dict | None = None, started_at: datetime | None = None) -> DataFrame:
    """Append one run row (JSON details) to the ledger table."""
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    row = [(uuid.uuid4().hex, command, status, json.dumps(details or {}, ensure_ascii=False, sort_keys=True),
            started_at or now, now)]
    df = spark.createDataFrame(row, schemas.PIPELINE_RUNS)
    df.write.mode("append").parquet(ledger_path)
    return spark.read.parquet(ledger_path)

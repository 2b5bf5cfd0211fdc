"""Incremental message embedding (E1-E3, J3, A9) and the set-based upsert.

Only distinct normalised messages are embedded, and only those without a
vector yet.  The distinct-message aggregate runs *before* the anti join:
partial aggregation in every map task shrinks the log table to one row per
(task, message) before anything is shuffled, so a template holding a third
of all rows costs no more than any other.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.config import DEFAULT
from logweave.functions.vector import hash_embed
from logweave.operators.analytics import distinct_messages
from logweave.session import written
from logweave.sources.bucketed import BUCKETS, exists, read_bucketed, upsert_bucketed


def encode(df: DataFrame, text_col: str = "normalized_message", dim: int = DEFAULT.embedding_dim,
           out: str = "embedding") -> DataFrame:
    """Default encoder (tokens hashed in the JVM, bucket sums in an Arrow-batched helper)."""
    return df.withColumn(out, hash_embed(F.col(text_col), dim))


def encode_with(df: DataFrame, model_fn: Callable[[list[str]], list[list[float]]],
                text_col: str = "normalized_message", out: str = "embedding",
                batch_size: int = 128) -> DataFrame:
    """E2 hook: any batch model through ``mapInPandas`` (Arrow batches of
    ``batch_size`` texts; the model is built once per Python worker by the
    caller's ``model_fn`` closure)."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size].copy()
                part[out] = list(model_fn(part[text_col].fillna("").tolist()))
                yield part

    return df.mapInPandas(run, schema)


def encode_query(text: str, dim: int = DEFAULT.embedding_dim) -> list[float]:
    """The E2 vector of one query string, computed on the driver
    (bit-identical to the Spark expression: integer sums, one sqrt, one
    division, float32 rounding)."""
    import numpy as np

    raw = [0.0] * dim
    for tok in re.split(r"[^a-z0-9]+", text.lower()):
        if not tok:
            continue
        h = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16)
        raw[h % dim] += 1.0 if (h // dim) % 2 == 0 else -1.0
    n = math.sqrt(sum(x * x for x in raw))
    return [float(np.float32(x / n if n > 0 else 0.0)) for x in raw]


def messages_to_embed(logs: DataFrame, existing: DataFrame | None = None,
                      limit_texts: int | None = None) -> DataFrame:
    """J3 + A8: distinct messages (with representative id/level and count)
    that have no vector yet, most frequent first."""
    grouped = distinct_messages(logs, ordered=False)
    if existing is not None:
        grouped = grouped.join(existing.select("normalized_message"), "normalized_message", "left_anti")
    if limit_texts:  # most frequent first only matters when the run is capped
        return grouped.orderBy(F.col("occurrences").desc(), F.col("normalized_message")).limit(limit_texts)
    return grouped


def upsert(existing: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """Keyed upsert: rows of ``new`` replace same-key rows of ``existing``."""
    if existing is None:
        return new
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def embed_incremental(logs: DataFrame, existing: DataFrame | None = None,
                      dim: int = DEFAULT.embedding_dim, limit_texts: int | None = None,
                      updated_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns ``(table after upsert, rows embedded by this run)``."""
    todo = messages_to_embed(logs, existing, limit_texts)
    ts = (F.lit(updated_at).cast("timestamp_ntz") if updated_at
          else F.current_timestamp().cast("timestamp_ntz"))
    new = encode(todo, dim=dim).select(
        "normalized_message", "representative_event_id", "representative_level",
        "occurrences", "embedding", ts.alias("updated_at"),
    )
    return upsert(existing, new, "normalized_message"), new


def embed_stored(spark: SparkSession, path: str, logs: DataFrame, dim: int = DEFAULT.embedding_dim,
                 limit_texts: int | None = None, updated_at: str | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """E1 on a stored table in hash buckets: ``(table after the upsert, rows embedded by this run)``.  Only
    keys and vectors of messages that are new are written, into their buckets' files."""
    existing = read_bucketed(spark, path) if exists(spark, path) else None
    _, new = embed_incremental(logs, existing, dim, limit_texts, updated_at)
    new = written(new, "embedded-new")
    return upsert_bucketed(spark, path, new, "normalized_message", buckets), new


def embed_summary(new_rows: DataFrame) -> DataFrame:
    """Distinct texts embedded and log rows they cover."""
    return new_rows.agg(
        F.count(F.lit(1)).alias("distinct_texts"),
        F.coalesce(F.sum("occurrences"), F.lit(0)).cast("long").alias("covered_logs"),
    )

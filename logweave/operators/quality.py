"""Data-quality checks that replace the relational constraints (Q1-Q4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: str = "line_id") -> DataFrame:
    """Q1: keys seen more than once, with their count (partial agg per task)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def orphans(logs: DataFrame, templates: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows whose (non-null) key is missing from the dictionary.
    Counted per key before the anti join, so the join sees one row per key."""
    per_key = logs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return per_key.join(templates.select(key), key, "left_anti")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q3: NULLs per required column, one row."""
    return df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"null_{c}") for c in columns])


def vector_check(vecs: DataFrame, dim: int) -> DataFrame:
    """Q4: vectors total, NULL, and of the wrong dimension."""
    return vecs.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.sum(F.col("embedding").isNull().cast("long")).alias("n_null"),
        F.sum((F.col("embedding").isNotNull() & (F.size("embedding") != dim)).cast("long")).alias("n_bad_dim"),
    )

"""Folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def first_by_hash(ids: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows of a table with doc_id, the least by a hash of the id: the same at every run."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out: tuple[int, int], rows: int) -> DataFrame:
    """doc_id, text and y of at most ``rows`` labelled documents outside the held-out fold.

    Null labels and ids are left out; an id that is listed with both labels counts as 1; the first text
    by code point stands for a repeated id.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(~in_fold(F.col("doc_id"), *held_out))
    known = first_by_hash(known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")), rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

"""Training-data pipeline: each stage works on the documents that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logweave.llm.cgk_decontam import clean_documents
from logweave.llm.lsh_forest import one_of_each
from logweave.llm.pu_quality import good_documents, learn
from logweave.llm.shared import written
from logweave.llm.source_mix import mixed_documents
from logweave.llm.token_output import read_boundaries, write_token_ids
from logweave.session import ensure_small_batches, ensure_utc, ship_package


def _ready(spark: SparkSession) -> None:
    ensure_utc(spark)
    ensure_small_batches(spark)
    ship_package(spark)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts are scored as empty ones; repeated rows are scored alike; without labels of good
    quality all stay; an empty table stays empty; columns of any other name stay as they are."""
    _ready(spark)
    return good_documents(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies.

    Texts without words stay (rows equal in every column once); of others equal in id and text one stays; a null id counts as the least; an empty
    table stays empty; columns of any other name stay as they are."""
    _ready(spark)
    return one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; a document is its id and text, so other texts of one id (or none) stay, and
    repeated rows stay or go together; an empty table stays empty; columns of any other name stay."""
    _ready(spark)
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents made of the words that the mix takes of each.

    Texts without words have nothing to take and go; a null source is a source; rows equal in id and text are
    interchangeable; an empty table stays empty; columns of any other name stay as they are."""
    _ready(spark)
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Written token ids, by document.

    Null and empty texts have the end id alone; null ids come first, repeated rows stay; an empty table gives no
    row; other columns are left out."""
    _ready(spark)
    return read_boundaries(write_token_ids(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed_sources),
    ("token-ID / binary output", token_ids),
]

#: Model scores, embedded windows and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each result written and read again; odd rows and tables as
    the stages say."""
    _ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-stage-{k + 1}")
    return docs

"""Query registry: ``name -> (spark builder, DuckDB oracle SQL or None)``.

Each builder takes ``(spark, sf_dir)``, reads the driver tables under
``sf_dir`` (directly or through the fixtures derived from them) and returns
a lazy DataFrame.  Oracle SQL runs on DuckDB over the same Parquet tables.
Computed columns carry the same alias on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweave.session import ensure_utc, ship_package

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a builder (and its oracle SQL, when SQL can express it)."""

    def wrap(fn: Builder) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return run

    return wrap


def load_all() -> None:
    """Import every query module so their decorators register."""
    from logweave.plans import (  # noqa: F401
        q_core,
        q_parse,
        q_search,
        q_threat,
        q_anomaly,
        q_sources,
        q_stream,
    )

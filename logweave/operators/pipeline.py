"""The whole batch build as one operator."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from logweave import schemas
from logweave.config import DEFAULT
from logweave.operators import ann, embed
from logweave.operators.prepare import prepare_dataset, prepare_log_entries
from logweave.sources import csv, lines, parquet, tables
from logweave.sources.versioned import Steps, TableSet, inputs_key


def run_pipeline(spark: SparkSession, raw_path: str, structured_path: str, templates_path: str, root: str,
                 limit: int | None = None, dim: int = DEFAULT.embedding_dim, n_cells: int = 16) -> DataFrame:
    """Preparation (of the first ``limit`` lines), load, embedding, vector index, ledger, under ``root``.

    The tables ``log_entries``, ``event_templates``, ``message_embeddings`` and the folder ``vector_index`` are
    committed together at the end (``TableSet(spark, root)`` reads them): a failure in any step leaves the former
    ones readable, and a rerun on unchanged inputs repeats only the steps that weren't done.
    Gives the run's ledger row; a failure is recorded as FAILED and raised again."""
    started = datetime.now(timezone.utc).replace(tzinfo=None)
    ledger = f"{root}/pipeline_runs"
    try:
        key = inputs_key(spark, [raw_path, structured_path, templates_path], limit=limit, dim=dim, n_cells=n_cells)
        steps = Steps(spark, f"{root}/steps", key)

        def prepare(folder: str) -> dict:
            raw = lines.read_numbered_lines(spark, raw_path)
            structured = csv.read_structured_csv(spark, structured_path)
            entries = prepare_log_entries(raw, structured, limit=limit)
            counts = prepare_dataset(entries, csv.read_templates_csv(spark, templates_path), f"{folder}/log_entries_parquet",
                                     f"{folder}/log_entries_csv", f"{folder}/event_templates_csv").first().asDict()
            return {"folder": folder, "counts": counts}

        def load(folder: str) -> dict:
            stored = parquet.read_log_entries(spark, f"{prepared['folder']}/log_entries_parquet")
            templates = csv.read_templates_csv(spark, templates_path)
            n_templates = tables.load_table(tables.conform(templates, schemas.EVENT_TEMPLATES), f"{folder}/event_templates")
            n_logs = tables.load_table(tables.conform(stored, schemas.LOG_ENTRIES), f"{folder}/log_entries")
            return {"folder": folder, "counts": {"event_templates": n_templates, "log_entries": n_logs}}

        def vectors(folder: str) -> dict:
            _, new = embed.embed_incremental(spark.read.parquet(f"{loaded['folder']}/log_entries"), None, dim=dim)
            n = tables.load_table(tables.conform(new, schemas.MESSAGE_EMBEDDINGS), f"{folder}/message_embeddings")
            return {"folder": folder, "counts": {"embedded": n}}

        def index(folder: str) -> dict:
            ann.build(spark.read.parquet(f"{embedded['folder']}/message_embeddings"), f"{folder}/vector_index", n_cells=n_cells)
            return {"folder": folder, "counts": {}}

        prepared = steps.step("prepare", prepare)
        loaded = steps.step("load", load)
        embedded = steps.step("embed", vectors)
        indexed = steps.step("index", index)
        TableSet(spark, root).commit({
            "event_templates": [f"{loaded['folder']}/event_templates"],
            "log_entries": [f"{loaded['folder']}/log_entries"],
            "message_embeddings": [f"{embedded['folder']}/message_embeddings"],
            "vector_index": [f"{indexed['folder']}/vector_index"],
        })
        counts = prepared["counts"] | loaded["counts"] | embedded["counts"] | indexed["counts"]
    except Exception as error:
        tables.record_run(spark, ledger, "run-pipeline", "FAILED", {"error": str(error).splitlines()[0]}, started)
        raise
    return tables.record_run(spark, ledger, "run-pipeline", "SUCCESS", counts, started).select("command", "status", "details")

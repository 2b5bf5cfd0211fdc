"""Source/sink round trips, loads, upsert, ledger and the whole batch build."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave import fixtures as fx
from logweave import schemas
from logweave.functions.vector import text_to_vector, vector_to_text
from logweave.operators import prepare as pr
from logweave.operators.pipeline import run_pipeline
from logweave.plans import sqlparts as sp
from logweave.plans.q_core import LOG_COLS, lines, logs, prepared, structured, vecs
from logweave.plans.registry import query
from logweave.session import scratch_path
from logweave.sources import csv as cs
from logweave.sources import lines as ln
from logweave.sources import parquet as pq
from logweave.sources import tables as tb
from logweave.sources.versioned import TableSet

W = sp.sql_with


@query("src_numbered_lines", W("SELECT line_id, raw_line FROM f_lines", "f_lines"))
def q_numbered(spark, d):
    """Lines written as text in line order, read back and numbered 1..n."""
    path = ln.write_lines(lines(spark, d), scratch_path(spark, "raw_log"))
    return ln.read_numbered_lines(spark, path)


@query("src_structured", W("SELECT line_id, raw_message, event_id, event_template FROM f_struct", "f_struct"))
def q_structured(spark, d):
    """The structured CSV (LineId, Content, EventId, EventTemplate) round trip."""
    path = cs.write_structured_csv(structured(spark, d), scratch_path(spark, "structured_csv"))
    return cs.read_structured_csv(spark, path)


@query("src_templates", W("SELECT event_id, event_template, occurrences FROM f_templ", "f_templ"))
def q_templates(spark, d):
    """S3: the template CSV round trip."""
    path = cs.write_templates_csv(fx.fixture(spark, d, "f_templ"), scratch_path(spark, "templates_csv"))
    return cs.read_templates_csv(spark, path)


@query("prepare_from_files", W(f"SELECT {LOG_COLS} FROM prepared", "prepared"))
def q_prepare_files(spark, d):
    """S1 + S2 + J1..N5: the preparation reading its real inputs (text + CSV)."""
    raw = ln.read_numbered_lines(spark, ln.write_lines(lines(spark, d), scratch_path(spark, "raw_log")))
    st = cs.read_structured_csv(spark, cs.write_structured_csv(structured(spark, d),
                                                               scratch_path(spark, "structured_csv")))
    return pr.prepare_log_entries(raw, st)


@query("sink_parquet_roundtrip", W(f"SELECT {LOG_COLS} FROM prepared", "prepared"))
def q_sink_parquet(spark, d):
    """Written once, partitioned by level, read back."""
    path = pq.write_log_entries(prepared(spark, d), scratch_path(spark, "log_entries"))
    return pq.read_log_entries(spark, path).select(*pr.LOG_COLUMNS)


@query("stored_level_filter", W("SELECT line_id, level FROM prepared WHERE level = 'CRITICAL'", "prepared"))
def q_stored_level(spark, d):
    """F1 on the stored table: the level predicate prunes partition folders."""
    path = pq.write_log_entries(prepared(spark, d), scratch_path(spark, "log_entries"))
    return pq.read_log_entries(spark, path).filter(F.col("level") == "CRITICAL").select("line_id", "level")


@query("sink_csv_roundtrip", W(f"SELECT {LOG_COLS} FROM prepared", "prepared"))
def q_sink_csv(spark, d):
    """CSV with header (many part files), read back with the pinned schema."""
    path = cs.write_csv(prepared(spark, d), scratch_path(spark, "log_entries_csv"))
    return cs.read_csv(spark, path, schemas.LOG_ENTRIES)


@query("load_reset_append", W("""
SELECT 'event_templates' AS table_name, count(*) AS n_rows FROM f_templ
UNION ALL SELECT 'log_entries', 2 * count(*) FROM prepared""", "f_templ", "prepared"))
def q_load(spark, d):
    """Reset load of both tables, then an append of the entries (rows double)."""
    root = scratch_path(spark, "tables")
    entries = prepared(spark, d)
    tb.load_processed(spark, entries, fx.fixture(spark, d, "f_templ"), root, reset=True)
    tb.load_table(tb.conform(entries, schemas.LOG_ENTRIES), f"{root}/log_entries", reset=False)
    t = spark.read.parquet(f"{root}/event_templates").agg(F.count(F.lit(1)).alias("n_rows"))
    e = spark.read.parquet(f"{root}/log_entries").agg(F.count(F.lit(1)).alias("n_rows"))
    return t.select(F.lit("event_templates").alias("table_name"), "n_rows").unionByName(
        e.select(F.lit("log_entries").alias("table_name"), "n_rows"))


@query("load_versioned", W("""
SELECT 1 AS version, 'event_templates' AS table_name, count(*) AS n_rows FROM f_templ
UNION ALL SELECT 1, 'log_entries', count(*) FROM prepared
UNION ALL SELECT 2, 'event_templates', 2 * count(*) FROM f_templ
UNION ALL SELECT 2, 'log_entries', 2 * count(*) FROM prepared""", "f_templ", "prepared"))
def q_load_versioned(spark, d):
    """S7 by commits: a reset load and an append; the rows of both versions."""
    tables = TableSet(spark, scratch_path(spark, "versioned"))
    entries, templates = prepared(spark, d), fx.fixture(spark, d, "f_templ")
    for reset in (True, False):
        tb.load_versioned(tables, entries, templates, reset)
    parts = [tables.read(name, v).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(v).alias("version"), F.lit(name).alias("table_name"), "n_rows")
             for v in (1, 2) for name in ("event_templates", "log_entries")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("prepare_summary", W("""
SELECT (SELECT count(*) FROM prepared) AS log_rows, (SELECT count(*) FROM f_templ) AS template_rows""",
                            "prepared", "f_templ"))
def q_prepare_summary(spark, d):
    """Parquet + CSV exports written once; counts observed during the writes."""
    root = scratch_path(spark, "processed")
    return pr.prepare_dataset(prepared(spark, d), fx.fixture(spark, d, "f_templ"),
                              f"{root}/log_entries_parquet", f"{root}/log_entries_csv",
                              f"{root}/event_templates_csv")


@query("vector_text_roundtrip", W("""
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n_dims, true AS roundtrip_ok FROM f_vecs""", "f_vecs"))
def q_vector_text(spark, d):
    """Vectors to '[x,...]' text (10 decimals) and back, within 1e-9."""
    v = vecs(spark, d).select("vec_id", "embedding", vector_to_text(F.col("embedding")).alias("txt"))
    back = v.withColumn("back", text_to_vector(F.col("txt")))
    err = F.array_max(F.zip_with("embedding", "back", lambda a, b: F.abs(a.cast("double") - b)))
    return back.select("vec_id", F.size("embedding").alias("n_dims"), (err < 1e-9).alias("roundtrip_ok"))


@query("doc_upsert", W("""
SELECT l.id, CASE WHEN l.id % 2 = 0 THEN 'reindexed' ELSE l.source END AS source, l.level,
 (SELECT count(*) FROM f_logs i JOIN f_vecs w ON w.normalized_message = i.normalized_message WHERE i.id % 2 = 0) AS indexed,
 (SELECT count(*) FROM f_logs i LEFT JOIN f_vecs w ON w.normalized_message = i.normalized_message
  WHERE i.id % 2 = 0 AND w.embedding IS NULL) AS errors
FROM f_logs l JOIN f_vecs v ON v.normalized_message = l.normalized_message""", "f_logs", "f_vecs"))
def q_doc_upsert(spark, d):
    """Index every log row with its vector, twice each, then upsert the even ids with a new source;
    the rows of the index, and the counts of the second call."""
    docs = logs(spark, d).join(vecs(spark, d).select("normalized_message", "embedding"),
                               "normalized_message", "left").withColumn("version", F.lit(1))
    older = docs.withColumn("version", F.lit(0)).withColumn("source", F.lit("outdated"))
    path = scratch_path(spark, "doc_index")
    tb.upsert_index(spark, path, older.unionByName(docs), "id", dim=64, order_by="version", buckets=16)
    refreshed = docs.filter("id % 2 = 0").withColumn("source", F.lit("reindexed"))
    index2, counts = tb.upsert_index(spark, path, refreshed, "id", dim=64, order_by="version", buckets=16)
    return index2.select("id", "source", "level", counts.select("indexed").scalar().alias("indexed"),
                         counts.select("errors").scalar().alias("errors"))


@query("schemas_empty", """
SELECT * FROM (VALUES ('event_templates', 0::BIGINT, 3), ('log_entries', 0::BIGINT, 14),
 ('message_embeddings', 0::BIGINT, 6), ('pipeline_runs', 0::BIGINT, 6)) t(table_name, n_rows, n_columns)
WHERE (SELECT count(*) FROM events) > 0""")
def q_schemas_empty(spark, d):
    """Every table made anew over one with rows: empty, with its columns."""
    root = scratch_path(spark, "schemas")
    tb.load_processed(spark, prepared(spark, d), fx.fixture(spark, d, "f_templ"), root, reset=True)
    rows = []
    for name, path in schemas.create_empty_tables(spark, root).items():
        table = spark.read.parquet(path)
        rows.append((name, table.count(), len(table.columns)))
    return spark.createDataFrame(rows, "table_name string, n_rows long, n_columns int")


@query("index_stats", W("""
SELECT true AS exists, count(*) AS doc_count, true AS has_bytes
FROM f_logs l JOIN f_vecs v ON v.normalized_message = l.normalized_message""", "f_logs", "f_vecs"))
def q_index_stats(spark, d):
    """Existence, document count and stored bytes of a written index."""
    path = scratch_path(spark, "doc_index")
    docs = logs(spark, d).join(vecs(spark, d).select("normalized_message", "embedding"), "normalized_message")
    docs.write.mode("overwrite").parquet(path)
    return tb.index_stats(spark, path).select("exists", "doc_count", (F.col("store_size_bytes") > 0).alias("has_bytes"))


@query("run_ledger", W("""
SELECT 'prepare-data' AS command, 'SUCCESS' AS status, '{"log_rows": ' || count(*) || '}' AS details FROM prepared
UNION ALL SELECT 'embed', 'FAILED', '{"error": "encoder unavailable"}'""", "prepared"))
def q_run_ledger(spark, d):
    """SUCCESS and FAILED runs appended to the ledger table."""
    path = scratch_path(spark, "pipeline_runs")
    n = prepared(spark, d).count()
    tb.record_run(spark, path, "prepare-data", "SUCCESS", {"log_rows": n})
    return tb.record_run(spark, path, "embed", "FAILED", {"error": "encoder unavailable"}).select(
        "command", "status", "details")


def _pipeline(spark, d, limit=None):
    src, root = scratch_path(spark, "inputs"), scratch_path(spark, "batch_build")
    raw = ln.write_lines(lines(spark, d), f"{src}/raw")
    cs.write_structured_csv(structured(spark, d), f"{src}/structured")
    cs.write_templates_csv(fx.fixture(spark, d, "f_templ"), f"{src}/templates")
    return run_pipeline(spark, raw, f"{src}/structured", f"{src}/templates", root, limit=limit)


def _pipeline_sql(where=""):
    return W(f"""
SELECT 'run-pipeline' AS command, 'SUCCESS' AS status, '{{"embedded": ' || count(DISTINCT normalized_message)
 || ', "event_templates": ' || t.n || ', "log_entries": ' || count(*) || ', "log_rows": ' || count(*)
 || ', "template_rows": ' || t.n || '}}' AS details
FROM prepared, (SELECT count(*) AS n FROM f_templ) t {where} GROUP BY t.n""", "prepared", "f_templ")


@query("run_batch_build", _pipeline_sql())
def q_run_batch_build(spark, d):
    """S14 from text and CSV files to tables, vectors, index and ledger; the ledger row of the run."""
    return _pipeline(spark, d)


@query("run_batch_build_limit", _pipeline_sql("WHERE line_id <= 100"))
def q_run_batch_build_limit(spark, d):
    """S14 with the line limit."""
    return _pipeline(spark, d, limit=100)

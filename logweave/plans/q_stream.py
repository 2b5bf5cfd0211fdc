"""Streaming queries (file sources in the shared folder, availableNow runs)
and the approximate-search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.operators import ann
from logweave.operators import search as se
from logweave.plans import sqlparts as sp
from logweave.plans.q_core import lines, logs, prepared, vecs
from logweave.plans.q_anomaly import SEVERITY_SQL, STORED_SQL, stored_model
from logweave.plans.q_search import COS, QV, query_vec
from logweave.plans.registry import query
from logweave.session import scratch_path, written
from logweave.streaming import jobs as st

W = sp.sql_with


def _stage_parquet(spark, df, name):
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return path


def _parquet_stream(spark, path, max_files=None):
    """A stream of the files of a folder, all that are new or ``max_files`` of them in each batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


@query("stream_ingest", W(f"""
SELECT source, {sp.dispatch_sql('source')}
FROM (SELECT *, {sp.AUTO_SOURCE} AS source FROM parsed_lines) t""", "parsed_lines"))
def q_stream_ingest(spark, d):
    """ST1: text files arriving in a folder, parsed by format detection."""
    src = scratch_path(spark, "incoming_logs")
    lines(spark, d).select("raw_line").write.mode("overwrite").text(src)
    out, ckpt = scratch_path(spark, "ingested"), scratch_path(spark, "ckpt_ingest")
    st.ingest_lines(spark, src, out, ckpt)
    return spark.read.parquet(out).select("source", "log_timestamp", "level", "host", "process", "pid", "message")


TIMELINE_SQL = """
SELECT CAST(date_trunc('hour', log_timestamp) AS TIMESTAMP) AS bucket, count(*) AS count
FROM f_logs WHERE log_timestamp IS NOT NULL GROUP BY 1"""


@query("stream_timeline", W(TIMELINE_SQL, "f_logs"))
def q_stream_timeline(spark, d):
    """ST2 (changed windows of each batch): equals the batch hourly timeline."""
    path = _stage_parquet(spark, logs(spark, d), "stream_logs")
    out, ckpt = scratch_path(spark, "timeline"), scratch_path(spark, "ckpt_timeline")
    st.timeline(_parquet_stream(spark, path), out, ckpt, complete=True)
    return st.current_counts(spark, out)


@query("stream_timeline_append", W(f"""
SELECT * FROM ({TIMELINE_SQL}) t
WHERE bucket + INTERVAL 1 HOUR <= (SELECT max(log_timestamp) FROM f_logs) - INTERVAL 1 HOUR""", "f_logs"))
def q_stream_timeline_append(spark, d):
    """ST2 (append mode, 1 h watermark): only windows closed by the watermark."""
    path = _stage_parquet(spark, logs(spark, d), "stream_logs")
    out, ckpt = scratch_path(spark, "timeline_append"), scratch_path(spark, "ckpt_timeline_append")
    # all files in one batch: rows are not late relative to each other, so the
    # result is deterministic (later batches would drop rows behind the watermark)
    st.timeline(_parquet_stream(spark, path), out, ckpt, complete=False)
    return spark.read.parquet(out)


@query("stream_errors_24h", W("""
SELECT w AS window_start, count(*) AS count FROM (
 SELECT unnest(generate_series(date_trunc('hour', log_timestamp) - INTERVAL 23 HOUR,
                               date_trunc('hour', log_timestamp), INTERVAL 1 HOUR)) AS w
 FROM f_logs WHERE level = 'ERROR' AND log_timestamp IS NOT NULL) t GROUP BY w""", "f_logs"))
def q_stream_errors(spark, d):
    """ST3: trailing-24 h ERROR counts, one sliding window per hour."""
    path = _stage_parquet(spark, logs(spark, d), "stream_logs")
    out, ckpt = scratch_path(spark, "errors_24h"), scratch_path(spark, "ckpt_errors_24h")
    st.errors_sliding(_parquet_stream(spark, path), out, ckpt)
    return st.trailing_counts(spark, out)


@query("stream_embed", W("""
SELECT normalized_message, min(event_id) AS representative_event_id, min(level) AS representative_level,
 count(*) AS occurrences, true AS embedded FROM prepared GROUP BY normalized_message""", "prepared"))
def q_stream_embed(spark, d):
    """ST4: continuous embedding; every distinct message ends embedded once, with all its occurrences."""
    path = _stage_parquet(spark, prepared(spark, d), "stream_entries")
    table, ckpt = scratch_path(spark, "stream_embeddings"), scratch_path(spark, "ckpt_embed")
    st.embed_stream(_parquet_stream(spark, path, max_files=2), table, ckpt)
    return st.stored_embeddings(spark, table).select(
        "normalized_message", "representative_event_id", "representative_level", "occurrences",
        (F.size("embedding") == 384).alias("embedded"))


@query("stream_alerts", W(f"""
SELECT 'Anomalous log detected — ' || upper(severity) AS title, severity, normalized_message AS message,
 severity IN ('high', 'critical') AS dispatched,
 CASE WHEN severity IN ('high', 'critical') THEN NULL ELSE 'below threshold' END AS reason
FROM (SELECT normalized_message, {SEVERITY_SQL} AS severity FROM {STORED_SQL}) t""", "f_vecs"))
def q_stream_alerts(spark, d):
    """ST5: micro-batches of vectors scored by a stored forest -> gated alerts."""
    path = _stage_parquet(spark, vecs(spark, d).select("normalized_message", "embedding"), "stream_vectors")
    out, ckpt = scratch_path(spark, "alerts"), scratch_path(spark, "ckpt_alerts")
    st.alerts_stream(_parquet_stream(spark, path, max_files=2), stored_model(spark), out, ckpt)
    return spark.read.parquet(out).select("title", "severity", "message", "dispatched", "reason")


# -- approximate search ---------------------------------------------------------------

def _index(spark, d, n_cells=16):
    """A built index, opened again from its path."""
    return ann.open_index(spark, ann.build(vecs(spark, d), scratch_path(spark, "ann_index"), n_cells=n_cells).path)


@query("ann_build", W("SELECT count(*) AS n_vectors, true AS within_cells FROM f_vecs WHERE embedding IS NOT NULL", "f_vecs"))
def q_ann_build(spark, d):
    """K7: vectors in the cells of a written index, none of them outside its centroids."""
    idx = _index(spark, d)
    cells = spark.read.parquet(idx.cells)
    return cells.agg(F.count(F.lit(1)).alias("n_vectors"), F.max(F.col("cell")) .alias("last")).select(
        "n_vectors", (F.col("last") < len(idx.centroids)).alias("within_cells"))


@query("ann_search", W(f"""
WITH {QV} SELECT normalized_message, round({COS}, 6) AS similarity FROM f_vecs, qv WHERE embedding IS NOT NULL
ORDER BY round(1 - {COS}, 9) NULLS LAST, normalized_message LIMIT 20""", "f_vecs"))
def q_ann_search(spark, d):
    """K8: top-20 for the query vector from an opened index, all cells probed: equals the exact search."""
    idx = _index(spark, d)
    return ann.search(spark, idx, query_vec(spark, d), k=20, nprobe=16).select(
        "normalized_message", F.round("similarity", 6).alias("similarity"))


@query("ann_recall", "SELECT nprobe, true AS in_range FROM (VALUES (1), (4), (8), (16)) t(nprobe) WHERE (SELECT count(*) FROM embeddings) > 0")
def q_ann_recall(spark, d):
    """Recall@20 of K8 against exact K1 matches, per probe count: between 0 and 1, and 1 with all cells."""
    idx = _index(spark, d)
    q = query_vec(spark, d)
    exact = se.nearest_messages(vecs(spark, d), q, 20)
    rows = []
    for p in (1, 4, 8, 16):
        recall = float(ann.recall_at_k(ann.search(spark, idx, q, 20, p), exact, "normalized_message"))
        rows.append((p, recall == 1.0 if p == 16 else 0.0 <= recall <= 1.0))
    return spark.createDataFrame(rows, "nprobe int, in_range boolean")


def _many(spark, d, n_cells=16):
    """A compressed index over all vectors by id, the queries (ids divisible by 20) and their exact 20 nearest."""
    vectors = vecs(spark, d).select("vec_id", "embedding")
    idx = ann.build(vectors, scratch_path(spark, "ann_many"), n_cells=n_cells, key="vec_id")
    ann.compress(spark, idx)
    asked = vectors.filter(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id")
    return idx, asked, se.semantic_search_batch(vectors, asked, k=20)


@query("ann_recall_many")
def q_ann_recall_many(spark, d):
    """K8: recall@20 by probe count of the compressed index, over all queries against all rows."""
    idx, asked, exact = _many(spark, d)
    exact = written(exact, "ann-exact")
    out = None
    for p in (1, 4, 8, 12, 16):
        row = ann.recall_many(ann.search_many(spark, idx, asked, k=20, nprobe=p), exact, "vec_id").withColumn("nprobe", F.lit(p))
        out = row if out is None else out.unionByName(row)
    return out


@query("ann_search_many", """
WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0),
pairs AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 9) AS sim
  FROM q CROSS JOIN embeddings WHERE embedding IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank, vec_id, round(sim, 6) AS similarity FROM r WHERE rank <= 5""")
def q_ann_search_many(spark, d):
    """K8: the 5 nearest of each query from codes in all cells, 40 of them for each re-ranked exactly."""
    idx, asked, _ = _many(spark, d)
    return ann.search_many(spark, idx, asked, k=5, nprobe=16, rerank=40)

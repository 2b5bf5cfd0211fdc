"""Core queries: preparation, parsing of the storage path, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave import fixtures as fx
from logweave.functions import text as tx
from logweave.operators import analytics as an
from logweave.operators import prepare as pr
from logweave.operators import rollups as ru
from logweave.plans import sqlparts as sp
from logweave.plans.registry import ORACLE, query
from logweave.session import scratch_path
from logweave.sources.versioned import TableSet

W = sp.sql_with
PREFIX = sp.PREFIX


def lines(spark, d):
    """Raw lines as stored input (materialised once per application)."""
    return fx.staged(spark, d, "f_lines")


def structured(spark, d):
    """Structured rows as stored input (materialised once per application)."""
    return fx.staged(spark, d, "f_struct")


def prepared(spark, d, limit=None):
    return pr.prepare_log_entries(lines(spark, d), structured(spark, d), limit=limit)


def logs(spark, d):
    """The search-side log_entries table (stored input, materialised once)."""
    return fx.staged(spark, d, "f_logs")


def search_logs(spark, d):
    """The same rows in a store clustered by message, for searches (written once per application)."""
    return fx.search_store(spark, d)


def vecs(spark, d):
    """The message_embeddings table (stored input, materialised once)."""
    return fx.staged(spark, d, "f_vecs")


LOG_COLS = ", ".join(pr.LOG_COLUMNS)


@query("prepare_log_entries", W(f"SELECT {LOG_COLS} FROM prepared", "prepared"))
def q_prepare(spark, d):
    return prepared(spark, d)


@query("frequent_errors", W("""
SELECT event_id, coalesce(event_template, normalized_message) AS template, level, count(*) AS count
FROM prepared WHERE level IN ('ERROR', 'CRITICAL', 'WARNING')
GROUP BY 1, 2, 3 ORDER BY count DESC, event_id, template, level LIMIT 15""", "prepared"))
def q_frequent_errors(spark, d):
    return an.frequent_errors(prepared(spark, d))


@query("frequent_errors_1000", W("""
SELECT event_id, coalesce(event_template, normalized_message) AS template, level, count(*) AS count
FROM f_logs WHERE level IN ('ERROR', 'CRITICAL', 'WARNING')
GROUP BY 1, 2, 3 ORDER BY count DESC, event_id, template, level LIMIT 1000""", "f_logs"))
def q_frequent_errors_1000(spark, d):
    return an.frequent_errors(logs(spark, d), limit=1000)


@query("frequent_errors_info", W("""
SELECT event_id, coalesce(event_template, normalized_message) AS template, level, count(*) AS count
FROM prepared WHERE level = 'INFO'
GROUP BY 1, 2, 3 ORDER BY count DESC, event_id, template, level LIMIT 15""", "prepared"))
def q_frequent_errors_info(spark, d):
    return an.frequent_errors(prepared(spark, d), level="INFO")


@query("limit_lines", W(f"SELECT {LOG_COLS} FROM prepared WHERE line_id <= 5000", "prepared"))
def q_limit_lines(spark, d):
    return prepared(spark, d, limit=5000)


@query("parse_openssh_prefix", W(f"""
SELECT line_id, {sp.grp('raw_line', PREFIX, 1)} AS month,
 try_cast({sp.grp('raw_line', PREFIX, 2)} AS INTEGER) AS day,
 {sp.grp('raw_line', PREFIX, 3)} AS time_text, {sp.grp('raw_line', PREFIX, 4)} AS host,
 trim({sp.grp('raw_line', PREFIX, 5)}) AS service,
 try_cast({sp.grp('raw_line', PREFIX, 6)} AS INTEGER) AS process_id,
 {sp.grp('raw_line', PREFIX, 7)} AS content
FROM f_lines""", "f_lines"))
def q_parse_prefix(spark, d):
    return pr.parse_prefix(lines(spark, d)).drop("log_timestamp")


@query("log_timestamp", W(f"""
SELECT line_id, {sp.ts_from_parts('2024', sp.month_num(sp.grp('raw_line', PREFIX, 1)),
    f"try_cast({sp.grp('raw_line', PREFIX, 2)} AS INTEGER)", sp.grp('raw_line', PREFIX, 3))} AS log_timestamp
FROM f_lines""", "f_lines"))
def q_log_timestamp(spark, d):
    return pr.parse_prefix(lines(spark, d)).select("line_id", "log_timestamp")


@query("join_raw_structured", W("""
SELECT l.line_id, l.raw_line, s.raw_message, s.event_id, s.event_template
FROM f_lines l LEFT JOIN f_struct s ON l.line_id = s.line_id""", "f_lines", "f_struct"))
def q_join(spark, d):
    return lines(spark, d).select("line_id", "raw_line").join(structured(spark, d), "line_id", "left")


@query("raw_message_fallback", W("SELECT line_id, raw_message FROM prepared", "prepared"))
def q_fallback(spark, d):
    return prepared(spark, d).select("line_id", "raw_message")


@query("classify_level", W(f"SELECT line_id, {sp.classify('raw_message')} AS level FROM f_lines", "f_lines"))
def q_classify(spark, d):
    return lines(spark, d).select("line_id", tx.classify_level(F.col("raw_message")).alias("level"))


@query("normalize_storage", W(f"""
SELECT line_id, {sp.norm_storage('event_template', 'raw_message')} AS normalized_message
FROM f_struct""", "f_struct"))
def q_norm_storage(spark, d):
    s = structured(spark, d)
    return s.select("line_id", tx.normalize_storage(F.col("event_template"), F.col("raw_message"))
                    .alias("normalized_message"))


@query("normalize_message", f"""
SELECT doc_id, {sp.norm_message('text')} AS normalized FROM documents""")
def q_norm_message(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", tx.normalize_message(F.col("text")).alias("normalized"))


@query("filter_level", W("""
SELECT id, line_id, level, event_id FROM f_logs WHERE level = 'ERROR'""", "f_logs"))
def q_filter_level(spark, d):
    return an.filter_level(logs(spark, d), "ERROR").select("id", "line_id", "level", "event_id")


@query("timeline_day", W("""
SELECT CAST(date_trunc('day', log_timestamp) AS TIMESTAMP) AS bucket, count(*) AS count
FROM f_logs WHERE log_timestamp IS NOT NULL GROUP BY 1 ORDER BY 1""", "f_logs"))
def q_timeline_day(spark, d):
    return an.timeline(logs(spark, d), "day")


@query("timeline_hour", W("""
SELECT CAST(date_trunc('hour', log_timestamp) AS TIMESTAMP) AS bucket, count(*) AS count
FROM f_logs WHERE log_timestamp IS NOT NULL GROUP BY 1 ORDER BY 1""", "f_logs"))
def q_timeline_hour(spark, d):
    return an.timeline(logs(spark, d), "hour")


@query("timeline_event", W("""
SELECT CAST(date_trunc('day', log_timestamp) AS TIMESTAMP) AS bucket, count(*) AS count
FROM f_logs WHERE log_timestamp IS NOT NULL AND event_id = 'E1' AND level = 'ERROR'
GROUP BY 1 ORDER BY 1""", "f_logs"))
def q_timeline_event(spark, d):
    return an.timeline(logs(spark, d), "day", event_id="E1", level="ERROR")


@query("level_distribution", W("""
SELECT level, count(*) AS count FROM f_logs GROUP BY level ORDER BY count DESC, level""", "f_logs"))
def q_levels(spark, d):
    return an.level_distribution(logs(spark, d))


@query("volume_hour_level", W("""
SELECT CAST(date_trunc('hour', log_timestamp) AS TIMESTAMP) AS time, level, count(*) AS count
FROM f_logs WHERE log_timestamp IS NOT NULL GROUP BY 1, 2 ORDER BY 1, 2""", "f_logs"))
def q_volume(spark, d):
    return an.volume_hour_level(logs(spark, d))


@query("volume_hour_level_pivot", W("""
SELECT CAST(date_trunc('hour', log_timestamp) AS TIMESTAMP) AS time,
 count(*) FILTER (WHERE level = 'CRITICAL') AS CRITICAL, count(*) FILTER (WHERE level = 'ERROR') AS ERROR,
 count(*) FILTER (WHERE level = 'WARNING') AS WARNING, count(*) FILTER (WHERE level = 'INFO') AS INFO
FROM f_logs WHERE log_timestamp IS NOT NULL GROUP BY 1""", "f_logs"))
def q_volume_pivot(spark, d):
    return an.volume_hour_level(logs(spark, d), pivot=True)


@query("top_error_templates", W("""
SELECT event_template, count(*) AS occurrences FROM f_logs WHERE level = 'ERROR'
GROUP BY event_template ORDER BY occurrences DESC, event_template LIMIT 20""", "f_logs"))
def q_top_error_templates(spark, d):
    return an.top_error_templates(logs(spark, d))


@query("top_error_templates_prepared", W("""
SELECT event_template, count(*) AS occurrences FROM prepared WHERE level = 'ERROR'
GROUP BY event_template ORDER BY occurrences DESC, event_template LIMIT 20""", "prepared"))
def q_top_error_templates_prepared(spark, d):
    return an.top_error_templates(prepared(spark, d))


@query("errors_last_24h", W("""
SELECT count(*) AS count FROM f_logs
WHERE level = 'ERROR' AND log_timestamp > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOURS""", "f_logs"))
def q_errors_24h(spark, d):
    return an.errors_last_24h(logs(spark, d), ref_ts="2024-01-20 00:00:00")


@query("panel_totals", W("""
SELECT (SELECT count(*) FROM f_logs) AS total_logs, (SELECT count(*) FROM f_vecs) AS distinct_patterns""",
                         "f_logs", "f_vecs"))
def q_panel_totals(spark, d):
    return an.panel_totals(logs(spark, d), vecs(spark, d))


@query("distinct_messages", W("""
SELECT normalized_message, min(event_id) AS representative_event_id, min(level) AS representative_level,
 count(*) AS occurrences FROM prepared GROUP BY normalized_message
ORDER BY occurrences DESC, normalized_message""", "prepared"))
def q_distinct_messages(spark, d):
    return an.distinct_messages(prepared(spark, d))


@query("embedded_logs", W("""
SELECT count(*) AS embedded_logs FROM f_logs
WHERE normalized_message IN (SELECT normalized_message FROM f_vecs)""", "f_logs", "f_vecs"))
def q_embedded_logs(spark, d):
    return an.embedded_log_count(logs(spark, d), vecs(spark, d))


@query("stats_overview", W(f"""
WITH lv AS (SELECT level, count(*) AS c FROM f_logs GROUP BY level)
SELECT count(*) AS total_logs,
 (SELECT count(*) FROM f_logs WHERE normalized_message IN (SELECT normalized_message FROM f_vecs)) AS embedded_logs,
 (SELECT count(*) FROM f_vecs) AS embedded_messages,
 count(DISTINCT event_id) AS event_count,
 {sp.iso_text('min(log_timestamp)')} AS first_log, {sp.iso_text('max(log_timestamp)')} AS last_log,
 (SELECT string_agg(level || '=' || c, ',' ORDER BY c DESC, level) FROM lv) AS levels
FROM f_logs""", "f_logs", "f_vecs"))
def q_stats(spark, d):
    return an.stats_overview(logs(spark, d), vecs(spark, d))


def rollup(spark, d):
    """Counts of the log rows in three batches, the second replayed, the first two merged (written once per application)."""
    def build():
        tables = TableSet(spark, scratch_path(spark, "rollup"))
        for batch in (0, 1, 1, 2):
            ru.add_batch(tables, batch, logs(spark, d).filter(F.col("id") % 3 == batch))
        ru.compact(tables, 1)
        ru.add_batch(tables, 1, logs(spark, d).filter("id % 3 = 1"))
        return ru.read_counts(tables)

    return fx.once(spark, d, "rollup", build)


@query("rollup_stats", ORACLE["stats_overview"])
def q_rollup_stats(spark, d):
    """A1 from stored counts."""
    return ru.stats_overview(rollup(spark, d), vecs(spark, d))


@query("rollup_frequent_errors", ORACLE["frequent_errors_1000"])
def q_rollup_errors(spark, d):
    """A2 from stored counts."""
    return ru.frequent_errors(rollup(spark, d), limit=1000)


@query("rollup_timeline", ORACLE["timeline_hour"])
def q_rollup_timeline(spark, d):
    """A3 from stored counts."""
    return ru.timeline(rollup(spark, d), "hour")


@query("rollup_volume", ORACLE["volume_hour_level"])
def q_rollup_volume(spark, d):
    """A5 from stored counts."""
    return ru.volume_hour_level(rollup(spark, d))

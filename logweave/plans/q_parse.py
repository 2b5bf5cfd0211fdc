"""Multi-source parsing queries (P2-P11) over the F-LINES fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave import fixtures as fx
from logweave.functions import parse as P
from logweave.plans import sqlparts as sp
from logweave.plans.registry import query

W = sp.sql_with
COMMON = ["log_timestamp", "level", "host", "process", "pid", "message"]


def lines(spark, d):
    return fx.staged(spark, d, "f_lines")


def _fields(parsed, names):
    return [parsed[n].alias(n) for n in names]


def _only(spark, d, source, extra=()):
    return _rows(spark, d, source).select("line_id", *COMMON, *extra)


def _rows(spark, d, source):
    return P.parse_source(lines(spark, d).select("line_id", "raw_line"), source, out="p").select("line_id", "p.*")


def _sel(prefix, extra=""):
    cols = {
        "ssh": "ssh_ts AS log_timestamp, ssh_level AS level, ssh_host AS host, ssh_process AS process, "
               "ssh_pid AS pid, ssh_message AS message",
        "sys": "sys_ts AS log_timestamp, sys_level AS level, sys_host AS host, sys_process AS process, "
               "sys_pid AS pid, sys_message AS message",
        "win": "win_ts AS log_timestamp, win_level AS level, CAST(NULL AS VARCHAR) AS host, "
               "win_process AS process, CAST(NULL AS INTEGER) AS pid, win_message AS message",
    }[prefix]
    return f"SELECT line_id, {cols}{extra} FROM parsed_lines WHERE {prefix}_ok"


@query("parse_openssh", W(_sel("ssh"), "parsed_lines"))
def q_parse_openssh(spark, d):
    return _only(spark, d, "openssh")


@query("ssh_auth_failure", W("""
SELECT line_id, fail_method AS method, fail_user AS "user", fail_ip AS ip
FROM parsed_lines WHERE ssh_ok AND fail_ip IS NOT NULL""", "parsed_lines"))
def q_auth_failure(spark, d):
    df = _rows(spark, d, "openssh").filter(F.col("auth_failure").isNotNull())
    return df.select("line_id", "auth_failure.method", "auth_failure.user", "auth_failure.ip")


@query("ssh_auth_success", W("""
SELECT line_id, ok_method AS method, ok_user AS "user", ok_ip AS ip
FROM parsed_lines WHERE ssh_ok AND ok_ip IS NOT NULL""", "parsed_lines"))
def q_auth_success(spark, d):
    df = _rows(spark, d, "openssh").filter(F.col("auth_success").isNotNull())
    return df.select("line_id", "auth_success.method", "auth_success.user", "auth_success.ip")


@query("ssh_disconnect", W("""
SELECT line_id, disconnect_ip AS ip FROM parsed_lines WHERE ssh_ok AND disconnect_ip IS NOT NULL""",
                           "parsed_lines"))
def q_disconnect(spark, d):
    df = _rows(spark, d, "openssh").filter(F.col("disconnect_ip").isNotNull())
    return df.select("line_id", F.col("disconnect_ip").alias("ip"))


@query("parse_syslog", W(_sel("sys"), "parsed_lines"))
def q_parse_syslog(spark, d):
    return _only(spark, d, "syslog")


@query("syslog_facility", W("""
SELECT line_id, facility, severity, msgid FROM parsed_lines WHERE sys_ok""", "parsed_lines"))
def q_syslog_facility(spark, d):
    return _rows(spark, d, "syslog").select("line_id", "facility", "severity", "msgid")


@query("parse_windows_event", W(_sel("win", ", win_event_id AS event_id"), "parsed_lines"))
def q_parse_windows(spark, d):
    return _only(spark, d, "windows_event", extra=("event_id",))


@query("parse_generic", W("""
SELECT line_id, gen_ts AS log_timestamp, gen_level AS level, CAST(NULL AS VARCHAR) AS host,
 CAST(NULL AS VARCHAR) AS process, CAST(NULL AS INTEGER) AS pid, gen_message AS message
FROM parsed_lines""", "parsed_lines"))
def q_parse_generic(spark, d):
    df = lines(spark, d).select("line_id", P.parse_generic(F.col("raw_line")).alias("p"))
    return df.select("line_id", "p.*").select("line_id", *COMMON)


@query("parse_auto", W(f"""
SELECT line_id, source, {sp.dispatch_sql('source')}
FROM (SELECT *, {sp.AUTO_SOURCE} AS source FROM parsed_lines) t""", "parsed_lines"))
def q_parse_auto(spark, d):
    df = P.parse_lines(lines(spark, d).select("line_id", "raw_line"), "raw_line", out="p")
    return df.select("line_id", "p.*").select("line_id", "source", *COMMON)


@query("parse_hint", W(f"""
SELECT line_id, source, {sp.dispatch_sql('source')}
FROM (SELECT *, CASE WHEN sys_ok THEN 'syslog' ELSE 'generic' END AS source FROM parsed_lines) t""",
                       "parsed_lines"))
def q_parse_hint(spark, d):
    df = P.parse_lines(lines(spark, d).select("line_id", "raw_line"), "raw_line", source_hint="syslog", out="p")
    return df.select("line_id", "p.*").select("line_id", "source", *COMMON)

"""Literal cases for the multi-source parsers, among them the ones where engines differ: Unicode classes,
line ends inside a line, incomplete time stamps."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logweave.functions import parse as P

REFUSED = "Nov  3 21:40:07 gate-7 sshd[511]: Failed keyboard-interactive for invalid user oracle from 198.51.100.77 port 40100 ssh2"
LET_IN = "Nov 13 01:02:03 gate-7 sshd[99]: Accepted publickey for mira from 10.20.30.40 port 50022 ssh2"
QUEUE = "<165>1 2023-02-28T23:59:58.250-05:30 mx2 postfix 77 QID9 - queue is full"
AUDIT = "2023-12-31T23:59:59 Warning Kernel-Power 41 rebooted without a clean stop"


def run(spark, expr, line):
    return spark.createDataFrame([(line,)], "v string").select(expr(F.col("v")).alias("p")).first()["p"]


def test_openssh_refused_and_let_in(spark):
    p = run(spark, P.parse_openssh, REFUSED)
    assert (p.source, p.level, p.host, p.process, p.pid) == ("openssh", "ERROR", "gate-7", "sshd", 511)
    assert p.log_timestamp == dt.datetime(2024, 11, 3, 21, 40, 7)
    assert tuple(p.auth_failure) == ("keyboard-interactive", "oracle", "198.51.100.77") and p.auth_success is None
    q = run(spark, P.parse_openssh, LET_IN)
    assert q.level == "INFO" and tuple(q.auth_success) == ("publickey", "mira", "10.20.30.40")


def test_openssh_without_pid_and_other_lines(spark):
    p = run(spark, P.parse_openssh, "nov 3 21:40:07 gate-7 cron: Received disconnect from 203.0.113.9: 14: gone")
    assert p.pid is None and p.disconnect_ip == "203.0.113.9" and p.log_timestamp.month == 11
    for line in ("", "Nov 3 gate-7 sshd[1]: no time", QUEUE, AUDIT):
        assert run(spark, P.parse_openssh, line) is None


@pytest.mark.parametrize("line", [
    "Nov 3 21:40:07 gate-7 s\u00e9rv[5]: started",  # a process with a letter outside ASCII
    "Nov\u00a03 21:40:07 gate-7\u2003sshd[5]: started",  # no-break space and em space between fields
    "Nov 3 21:40:07 gate-7 sshd[5]: one\rtwo",  # carriage return and next line are not line ends
    "Nov 3 21:40:07 gate-7 sshd[5]: one\u0085two",
])
def test_openssh_unicode(spark, line):
    p = run(spark, P.parse_openssh, line)
    assert p is not None and p.pid == 5
    assert p.message == line.split(": ", 1)[1]


def test_message_ends_at_a_line_feed(spark):
    assert run(spark, P.parse_openssh, "Nov 3 21:40:07 gate-7 sshd[5]: one\ntwo") is None


def test_syslog(spark):
    p = run(spark, P.parse_syslog, QUEUE)
    assert (p.facility, p.severity, p.level, p.msgid) == (20, 5, "NOTICE", "QID9")
    assert (p.host, p.process, p.pid, p.message) == ("mx2", "postfix", 77, "queue is full")
    assert p.log_timestamp == dt.datetime(2023, 3, 1, 5, 29, 58, 250000)
    assert run(spark, P.parse_syslog, "<165>1 2023-02-28T23:59:58Z mx2 postfix id-7 - - text\rmore").pid is None
    assert run(spark, P.parse_syslog, LET_IN) is None


@pytest.mark.parametrize(("stamp", "expected"), [
    ("10:15:00", None), ("T10:15", None), ("2024", None), ("2024-06", None), ("-", None), ("2024-13-01T00:00:00", None), ("2024-02-30", None), ("2024-01-01T25:00", None),
    ("20240615T100000", dt.datetime(2024, 6, 15, 10)), ("20240615T1000+0200", dt.datetime(2024, 6, 15, 8)), ("2024-06-15", dt.datetime(2024, 6, 15)),
    ("2024-06-15T10", dt.datetime(2024, 6, 15, 10)), ("2024-06-15T10:00:00.5Z", dt.datetime(2024, 6, 15, 10, 0, 0, 500000)),
    ("2024-06-15T00:30:00+01:00", dt.datetime(2024, 6, 14, 23, 30)), ("2024-06-15T10:00:60", None),
])
def test_syslog_time_stamps(spark, stamp, expected):
    p = run(spark, P.parse_syslog, f"<13>1 {stamp} h a - - - m")
    assert p is not None and p.log_timestamp == expected


def test_windows(spark):
    p = run(spark, P.parse_windows_event, AUDIT)
    assert (p.level, p.process, p.event_id, p.log_timestamp.day) == ("WARNING", "Kernel-Power", 41, 31)
    assert run(spark, P.parse_windows_event, AUDIT.replace("a clean", "a\u0085clean")).message.endswith("a\u0085clean stop")
    assert run(spark, P.parse_windows_event, "Warning Kernel-Power 41") is None


def test_generic(spark):
    p = run(spark, P.parse_generic, "\tjob 7 | 2023-07-09 08:07:06 | crit: disk is gone ")
    assert (p.level, p.log_timestamp, p.message[0]) == ("CRIT", dt.datetime(2023, 7, 9, 8, 7, 6), "j")
    q = run(spark, P.parse_generic, "informal text")
    assert q.level == "INFO" and q.log_timestamp is None


def test_detection_and_hints(spark):
    for line, source in ((REFUSED, "openssh"), (QUEUE, "syslog"), (AUDIT, "windows_event"), ("plain", "generic"), (" " + LET_IN, "generic"), ("<165 >" + LET_IN, "generic")):
        assert run(spark, P.parse_line, line).source == source
    for hint, line, source in (("syslog", LET_IN, "generic"), ("syslog", QUEUE, "syslog"), ("openssh", "  " + LET_IN, "openssh"), ("generic", QUEUE, "syslog")):
        assert run(spark, lambda c, h=hint: P.parse_line(c, source_hint=h), line).source == source


@pytest.mark.parametrize("hint", [None, "openssh", "syslog", "windows_event", "generic"])
def test_table_form_equals_expression_form(spark, hint):
    lines = [REFUSED, LET_IN, QUEUE, AUDIT, "plain", "", None, "  " + LET_IN, "\x1f" + LET_IN, LET_IN + " a\x1fb\x1f", "Nov 3 21:40:07 h sérv: a\rb", "$1 \\ " + AUDIT, QUEUE + " $2 \\1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, raw_line string")
    table = {r.i: r.parsed for r in P.parse_lines(df, source_hint=hint).collect()}
    single = {r.i: r.p for r in df.select("i", P.parse_line("raw_line", hint).alias("p")).collect()}
    assert table == single


@pytest.mark.parametrize(("source", "parser"), [("openssh", P.parse_openssh), ("syslog", P.parse_syslog), ("windows_event", P.parse_windows_event)])
def test_rows_of_one_parser(spark, source, parser):
    """Same rows as the parser's expression, with no pattern evaluated a field at a time."""
    stamps = ("2024-06-15T10:00:00.5Z", "20240615T1000+0200", "2024-06-15", "2024-13-01T00:00:00", "-", "10:15:00", "2024-06-15T00:30:00+01:00", "2024-01-01T00:00:00+25:00")
    lines = [REFUSED, LET_IN, QUEUE, AUDIT, "plain", "", None, "  " + LET_IN, "\x1f" + QUEUE, QUEUE + " a\x1fb\x1f", "$1 \\ " + AUDIT, QUEUE + " $2 \\1", *(f"<13>1 {t} h a 7 - - m" for t in stamps)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, raw_line string")
    found = P.parse_source(df, source)
    assert found.columns == ["i", "raw_line", "parsed"]
    want = {r.i: r.p for r in df.select("i", parser("raw_line").alias("p")).collect() if r.p is not None}
    assert want and {r.i: r.parsed for r in found.collect()} == want
    plan = found.select("parsed.log_timestamp", "parsed.host", "parsed.message")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and plan.count("regexp_replace") <= 6

"""Log-line parsers as Column expressions.

Each parser returns a nullable struct: NULL when its pattern does not
match, so the auto-detect dispatcher is a plain ``coalesce`` in priority
order.  Everything stays inside Spark's regex/string functions; no row
ever leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Patterns, month names and severity names that must equal the
# reference's for identical results.  Java regex syntax (``[^\[]`` instead of
# ``[^[]``); every pattern is also valid RE2, so the DuckDB oracle uses the
# same text.
OPENSSH_PREFIX = (
    r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\[]+)\[(\d+)\]:\s+(.*)$"
)
SSH_LINE = r"^(\w+)\s+(\d+)\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\w+)(?:\[(\d+)\])?:\s+(.+)$"
SSH_FAIL = r"Failed (\S+) for (?:invalid user )?(\S+) from ([\d.]+)"
SSH_ACCEPT = r"Accepted (\S+) for (\S+) from ([\d.]+)"
SSH_DISCONNECT = r"Received disconnect from ([\d.]+)"
SSH_DETECT = r"^\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2}"
SYSLOG_LINE = (
    r"^<(\d+)>(\d)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.+)$"
)
WINDOWS_LINE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})\s+(\w+)\s+([^\s]+)\s+(\d+)\s+(.+)$"
ISO_DATETIME = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})"
LEVEL_WORD = r"(?i)\b(DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|CRIT(?:ICAL)?|ALERT|EMERG(?:ENCY)?)\b"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SYSLOG_SEVERITY = ["EMERG", "ALERT", "CRIT", "ERROR", "WARN", "NOTICE", "INFO", "DEBUG"]
SSH_ERROR_WORDS = ["Failed", "error", "Invalid", "illegal"]
# Python's str.isspace() set, so strip() behaves like the reference's parsers
PY_SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PY_SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                  + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
# ---------------------------------------------------------------------------

SOURCES = ("openssh", "syslog", "windows_event", "generic")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_SPACES = PY_SPACE[1:-1]


def unicode(pattern: str) -> str:
    """The pattern with Unicode classes (Python's white space), and ``.`` up to a line feed only."""
    spaced = pattern.replace(r"[^\s]", f"[^{_SPACES}]").replace(r"\S", f"[^{_SPACES}]").replace(r"\s", f"[{_SPACES}]")
    return "(?Ud)" + spaced


# the patterns of the multi-source parsers, as their Unicode forms
_SSH_LINE, _SSH_DETECT, _SYSLOG_LINE, _WINDOWS_LINE, _ISO_DATETIME, _LEVEL_WORD, _SSH_FAIL, _SSH_ACCEPT, _SSH_DISCONNECT = map(
    unicode, (SSH_LINE, SSH_DETECT, SYSLOG_LINE, WINDOWS_LINE, ISO_DATETIME, LEVEL_WORD, SSH_FAIL, SSH_ACCEPT, SSH_DISCONNECT))


def group(line: Column, pattern: str, idx: int) -> Column:
    """Regex group, NULL instead of '' when absent (Spark returns '')."""
    return F.nullif(F.regexp_extract(line, pattern, idx), F.lit(""))


def month_number(month: Column, case_insensitive: bool = False) -> Column:
    keys = [m.upper() for m in MONTHS] if case_insensitive else MONTHS
    lookup = F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(k), F.lit(i + 1))])
    return lookup[F.upper(month) if case_insensitive else month]


def py_strip(line: Column) -> Column:
    """Python's ``str.strip()``: trim the whitespace character set natively."""
    return F.btrim(line, F.lit(PY_SPACE_CHARS))


def ntz_from_parts(year, month, day, hms: Column) -> Column:
    """timestamp_ntz from parts, NULL for impossible dates (Feb 30, 25:00, :60)."""
    hh = F.substring(hms, 1, 2).try_cast("int")
    mi = F.substring(hms, 4, 2).try_cast("int")
    ss = F.substring(hms, 7, 2).try_cast("int")
    ts = F.try_make_timestamp_ntz(
        F.lit(year) if isinstance(year, int) else year, month, day, hh, mi, ss.cast("decimal(8,6)")
    )
    return F.when(ss < 60, ts)


def iso_to_ntz(text: Column) -> Column:
    """'YYYY-MM-DD[T ]HH:MM:SS' -> timestamp_ntz (NULL when not a real instant)."""
    return ntz_from_parts(
        F.substring(text, 1, 4).try_cast("int"),
        F.substring(text, 6, 2).try_cast("int"),
        F.substring(text, 9, 2).try_cast("int"),
        F.substring(text, 12, 8),
    )


ISO_SHAPE = (
    r"^(\d{4}-\d{2}-\d{2}|\d{8})(?:[^0-9](\d{2})(?:(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)|(?:(\d{2})(?:(\d{2})(?:[.,](\d+))?)?))?"
    r"(?:([+-])(\d{2})(?::?(\d{2})(?::?(\d{2}))?)?)?)?$"
)


def instant_groups(text: Column) -> Column:
    """Array of the groups of an ISO text (from place 1 on) by one evaluation of the shape; NULL for other shapes
    and texts with a mark.  Stage it as a column of its own, and give that to ``iso_instant``."""
    marks = F.regexp_replace(text, ISO_SHAPE, "".join(f"{_MARK}${i}" for i in range(1, 13)))
    return F.when(~F.contains(text, F.lit(_MARK)) & marks.startswith(_MARK), F.split(marks, _MARK, 13))


def iso_instant(text: Column, groups: Column | None = None) -> Column:
    """ISO date or date and time, extended or basic, with or without an offset -> timestamp_ntz in UTC;
    NULL for other shapes (a time or a year alone) and for instants that don't exist.  ``groups``: the staged
    ``instant_groups`` of the text."""

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(text, ISO_SHAPE, i) if groups is None else F.get(groups, F.lit(i)), F.lit(""))

    def number(c: Column) -> Column:
        return F.coalesce(c.try_cast("int"), F.lit(0))

    date = F.replace(part(1), F.lit("-"), F.lit(""))
    year, month, day = (F.substring(date, a, n).try_cast("int") for a, n in ((1, 4), (5, 2), (7, 2)))
    hour, minute = number(part(2)), number(F.coalesce(part(3), part(6)))
    second = number(F.coalesce(part(4), part(7)))
    micros = number(F.rpad(F.substring(F.coalesce(part(5), part(8), F.lit("0")), 1, 6), 6, "0"))
    seconds = (second.cast("decimal(16,6)") + micros / F.lit(1_000_000)).cast("decimal(8,6)")
    local = F.try_make_timestamp_ntz(year, month, day, hour, minute, F.when(second < 60, seconds))
    ahead = number(part(10)) * 3600 + number(part(11)) * 60 + number(part(12))
    ahead = F.when(part(9) == "-", -ahead).otherwise(ahead)
    valid = (text.rlike(ISO_SHAPE) if groups is None else groups.isNotNull()) & (number(part(10)) < 24) & (number(part(11)) < 60)
    return F.when(valid, local - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ahead.cast("decimal(18,6)")))


# -- P1 + P12 + P13: OpenSSH prefix (main storage path) ----------------------

# the end of a line as ``$`` sees it, taken into the match
_PREFIX_ALL = OPENSSH_PREFIX[:-1] + r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?\z"


def prefix_groups(line: Column | str) -> Column:
    """Array of the prefix groups (from place 1 on) by one evaluation of the pattern; NULL on no match.
    Stage it as a column of its own, and give that to ``openssh_prefix``."""
    line = _col(line)
    marks = F.regexp_replace(line, _PREFIX_ALL, "".join(f"{_MARK}${i}" for i in range(1, 8)))
    one = F.when(marks.startswith(_MARK) & ~line.startswith(_MARK), F.split(marks, _MARK, 8))
    # a mark in the line itself: group by group
    each = F.when(line.rlike(OPENSSH_PREFIX), F.array(F.lit(""), *[F.regexp_extract(line, OPENSSH_PREFIX, i) for i in range(1, 8)]))
    return F.when(F.contains(line, F.lit(_MARK)), each).otherwise(one)


def openssh_prefix(line: Column | str, year: int = 2024, groups: Column | None = None) -> Column:
    """Struct of the 7 prefix fields and the timestamp; NULL fields on no match.  ``groups``: the staged
    ``prefix_groups`` of the line."""
    groups = prefix_groups(line) if groups is None else groups
    field = lambda i: F.nullif(F.get(groups, F.lit(i)), F.lit(""))
    month, time_text = field(1), field(3)
    day = field(2).try_cast("int")
    return F.struct(
        month.alias("month"),
        day.alias("day"),
        time_text.alias("time_text"),
        field(4).alias("host"),
        F.trim(field(5)).alias("service"),
        field(6).try_cast("int").alias("process_id"),
        # '' is a line with empty content; NULL a line that doesn't match
        F.get(groups, F.lit(7)).alias("content"),
        ntz_from_parts(year, month_number(month), day, time_text).alias("log_timestamp"),
    )


# -- P2-P11: multi-source parsers --------------------------------------------

_AUTH = "struct<method:string,user:string,ip:string>"


def _auth(msg: Column, pattern: str) -> Column:
    return F.when(
        msg.rlike(pattern),
        F.struct(
            F.regexp_extract(msg, pattern, 1).alias("method"),
            F.regexp_extract(msg, pattern, 2).alias("user"),
            F.regexp_extract(msg, pattern, 3).alias("ip"),
        ),
    )


def auth_failure(msg: Column) -> Column:
    return _auth(msg, _SSH_FAIL)


def auth_success(msg: Column) -> Column:
    return _auth(msg, _SSH_ACCEPT)


def disconnect_ip(msg: Column) -> Column:
    return F.when(msg.rlike(_SSH_DISCONNECT), F.regexp_extract(msg, _SSH_DISCONNECT, 1))


FIELDS = [
    ("source", "string"), ("log_timestamp", "timestamp_ntz"), ("level", "string"),
    ("host", "string"), ("process", "string"), ("pid", "int"), ("message", "string"),
    ("raw", "string"), ("auth_failure", _AUTH), ("auth_success", _AUTH),
    ("disconnect_ip", "string"), ("facility", "long"), ("severity", "int"),
    ("msgid", "string"), ("event_id", "long"),
]


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[
        (fields[n] if n in fields else F.lit(None)).cast(t).alias(n) for n, t in FIELDS
    ])


#: Stands between the groups of a match; a stripped line can't begin with it, and no group but the
#: last can hold it.
_MARK = "\x1f"


def marked(line: Column, pattern: str, groups: int) -> Column:
    """The line with its match replaced by all groups, each after a mark: one evaluation of the pattern.
    A line that doesn't match stays as it is."""
    return F.regexp_replace(py_strip(line), pattern, "".join(f"{_MARK}${i}" for i in range(1, groups + 1)))


def groups_of(mark: Column, groups: int) -> Column:
    """Array of the groups of a ``marked`` line from place 1 on; NULL if it didn't match."""
    return F.when(mark.startswith(_MARK), F.split(mark, _MARK, groups + 1))


def _access(raw: Column, pattern: str, parts: Column | None):
    """(whether it matches, i-th group): from the staged groups, or by evaluating the pattern."""
    if parts is not None:
        return parts.isNotNull(), lambda i: F.get(parts, F.lit(i))
    s = py_strip(raw)
    return s.rlike(pattern), lambda i: F.regexp_extract(s, pattern, i)


def _ssh(raw: Column, year: int, parts: Column | None = None) -> tuple[Column, dict[str, Column]]:
    ok, g = _access(raw, _SSH_LINE, parts)
    msg = g(7)
    day_text = g(2)
    # strptime('%d') accepts 1-31 with an optional leading zero only
    day = F.when(day_text.rlike(r"^(3[01]|[12][0-9]|0?[1-9])$"), day_text.try_cast("int"))
    ts = ntz_from_parts(year, month_number(g(1), True), day, g(3))
    is_error = msg.contains(SSH_ERROR_WORDS[0])
    for w in SSH_ERROR_WORDS[1:]:
        is_error = is_error | msg.contains(w)
    return ok, {
        "source": F.lit("openssh"), "log_timestamp": ts,
        "level": F.when(is_error, F.lit("ERROR")).otherwise(F.lit("INFO")),
        "host": g(4), "process": g(5),
        "pid": F.nullif(g(6), F.lit("")).try_cast("int"), "message": msg, "raw": raw,
        "auth_failure": auth_failure(msg), "auth_success": auth_success(msg),
        "disconnect_ip": disconnect_ip(msg),
    }


def _syslog_time(g) -> Column:
    return F.replace(g(3), F.lit("Z"), F.lit("+00:00"))


def _syslog(raw: Column, parts: Column | None = None, instant: Column | None = None) -> tuple[Column, dict[str, Column]]:
    ok, g = _access(raw, _SYSLOG_LINE, parts)
    # groups: 1 pri, 2 version, 3 ts, 4 host, 5 app, 6 procid, 7 msgid, 8 sd, 9 msg
    pri = g(1).try_cast("long")
    sev = (pri % 8).cast("int")
    procid = g(6)
    return ok, {
        "source": F.lit("syslog"),
        "log_timestamp": iso_instant(_syslog_time(g), instant),
        "level": F.coalesce(F.array(*[F.lit(x) for x in SYSLOG_SEVERITY])[sev], F.lit("INFO")),
        "host": g(4), "process": g(5),
        "pid": F.when(procid.rlike("^[0-9]+$"), procid.try_cast("int")),
        "message": g(9), "raw": raw,
        "facility": F.shiftright(pri, 3), "severity": sev,
        "msgid": g(7),
    }


def _windows(raw: Column, parts: Column | None = None) -> tuple[Column, dict[str, Column]]:
    ok, g = _access(raw, _WINDOWS_LINE, parts)
    return ok, {
        "source": F.lit("windows_event"),
        "log_timestamp": iso_to_ntz(g(1)),
        "level": F.upper(g(2)),
        "process": g(3),
        "message": g(5), "raw": raw,
        "event_id": g(4).try_cast("long"),
    }


def _generic(raw: Column) -> dict[str, Column]:
    level = F.upper(F.nullif(F.regexp_extract(raw, _LEVEL_WORD, 1), F.lit("")))
    return {
        "source": F.lit("generic"),
        "log_timestamp": iso_to_ntz(F.regexp_extract(raw, _ISO_DATETIME, 1)),
        "level": F.coalesce(level, F.lit("INFO")),
        "message": py_strip(raw), "raw": raw,
    }


def parse_openssh(line: Column | str, year: int = 2024) -> Column:
    ok, fields = _ssh(_col(line), year)
    return F.when(ok, _struct(fields))


def parse_syslog(line: Column | str) -> Column:
    ok, fields = _syslog(_col(line))
    return F.when(ok, _struct(fields))


def parse_windows_event(line: Column | str) -> Column:
    ok, fields = _windows(_col(line))
    return F.when(ok, _struct(fields))


def parse_generic(line: Column | str) -> Column:
    return _struct(_generic(_col(line)))


def detect_source(line: Column | str, source_hint: str | None = None, year: int = 2024,
                  staged: dict[str, Column] | None = None) -> Column:
    """Name of the parser that wins for each line.

    Auto-detection tests run on the unstripped line, in the reference's
    order: syslog (starts with '<', '>' within 6 chars), OpenSSH (month-day-
    time prefix), Windows export, generic.  A hint of 'generic' (or None)
    means auto-detect, as in the reference.
    """
    raw = _col(line)
    at = staged or {}
    ssh_ok = _ssh(raw, year, at.get("openssh"))[0]
    sys_ok = _syslog(raw, at.get("syslog"))[0]
    win_ok = _windows(raw, at.get("windows_event"))[0]
    forced = {"openssh": ssh_ok, "syslog": sys_ok, "windows_event": win_ok}
    if source_hint in forced:
        return F.when(forced[source_hint], F.lit(source_hint)).otherwise(F.lit("generic"))
    looks_syslog = raw.startswith("<") & F.substring(raw, 1, 6).contains(">")
    looks_ssh = raw.rlike(_SSH_DETECT)
    return (
        F.when(looks_syslog & sys_ok, F.lit("syslog"))
        .when(looks_ssh & ssh_ok, F.lit("openssh"))
        .when(win_ok, F.lit("windows_event"))
        .otherwise(F.lit("generic"))
    )


def parse_line(line: Column | str, source_hint: str | None = None, year: int = 2024,
               source: Column | None = None, staged: dict[str, Column] | None = None) -> Column:
    """One struct per line from the winning parser.

    Each field is a CASE over the detected source, so every parser's field
    expression appears once (linear generated code, common sub-expressions
    shared).  Pass a precomputed ``source`` column to avoid re-detection.
    """
    raw = _col(line)
    src = source if source is not None else detect_source(raw, source_hint, year, staged)
    at = staged or {}
    per_source = {
        "openssh": _ssh(raw, year, at.get("openssh"))[1],
        "syslog": _syslog(raw, at.get("syslog"), at.get("instant"))[1],
        "windows_event": _windows(raw, at.get("windows_event"))[1],
    }
    generic = _generic(raw)
    fields = {}
    for name, _ in FIELDS:
        expr = None
        for sname, fdict in per_source.items():
            if name in fdict:
                expr = (F.when(src == sname, fdict[name]) if expr is None
                        else expr.when(src == sname, fdict[name]))
        if name in generic:
            expr = generic[name] if expr is None else expr.otherwise(generic[name])
        fields[name] = expr if expr is not None else F.lit(None)
    fields["source"] = src
    return _struct(fields)


#: pattern and number of groups of each parser that a line can fail
_PARTS = {"openssh": (_SSH_LINE, 7), "syslog": (_SYSLOG_LINE, 9), "windows_event": (_WINDOWS_LINE, 5)}


def _staged_parts(df, line_col: str, sources):
    """``df`` with a column of the groups of each parser's match, and one of the groups of a syslog line's time:
    every pattern is evaluated once a line, and what reads the groups reads plain columns."""
    steps = df.withColumns({f"_{n}": marked(F.col(line_col), *_PARTS[n]) for n in sources})
    steps = steps.withColumns({f"_{n}": groups_of(F.col(f"_{n}"), _PARTS[n][1]) for n in sources})
    if "syslog" in sources:
        steps = steps.withColumn("_instant", instant_groups(_syslog_time(lambda i: F.get("_syslog", F.lit(i)))))
    return steps


def parse_source(df, source: str, line_col: str = "raw_line", year: int = 2024, out: str = "parsed"):
    """The rows of ``df`` that the parser of ``source`` (openssh, syslog or windows_event) matches, with its struct."""
    steps = _staged_parts(df, line_col, [source]).filter(F.col(f"_{source}").isNotNull())
    raw, parts = F.col(line_col), F.col(f"_{source}")
    if source == "syslog":
        _, fields = _syslog(raw, parts, F.col("_instant"))
    else:
        _, fields = _ssh(raw, year, parts) if source == "openssh" else _windows(raw, parts)
    return steps.withColumn(out, _struct(fields)).drop(f"_{source}", "_instant")


def parse_lines(df, line_col: str = "raw_line", source_hint: str | None = None, year: int = 2024,
                out: str = "parsed"):
    """DataFrame form of ``parse_line``: each parser's pattern is evaluated once a line, its groups and
    then the detected source are projected first, and every field reads plain columns (Catalyst keeps
    the projections apart because their columns are read by many fields)."""
    raw = F.col(line_col)
    patterns = [source_hint] if source_hint in _PARTS else list(_PARTS)
    steps = _staged_parts(df, line_col, patterns)
    never = F.lit(None).cast("array<string>")
    staged = {n: F.col(f"_{n}") if n in patterns else never for n in _PARTS} | {"instant": F.col("_instant") if "syslog" in patterns else never}
    steps = steps.withColumn("_source", detect_source(raw, source_hint, year, staged))
    parsed = steps.withColumn(out, parse_line(raw, source_hint, year, source=F.col("_source"), staged=staged))
    return parsed.drop("_source", "_instant", *[f"_{n}" for n in patterns])

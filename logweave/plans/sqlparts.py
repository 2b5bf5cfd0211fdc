"""DuckDB (oracle-side) SQL fragments mirroring the Spark column expressions.

Only used to build the independent oracle text; the Spark side never runs
these strings.
"""

from __future__ import annotations

from logweave import fixtures
from logweave.plans import oracle_values as V


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def grp(col: str, pattern: str, idx: int) -> str:
    return f"nullif(regexp_extract({col}, {lit(pattern)}, {idx}), '')"


def rx(col: str, pattern: str, idx: int) -> str:
    return f"regexp_extract({col}, {lit(pattern)}, {idx})"


def month_num(col: str, case_insensitive: bool = False) -> str:
    keys = [m.upper() for m in V.MONTHS] if case_insensitive else V.MONTHS
    subject = f"upper({col})" if case_insensitive else col
    whens = " ".join(f"WHEN {lit(k)} THEN {i + 1}" for i, k in enumerate(keys))
    return f"(CASE {subject} {whens} END)"


def ts_from_parts(year: str, month: str, day: str, hms: str) -> str:
    return (
        f"(CASE WHEN try_cast(substr({hms}, 7, 2) AS INTEGER) < 60 THEN "
        f"try_strptime(concat({year}, '-', {month}, '-', {day}, ' ', {hms}), '%Y-%m-%d %H:%M:%S') END)"
    )


def iso_to_ts(text: str) -> str:
    return ts_from_parts(
        f"try_cast(substr({text}, 1, 4) AS INTEGER)",
        f"try_cast(substr({text}, 6, 2) AS INTEGER)",
        f"try_cast(substr({text}, 9, 2) AS INTEGER)",
        f"substr({text}, 12, 8)",
    )


def any_contains(col: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(m)})" for m in markers) + ")"


def classify(col: str) -> str:
    low = f"lower({col})"
    return (
        f"(CASE WHEN {any_contains(low, V.CRITICAL_MARKERS)} THEN 'CRITICAL' "
        f"WHEN {any_contains(low, V.ERROR_MARKERS)} THEN 'ERROR' "
        f"WHEN {any_contains(low, V.WARNING_MARKERS)} THEN 'WARNING' ELSE 'INFO' END)"
    )


def norm_storage(tpl: str, msg: str) -> str:
    return f"lower(regexp_replace(coalesce({tpl}, {msg}), '\\s+', ' ', 'g'))"


def norm_message(col: str) -> str:
    return f"coalesce(lower(trim(regexp_replace({col}, {lit(V.PY_SPACE + '+')}, ' ', 'g'))), '')"


def py_strip(col: str) -> str:
    return f"regexp_replace({col}, {lit('^' + V.PY_SPACE + '+|' + V.PY_SPACE + '+$')}, '', 'g')"


def iso_text(col: str) -> str:
    return f"regexp_replace(strftime({col}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '')"


PREFIX = V.OPENSSH_PREFIX

PREPARED = f"""
SELECT line_id, 'OpenSSH' AS source,
 {ts_from_parts('2024', month_num('month'), 'day', 'time_text')} AS log_timestamp,
 month, day, time_text, host, service, process_id,
 {classify('raw_message')} AS level, event_id, raw_message,
 {norm_storage('event_template', 'raw_message')} AS normalized_message, event_template
FROM (
 SELECT l.line_id, s.event_id, s.event_template,
  coalesce(s.raw_message, CASE WHEN regexp_matches(l.raw_line, {lit(PREFIX)}) THEN {rx('l.raw_line', PREFIX, 7)} END, l.raw_line) AS raw_message,
  {grp('l.raw_line', PREFIX, 1)} AS month,
  try_cast({grp('l.raw_line', PREFIX, 2)} AS INTEGER) AS day,
  {grp('l.raw_line', PREFIX, 3)} AS time_text,
  {grp('l.raw_line', PREFIX, 4)} AS host,
  trim({grp('l.raw_line', PREFIX, 5)}) AS service,
  try_cast({grp('l.raw_line', PREFIX, 6)} AS INTEGER) AS process_id
 FROM {{f_lines}} l LEFT JOIN {{f_struct}} s ON l.line_id = s.line_id
) x
"""

# Oracle-only derived relations: name -> (sql, inputs)
DERIVED: dict[str, tuple[str, tuple[str, ...]]] = {
    "prepared": (PREPARED, ("f_lines", "f_struct")),
}


def _deps(name: str, seen: list[str]) -> None:
    table = fixtures.FIXTURES if name in fixtures.FIXTURES else DERIVED
    for dep in table[name][1]:
        if dep in fixtures.FIXTURES or dep in DERIVED:
            _deps(dep, seen)
    if name not in seen:
        seen.append(name)


def sql_with(body: str, *names: str) -> str:
    """Prefix ``body`` with CTEs for the fixtures / derived relations it reads."""
    ordered: list[str] = []
    for name in names:
        _deps(name, ordered)
    ctes = []
    for name in ordered:
        sql, inputs = fixtures.FIXTURES[name] if name in fixtures.FIXTURES else DERIVED[name]
        ctes.append(f"{name} AS ({_bind(sql, inputs)})")
    head = body.lstrip()
    if head[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + head[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _bind(sql: str, inputs) -> str:
    """Replace ``{name}`` placeholders by the relation names (regex braces stay)."""
    for dep in inputs:
        sql = sql.replace("{" + dep + "}", dep)
    return sql


# -- multi-source parsers (oracle side) ---------------------------------------

def parsers_sql(table: str = "f_lines", year: str = "2024") -> str:
    """Every parser's fields side by side, one row per input line."""
    ssh, sysl, win = V.SSH_LINE, V.SYSLOG_LINE, V.WINDOWS_LINE
    day_ok = lit(r"^(3[01]|[12][0-9]|0?[1-9])$")
    sev_case = " ".join(f"WHEN {i} THEN {lit(n)}" for i, n in enumerate(V.SYSLOG_SEVERITY))
    err_words = " OR ".join(f"contains({rx('s', ssh, 7)}, {lit(w)})" for w in V.SSH_ERROR_WORDS)
    fail, ok, disc = V.SSH_FAIL, V.SSH_ACCEPT, V.SSH_DISCONNECT
    msg = rx("s", ssh, 7)
    return f"""
SELECT line_id, raw_line,
 regexp_matches(s, {lit(ssh)}) AS ssh_ok,
 {ts_from_parts(year, month_num(rx('s', ssh, 1), True),
   f"(CASE WHEN regexp_matches({rx('s', ssh, 2)}, {day_ok}) THEN try_cast({rx('s', ssh, 2)} AS INTEGER) END)",
   rx('s', ssh, 3))} AS ssh_ts,
 CASE WHEN {err_words} THEN 'ERROR' ELSE 'INFO' END AS ssh_level,
 {rx('s', ssh, 4)} AS ssh_host, {rx('s', ssh, 5)} AS ssh_process,
 try_cast({grp('s', ssh, 6)} AS INTEGER) AS ssh_pid, {msg} AS ssh_message,
 CASE WHEN regexp_matches({msg}, {lit(fail)}) THEN {rx(msg, fail, 1)} END AS fail_method,
 CASE WHEN regexp_matches({msg}, {lit(fail)}) THEN {rx(msg, fail, 2)} END AS fail_user,
 CASE WHEN regexp_matches({msg}, {lit(fail)}) THEN {rx(msg, fail, 3)} END AS fail_ip,
 CASE WHEN regexp_matches({msg}, {lit(ok)}) THEN {rx(msg, ok, 1)} END AS ok_method,
 CASE WHEN regexp_matches({msg}, {lit(ok)}) THEN {rx(msg, ok, 2)} END AS ok_user,
 CASE WHEN regexp_matches({msg}, {lit(ok)}) THEN {rx(msg, ok, 3)} END AS ok_ip,
 CASE WHEN regexp_matches({msg}, {lit(disc)}) THEN {rx(msg, disc, 1)} END AS disconnect_ip,
 regexp_matches(s, {lit(sysl)}) AS sys_ok,
 timezone('UTC', try_cast(replace({rx('s', sysl, 3)}, 'Z', '+00:00') AS TIMESTAMPTZ)) AS sys_ts,
 coalesce(CASE try_cast({rx('s', sysl, 1)} AS BIGINT) % 8 {sev_case} END, 'INFO') AS sys_level,
 {rx('s', sysl, 4)} AS sys_host, {rx('s', sysl, 5)} AS sys_process,
 CASE WHEN regexp_matches({rx('s', sysl, 6)}, '^[0-9]+$') THEN try_cast({rx('s', sysl, 6)} AS INTEGER) END AS sys_pid,
 {rx('s', sysl, 9)} AS sys_message,
 try_cast({rx('s', sysl, 1)} AS BIGINT) >> 3 AS facility,
 CAST(try_cast({rx('s', sysl, 1)} AS BIGINT) % 8 AS INTEGER) AS severity,
 {rx('s', sysl, 7)} AS msgid,
 regexp_matches(s, {lit(win)}) AS win_ok,
 {iso_to_ts(rx('s', win, 1))} AS win_ts,
 upper({rx('s', win, 2)}) AS win_level, {rx('s', win, 3)} AS win_process,
 {rx('s', win, 5)} AS win_message, try_cast({rx('s', win, 4)} AS BIGINT) AS win_event_id,
 {iso_to_ts(rx('raw_line', V.ISO_DATETIME, 1))} AS gen_ts,
 coalesce(upper(nullif({rx('raw_line', V.LEVEL_WORD, 1)}, '')), 'INFO') AS gen_level,
 s AS gen_message,
 starts_with(raw_line, '<') AND contains(substr(raw_line, 1, 6), '>') AS looks_syslog,
 regexp_matches(raw_line, {lit(V.SSH_DETECT)}) AS looks_ssh
FROM (SELECT line_id, raw_line, {py_strip('raw_line')} AS s FROM {table}) z
"""


def dispatch_sql(src: str) -> str:
    """Common columns chosen by the ``src`` expression (openssh/syslog/...)."""
    cols = {
        "log_timestamp": ("ssh_ts", "sys_ts", "win_ts", "gen_ts"),
        "level": ("ssh_level", "sys_level", "win_level", "gen_level"),
        "host": ("ssh_host", "sys_host", "NULL", "NULL"),
        "process": ("ssh_process", "sys_process", "win_process", "NULL"),
        "pid": ("ssh_pid", "sys_pid", "NULL", "NULL"),
        "message": ("ssh_message", "sys_message", "win_message", "gen_message"),
    }
    out = []
    for name, (a, b, c, g) in cols.items():
        out.append(
            f"CASE {src} WHEN 'openssh' THEN {a} WHEN 'syslog' THEN {b} "
            f"WHEN 'windows_event' THEN {c} ELSE {g} END AS {name}"
        )
    return ",\n ".join(out)


AUTO_SOURCE = (
    "CASE WHEN looks_syslog AND sys_ok THEN 'syslog' WHEN looks_ssh AND ssh_ok THEN 'openssh' "
    "WHEN win_ok THEN 'windows_event' ELSE 'generic' END"
)

DERIVED["parsed_lines"] = (parsers_sql("{f_lines}"), ("f_lines",))


# -- vectors (oracle side) ----------------------------------------------------

def hash_raw(text: str, dim: int = 384) -> str:
    """Un-normalised signed bucket sums (DuckDB twin of functions.vector.hash_embed)."""
    hs = (f"list_transform(list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), "
          f"lambda t: t <> ''), lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT)")
    return (f"list_transform(range(0, {dim}), lambda i: coalesce(list_sum(list_transform({hs}, "
            f"lambda h: CASE WHEN h % {dim} = i THEN (CASE WHEN (h // {dim}) % 2 = 0 THEN 1.0::DOUBLE "
            f"ELSE -1.0::DOUBLE END) ELSE 0.0::DOUBLE END)), 0.0::DOUBLE))")


def hash_embed_from(relation: str, text: str, keep: str = "*", dim: int = 384) -> str:
    """SELECT keep, embedding FROM relation — bit-identical to the Spark encoder."""
    return f"""
SELECT {keep}, list_transform(r, lambda x: (CASE WHEN n > 0 THEN x / n ELSE 0.0::DOUBLE END)::FLOAT) AS embedding
FROM (SELECT *, sqrt(coalesce(list_sum(list_transform(r, lambda x: x * x)), 0.0::DOUBLE)) AS n
      FROM (SELECT *, {hash_raw(text, dim)} AS r FROM {relation}) r0) r1"""


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity(({a})::DOUBLE[], ({b})::DOUBLE[])"


DERIVED["hash_vecs"] = (hash_embed_from("""(
SELECT normalized_message, min(event_id) AS representative_event_id, min(level) AS representative_level,
 count(*) AS occurrences FROM {prepared} GROUP BY normalized_message) g""", "normalized_message",
    "normalized_message, representative_event_id, representative_level, occurrences"), ("prepared",))


# -- IP enrichment (oracle side) ---------------------------------------------

def _nets(num: str, cidrs) -> str:
    return "(" + " OR ".join(f"({num} BETWEEN {lo} AND {hi})" for lo, hi in map(V.bounds, cidrs)) + ")"


def ip_enrich_sql(rel: str, ip: str = "ip") -> str:
    parts = [f"try_cast(string_split({ip}, '.')[{i}] AS BIGINT)" for i in (1, 2, 3, 4)]
    num = (f"CASE WHEN regexp_matches({ip}, {lit(V.STRICT_IPV4)}) AND " +
           " AND ".join(f"{p} <= 255" for p in parts) +
           f" THEN {parts[0]} * 16777216 + {parts[1]} * 65536 + {parts[2]} * 256 + {parts[3]} END")
    return f"""
SELECT * EXCLUDE (num),
 CASE WHEN NOT is_valid THEN 0.0 WHEN is_bogon AND NOT is_private THEN {V.RISK_SUSPICIOUS_BOGON}
      WHEN NOT is_private AND NOT is_bogon THEN {V.RISK_PUBLIC} ELSE 0.0 END::DOUBLE AS risk_score,
 CASE WHEN NOT is_valid THEN 'invalid' ELSE concat_ws(',',
   CASE WHEN is_private THEN 'private' END, CASE WHEN is_bogon THEN 'bogon' END,
   CASE WHEN is_loopback THEN 'loopback' END, CASE WHEN is_multicast THEN 'multicast' END,
   CASE WHEN is_bogon AND NOT is_private THEN 'suspicious-bogon' END) END AS tags,
 CASE WHEN is_valid THEN 4 END AS version
FROM (SELECT *, num IS NOT NULL AS is_valid,
  coalesce({_nets('num', V.PRIVATE_NETWORKS)} AND NOT {_nets('num', V.PRIVATE_EXCEPTIONS)}, false) AS is_private,
  coalesce({_nets('num', V.BOGON_NETWORKS)}, false) AS is_bogon,
  coalesce({_nets('num', [V.LOOPBACK_NETWORK])}, false) AS is_loopback,
  coalesce({_nets('num', [V.MULTICAST_NETWORK])}, false) AS is_multicast
 FROM (SELECT *, {num} AS num FROM {rel}) i0) i1"""

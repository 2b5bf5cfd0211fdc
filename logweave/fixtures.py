"""Test inputs derived from the driver tables (see FIXTURES.md).

Each fixture is one SQL text with ``{name}`` placeholders for its inputs.
Spark runs it through ``spark.sql(text, name=DataFrame)``; the DuckDB
oracle inlines the same text as a CTE (``oracle_with``), so both engines
start from identical rows.  The derivations are narrow (no shuffle) except
``f_templ``, which is a small group-by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

F_LINES = """
WITH b AS (
 SELECT event_id + 1 AS line_id, ts, event_type, user_id,
  concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3*month(ts)-2 AS INT), 3), ' ', day(ts), ' ',
   lpad(concat('',hour(ts)),2,'0'), ':', lpad(concat('',minute(ts)),2,'0'), ':', lpad(concat('',CAST(floor(second(ts)) AS INT)),2,'0')) AS ssh_ts,
  concat(year(ts), '-', lpad(concat('',month(ts)),2,'0'), '-', lpad(concat('',day(ts)),2,'0'), 'T',
   lpad(concat('',hour(ts)),2,'0'), ':', lpad(concat('',minute(ts)),2,'0'), ':', lpad(concat('',CAST(floor(second(ts)) AS INT)),2,'0')) AS iso_ts,
  CASE WHEN event_id % 7 = 0 THEN concat('10.0.', user_id % 256, '.', event_id % 256)
       WHEN event_id % 7 = 1 THEN concat('100.64.', user_id % 256, '.', event_id % 256)
       WHEN event_id % 7 = 2 THEN concat('203.0.113.', event_id % 256)
       WHEN event_id % 7 = 3 THEN concat('224.0.0.', event_id % 256)
       WHEN event_id % 7 = 4 THEN concat('300.1.1.', event_id % 256)
       ELSE concat(20 + user_id % 60, '.', user_id % 256, '.8.', event_id % 256) END AS ip
 FROM {events}),
m AS (
 SELECT *, CASE
   WHEN event_type = 'error' AND line_id % 3 = 0 THEN 'E1'
   WHEN event_type = 'error' AND line_id % 3 = 1 THEN 'E2'
   WHEN event_type = 'error' THEN 'E3'
   WHEN event_type = 'view' THEN 'E4'
   WHEN event_type = 'click' THEN 'E5'
   WHEN event_type = 'signup' THEN 'E6'
   ELSE 'E7' END AS eid
 FROM b),
t AS (
 SELECT *, CASE eid
   WHEN 'E1' THEN concat('Failed password for invalid user u', user_id, ' from ', ip, ' port ', 1024 + line_id % 60000, ' ssh2')
   WHEN 'E2' THEN concat('Address ', ip, ' maps to h', user_id, '.example.com, but this does not map back - POSSIBLE BREAK-IN ATTEMPT!')
   WHEN 'E3' THEN concat('Received disconnect from ', ip, ': 11:  Bye Bye [preauth]')
   WHEN 'E4' THEN concat('Connection closed by ', ip, ' [preauth]')
   WHEN 'E5' THEN concat('Accepted password for u', user_id, ' from ', ip, ' port ', 1024 + line_id % 60000, ' ssh2')
   WHEN 'E6' THEN concat('reverse mapping checking getaddrinfo for h', user_id, ' [', ip, '] failed')
   ELSE concat('session opened for user u', user_id, ' by (uid=0)') END AS msg,
  CASE eid
   WHEN 'E1' THEN 'Failed password for invalid user <*> from <*> port <*> ssh2'
   WHEN 'E2' THEN 'Address <*> maps to <*>, but this does not map back - POSSIBLE BREAK-IN ATTEMPT!'
   WHEN 'E3' THEN 'Received disconnect from <*>: 11:  Bye Bye [preauth]'
   WHEN 'E4' THEN 'Connection closed by <*> [preauth]'
   WHEN 'E5' THEN 'Accepted password for <*> from <*> port <*> ssh2'
   WHEN 'E6' THEN 'reverse mapping checking getaddrinfo for <*> [<*>] failed'
   ELSE 'session opened for user <*> by (uid=<*>)' END AS tpl
 FROM m)
SELECT line_id, eid AS event_id, msg AS raw_message, tpl AS event_template,
 CASE
  WHEN line_id % 10 = 7 THEN concat('<', line_id % 192, '>1 ', iso_ts, 'Z host', user_id % 9, ' app', user_id % 4, ' ', CASE WHEN line_id % 20 = 7 THEN '-' ELSE concat('',line_id) END, ' ID', user_id % 50, ' - ', msg)
  WHEN line_id % 10 = 8 THEN concat(iso_ts, ' ', CASE WHEN event_type='error' THEN 'Error' ELSE 'Information' END, ' Microsoft-Windows-Security-Auditing ', 4600 + user_id % 40, ' ', msg)
  WHEN line_id % 10 = 9 THEN concat(CASE WHEN line_id % 20 = 9 THEN concat(iso_ts, ' ') ELSE '' END, CASE WHEN event_type='error' THEN 'warning ' ELSE '' END, '| ', msg)
  WHEN line_id % 97 = 0 THEN concat('Xyz 99 ', msg)
  ELSE concat(ssh_ts, ' LabSZ sshd[', 20000 + user_id, ']: ', msg) END AS raw_line
FROM t
"""

F_STRUCT = """
SELECT line_id, raw_message, event_id,
 CASE WHEN line_id % 13 = 0 THEN NULL ELSE event_template END AS event_template
FROM {f_lines} WHERE line_id % 11 <> 0
"""

F_TEMPL = """
SELECT event_id, event_template, CAST(count(*) AS INT) AS occurrences
FROM {f_lines} WHERE event_id <> 'E7' GROUP BY event_id, event_template
"""

F_LOGS = """
SELECT event_id + 1 AS id, event_id + 1 AS line_id, 'OpenSSH' AS source,
 CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts END AS log_timestamp,
 CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'CRITICAL'
   WHEN 'view' THEN 'WARNING' ELSE 'INFO' END AS level,
 CASE WHEN event_id % 31 = 0 THEN NULL ELSE concat('E', event_id % 29) END AS event_id,
 concat(event_type, ' u', user_id) AS raw_message,
 concat('msg ', event_id % 600) AS normalized_message,
 CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('tpl ', event_type) END AS event_template
FROM {events}
"""

F_VECS = """
SELECT concat('msg ', vec_id) AS normalized_message, vec_id, label, embedding
FROM {embeddings}
"""

F_SCORES = """
SELECT event_id, ts, event_type, CAST((value - 40) / -100.0 AS DOUBLE) AS raw_score
FROM {events}
"""

# name -> (sql, inputs); inputs are base tables or earlier fixtures
FIXTURES: dict[str, tuple[str, tuple[str, ...]]] = {
    "f_lines": (F_LINES, ("events",)),
    "f_struct": (F_STRUCT, ("f_lines",)),
    "f_templ": (F_TEMPL, ("f_lines",)),
    "f_logs": (F_LOGS, ("events",)),
    "f_vecs": (F_VECS, ("embeddings",)),
    "f_scores": (F_SCORES, ("events",)),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a fixture DataFrame on Spark from the driver tables in ``sf_dir``."""
    sql, inputs = FIXTURES[name]
    frames = {
        dep: (fixture(spark, sf_dir, dep) if dep in FIXTURES else table(spark, sf_dir, dep))
        for dep in inputs
    }
    return spark.sql(sql, **frames)


def _deps(name: str, seen: list[str]) -> None:
    for dep in FIXTURES[name][1]:
        if dep in FIXTURES:
            _deps(dep, seen)
    if name not in seen:
        seen.append(name)


def oracle_with(body: str, *names: str) -> str:
    """Prefix DuckDB SQL ``body`` with the CTEs of the fixtures it reads."""
    ordered: list[str] = []
    for name in names:
        _deps(name, ordered)
    if not ordered:
        return body
    head = body.lstrip()
    if head[:5].upper() == "WITH ":
        body = ",\n" + head[5:]
    else:
        body = "\n" + body
    ctes = []
    for name in ordered:
        sql, inputs = FIXTURES[name]
        ctes.append(f"{name} AS ({_bind(sql, inputs)})")
    return "WITH " + ",\n".join(ctes) + body


def _bind(sql: str, inputs) -> str:
    """Replace ``{name}`` placeholders by the relation names (regex braces stay)."""
    for dep in inputs:
        sql = sql.replace("{" + dep + "}", dep)
    return sql


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


#: column by which each staged fixture is clustered, so that min/max statistics prune lookups by it
CLUSTERED = {"f_lines": "line_id", "f_struct": "line_id", "f_logs": "id", "f_vecs": "vec_id"}


def staged(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture written once per application as Parquet in the shared folder,
    clustered by its id.

    Stored tables normally arrive as scanned columns; the derivation of the
    fixtures is a large expression that would otherwise be inlined into every
    predicate.  Queries over the stored form prune columns and push filters.
    """
    from logweave.session import written

    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        df = fixture(spark, sf_dir, name)
        if name in CLUSTERED:
            # with a number: a merged result would leave too few files for the cores that scan them
            df = df.repartitionByRange(spark.sparkContext.defaultParallelism, CLUSTERED[name])
        _STAGED[key] = written(df, f"staged-{name}")
    return _STAGED[key]


def once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The frame that ``build()`` gives over stored tables, made once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        _STAGED[key] = build()
    return _STAGED[key]


def search_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged log rows as a search store, written once per application."""
    from logweave.session import scratch_path
    from logweave.sources.parquet import write_search_store

    key = (spark.sparkContext.applicationId, sf_dir, "search-store")
    if key not in _STAGED:
        path = write_search_store(staged(spark, sf_dir, "f_logs"), scratch_path(spark, "search-store"), row_group_bytes=256 << 10, page_rows=200)
        _STAGED[key] = spark.read.parquet(path)
    return _STAGED[key]

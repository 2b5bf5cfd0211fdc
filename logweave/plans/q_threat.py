"""Threat-enrichment queries: IPs in log messages and documents, domains in pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave import fixtures as fx
from logweave.functions import ip as I
from logweave.operators import networks as nw
from logweave.operators import threat as th
from logweave.plans import oracle_values as V
from logweave.plans import sqlparts as sp
from logweave.plans.q_core import lines
from logweave.plans.registry import query

W = sp.sql_with
IPS_SQL = f"(SELECT DISTINCT unnest(regexp_extract_all(raw_message, {sp.lit(V.IPV4_TOKEN)}, 1)) AS ip FROM f_lines) s"
FLAT = ["ip", "is_valid", "is_private", "is_bogon", "is_loopback", "is_multicast", "risk_score", "tags", "version"]


@query("enrich_ip", W(f"SELECT {', '.join(FLAT)} FROM ({sp.ip_enrich_sql(IPS_SQL)}) e", "f_lines"))
def q_enrich_ip(spark, d):
    ips = th.distinct_ips(lines(spark, d), "raw_message")
    return th.enrich_ips(ips).withColumn("tags", F.concat_ws(",", "tags")).select(*FLAT)


@query("ip_bogon_join", W(f"""
SELECT s.ip, n.network FROM {IPS_SQL}
JOIN (VALUES {', '.join(f"({sp.lit(c)}, {lo}, {hi})" for c, (lo, hi) in
                        ((c, V.bounds(c)) for c in V.BOGON_NETWORKS))}) n(network, lo, hi)
 ON (CASE WHEN regexp_matches(s.ip, {sp.lit(V.STRICT_IPV4)}) AND
     try_cast(string_split(s.ip, '.')[1] AS BIGINT) <= 255 AND try_cast(string_split(s.ip, '.')[2] AS BIGINT) <= 255 AND
     try_cast(string_split(s.ip, '.')[3] AS BIGINT) <= 255 AND try_cast(string_split(s.ip, '.')[4] AS BIGINT) <= 255
     THEN try_cast(string_split(s.ip, '.')[1] AS BIGINT) * 16777216 + try_cast(string_split(s.ip, '.')[2] AS BIGINT) * 65536
        + try_cast(string_split(s.ip, '.')[3] AS BIGINT) * 256 + try_cast(string_split(s.ip, '.')[4] AS BIGINT) END)
    BETWEEN n.lo AND n.hi""", "f_lines"))
def q_bogon_join(spark, d):
    return th.ip_bogon_join(th.distinct_ips(lines(spark, d), "raw_message"))


DOC_IPS = f"list_sort(list_distinct(regexp_extract_all(text, {sp.lit(V.IPV4_TOKEN)}, 1)))"


@query("threat_enrich", f"""
WITH d AS (SELECT doc_id, {DOC_IPS} AS ips FROM documents),
x AS (SELECT doc_id, unnest(ips) AS ip FROM d),
e AS ({sp.ip_enrich_sql('x')})
SELECT d.doc_id, CAST(len(d.ips) AS BIGINT) AS ip_count,
 CAST(coalesce(sum(CASE WHEN e.risk_score >= {V.HIGH_RISK} THEN 1 ELSE 0 END), 0) AS BIGINT) AS high_risk_count,
 coalesce(max(e.risk_score), 0.0)::DOUBLE AS overall_risk, array_to_string(d.ips, ',') AS ips
FROM d LEFT JOIN e ON e.doc_id = d.doc_id GROUP BY d.doc_id, d.ips""")
def q_threat_enrich(spark, d):
    docs = fx.table(spark, d, "documents")
    out = th.threat_enrich(docs, "text")
    return out.select(
        "doc_id", F.col("ip_count").cast("long").alias("ip_count"),
        F.col("high_risk_count").cast("long").alias("high_risk_count"), "overall_risk",
        F.concat_ws(",", "ips").alias("ips"),
    )


@query("threat_enrich_logs", W(f"""
WITH d AS (SELECT line_id, list_sort(list_distinct(regexp_extract_all(raw_message, {sp.lit(V.IPV4_TOKEN)}, 1))) AS ips
           FROM f_lines),
x AS (SELECT line_id, unnest(ips) AS ip FROM d),
e AS ({sp.ip_enrich_sql('x')})
SELECT d.line_id, CAST(len(d.ips) AS BIGINT) AS ip_count,
 CAST(coalesce(sum(CASE WHEN e.risk_score >= {V.HIGH_RISK} THEN 1 ELSE 0 END), 0) AS BIGINT) AS high_risk_count,
 coalesce(max(e.risk_score), 0.0)::DOUBLE AS overall_risk
FROM d LEFT JOIN e ON e.line_id = d.line_id GROUP BY d.line_id, d.ips""", "f_lines"))
def q_threat_logs(spark, d):
    out = th.threat_enrich(lines(spark, d), "raw_message")
    return out.select(
        "line_id", F.col("ip_count").cast("long").alias("ip_count"),
        F.col("high_risk_count").cast("long").alias("high_risk_count"), "overall_risk",
    )


@query("threat_indicators", f"""
WITH x AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {sp.lit(V.IPV4_TOKEN)}, 1)) AS ip FROM documents)
SELECT doc_id, ip, risk_score, tags, is_private FROM ({sp.ip_enrich_sql('x')}) e""")
def q_threat_indicators(spark, d):
    out = th.threat_indicators(fx.table(spark, d, "documents"), "doc_id")
    return out.select("doc_id", "ip", "risk_score", F.concat_ws(",", "tags").alias("tags"), "is_private")


@query("extract_domains", f"""
SELECT page_id, domain, count(*) AS occurrences
FROM (SELECT page_id, unnest(regexp_extract_all(html, {sp.lit(V.DOMAIN_TOKEN)}, 0)) AS domain FROM pages) t
GROUP BY page_id, domain""")
def q_domains(spark, d):
    return th.domains(fx.table(spark, d, "pages"), "page_id", "html")


V6_TOKENS = """
SELECT DISTINCT CASE event_id % 7
 WHEN 0 THEN concat('2a00:1450:', user_id % 10, '::', event_id % 10)
 WHEN 1 THEN concat('fd00:', user_id % 10, '::', event_id % 10)
 WHEN 2 THEN concat('fe80::', event_id % 10)
 WHEN 3 THEN '::1'
 WHEN 4 THEN concat('ff02::', event_id % 10)
 WHEN 5 THEN concat('12345::', event_id % 10)
 ELSE concat('1:2:3:', user_id % 10, ':::', event_id % 10) END AS ip FROM {events}"""


@query("enrich_ip_v6", f"""
WITH t AS ({V6_TOKENS.replace('{events}', 'events')}),
c AS (SELECT *, ip LIKE 'fd%' AS ula, ip LIKE 'fe80%' AS link, ip = '::1' AS loop, ip LIKE 'ff02%' AS multi,
 ip NOT LIKE '12345%' AND ip NOT LIKE '1:2:3%' AS ok FROM t)
SELECT ip, ok AS is_valid, ula OR link OR loop AS is_private, loop AS is_loopback, multi AS is_multicast,
 CASE WHEN ok AND NOT (ula OR link OR loop) THEN 0.3 ELSE 0.0 END::DOUBLE AS risk_score,
 CASE WHEN NOT ok THEN 'invalid' ELSE concat_ws(',', CASE WHEN ula OR link OR loop THEN 'private' END,
  CASE WHEN loop THEN 'loopback' END, CASE WHEN multi THEN 'multicast' END) END AS tags,
 CASE WHEN ok THEN 6 END AS version FROM c""")
def q_enrich_v6(spark, d):
    """T4: global, local, link-local, loopback, multicast and malformed IPv6 tokens made from the events."""
    tokens = spark.sql(V6_TOKENS, events=fx.table(spark, d, "events"))
    out = tokens.select("ip", I.enrich_ip_v6(F.col("ip")).alias("e"))
    return out.select("ip", "e.is_valid", "e.is_private", "e.is_loopback", "e.is_multicast", "e.risk_score",
                      F.concat_ws(",", "e.tags").alias("tags"), "e.version")


# networks of several lengths around the addresses and tokens that the tables hold, some with host bits set
NETWORKS = """
SELECT DISTINCT concat(ip, '/', CASE length(ip) % 4 WHEN 0 THEN 8 WHEN 1 THEN 20 WHEN 2 THEN 27 ELSE 32 END) AS network FROM {v4}
UNION ALL SELECT DISTINCT concat('2a00:1450:', user_id % 10, '::/', CASE user_id % 2 WHEN 0 THEN 48 ELSE 40 END) FROM {events}
UNION ALL SELECT 'fd00::/8' UNION ALL SELECT '::/0' UNION ALL SELECT '10.0.0.0/33'"""
V4_ONLY = f"SELECT ip FROM {IPS_SQL} WHERE regexp_matches(ip, {sp.lit(V.STRICT_IPV4)}) AND list_max([CAST(o AS INTEGER) FOR o IN string_split(ip, '.')]) <= 255"


@query("network_longest_prefix", W(f"""
WITH v4 AS ({V4_ONLY}), nets AS ({NETWORKS.replace('{v4}', 'v4').replace('{events}', 'events')}),
n4 AS (SELECT network, CAST(split_part(network, '/', 2) AS INTEGER) AS len, split_part(network, '/', 1) AS base FROM nets
  WHERE network NOT LIKE '%:%' AND network NOT LIKE '%/33'),
b4 AS (SELECT min(network) AS network, len, num // (1::BIGINT << (32 - len)) AS top FROM (SELECT *, list_reduce(
  [CAST(o AS BIGINT) FOR o IN string_split(base, '.')], lambda a, o: a * 256 + o) AS num FROM n4) GROUP BY 2, 3),
ips AS (SELECT ip FROM {IPS_SQL} UNION SELECT ip FROM ({V6_TOKENS.replace('{events}', 'events')})),
a4 AS (SELECT ip, list_reduce([CAST(o AS BIGINT) FOR o IN string_split(ip, '.')], lambda a, o: a * 256 + o) AS num FROM v4),
m4 AS (SELECT a.ip, arg_max(b.network, b.len) AS network, max(b.len) AS len FROM a4 a
  JOIN b4 b ON b.top = a.num // (1::BIGINT << (32 - b.len)) GROUP BY 1),
a6 AS (SELECT ip FROM ips WHERE ip LIKE '%:%' AND ip NOT LIKE '12345%' AND ip NOT LIKE '1:2:3%'),
n6 AS (SELECT network, CAST(split_part(network, '/', 2) AS INTEGER) AS len, split_part(network, '::/', 1) AS head FROM nets WHERE network LIKE '%:%'),
-- groups below 16 leave the first 40 bits of 2a00:1450:x:: at 2a00:1450, so every /40 is one network
b6 AS (SELECT min(network) AS network, len, CASE len WHEN 48 THEN head || ':' WHEN 40 THEN '2a00:1450:' WHEN 8 THEN 'fd' ELSE '' END AS head
  FROM n6 GROUP BY 2, 3),
m6 AS (SELECT a.ip, arg_max(b.network, b.len) AS network, max(b.len) AS len FROM a6 a JOIN b6 b ON starts_with(a.ip, b.head) GROUP BY 1)
SELECT i.ip, CASE WHEN i.ip IN (SELECT ip FROM a4) THEN 4 WHEN i.ip IN (SELECT ip FROM a6) THEN 6 END AS version,
 coalesce(m4.network, m6.network) AS network, coalesce(m4.len, m6.len) AS prefix_length
FROM ips i LEFT JOIN m4 ON m4.ip = i.ip LEFT JOIN m6 ON m6.ip = i.ip""", "f_lines"))
def q_network_longest_prefix(spark, d):
    """J6, T1, T4 for a list of networks of any length: the longest that holds each address of the lines and events."""
    events = fx.table(spark, d, "events")
    v4 = th.distinct_ips(lines(spark, d), "raw_message")
    valid = nw.with_address(v4, "ip").filter("_version = 4").select("ip")
    tokens = spark.sql(V6_TOKENS, events=events)
    return nw.longest_prefix(v4.unionByName(tokens), spark.sql(NETWORKS, v4=valid, events=events))

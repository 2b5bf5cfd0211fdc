"""IPv4 classification as column expressions.

Addresses become 32-bit numbers; membership in a CIDR block is a range
test, so enrichment never leaves the JVM.  IPv6 strings alone go through a
small Arrow-batched helper because they need Python's parser.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.
# Bogon blocks of the reference's offline threat list:
BOGON_NETWORKS = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8",
    "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "240.0.0.0/4", "255.255.255.255/32",
]
# Python 3.13 ``ipaddress`` notion of a private IPv4 address (is_private):
PRIVATE_NETWORKS = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
]
PRIVATE_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]
LOOPBACK_NETWORK = "127.0.0.0/8"
MULTICAST_NETWORK = "224.0.0.0/4"
IPV4_TOKEN = r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"
DOMAIN_TOKEN = r"\b([a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b"
HIGH_RISK = 0.5
RISK_PUBLIC = 0.3
RISK_SUSPICIOUS_BOGON = 0.7
# ---------------------------------------------------------------------------

OCTET = r"(0|[1-9][0-9]{0,2})"
STRICT_IPV4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"


def cidr_range(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)


def ipv4_number(ip: Column) -> Column:
    """Address as a long; NULL unless a strict dotted quad (no leading zeros, <= 255)."""
    parts = F.split(ip, r"\.")
    octets = [parts.getItem(i).try_cast("long") for i in range(4)]
    ok = ip.rlike(STRICT_IPV4)
    for o in octets:
        ok = ok & (o <= 255)
    num = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(ok, num)


def in_networks(num: Column, cidrs: list[str]) -> Column:
    cond = F.lit(False)
    for c in cidrs:
        lo, hi = cidr_range(c)
        cond = cond | num.between(lo, hi)
    return cond


def ipv4_flags(num: Column) -> Column:
    """Membership flags of an address number (pass a plain column: the
    number is referenced once per CIDR block)."""
    valid = num.isNotNull()
    return F.struct(
        valid.alias("is_valid"),
        (valid & in_networks(num, PRIVATE_NETWORKS) & ~in_networks(num, PRIVATE_EXCEPTIONS)).alias("is_private"),
        (valid & in_networks(num, BOGON_NETWORKS)).alias("is_bogon"),
        (valid & in_networks(num, [LOOPBACK_NETWORK])).alias("is_loopback"),
        (valid & in_networks(num, [MULTICAST_NETWORK])).alias("is_multicast"),
    )


def ipv4_risk(valid: Column, private: Column, bogon: Column) -> Column:
    """Public 0.3; bogon and not private 0.7; otherwise (and invalid) 0.0."""
    return (
        F.when(~valid, F.lit(0.0))
        .when(bogon & ~private, F.lit(RISK_SUSPICIOUS_BOGON))
        .when(~private & ~bogon, F.lit(RISK_PUBLIC))
        .otherwise(F.lit(0.0))
    )


def ipv4_tags(valid: Column, private: Column, bogon: Column, loopback: Column, multicast: Column) -> Column:
    """Tags in the reference's order; ['invalid'] for unparsable strings."""
    joined = F.concat_ws(
        ",",
        F.when(private, F.lit("private")), F.when(bogon, F.lit("bogon")),
        F.when(loopback, F.lit("loopback")), F.when(multicast, F.lit("multicast")),
        F.when(bogon & ~private, F.lit("suspicious-bogon")),
    )
    return (
        F.when(~valid, F.array(F.lit("invalid")))
        .when(joined == "", F.array().cast("array<string>"))
        .otherwise(F.split(joined, ","))
    )


def extract_ipv4(text: Column) -> Column:
    """Distinct IPv4-looking tokens of a text (sorted, so deterministic)."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(IPV4_TOKEN), 1)))


def extract_domains(text: Column) -> Column:
    """T5: every domain-looking token, in text order (regex declared by the reference)."""
    return F.regexp_extract_all(text, F.lit(DOMAIN_TOKEN), 0)


_V6_SCHEMA = T.StructType([
    T.StructField("value", T.StringType()), T.StructField("is_valid", T.BooleanType()),
    T.StructField("is_private", T.BooleanType()), T.StructField("is_loopback", T.BooleanType()),
    T.StructField("is_multicast", T.BooleanType()), T.StructField("risk_score", T.DoubleType()),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("version", T.IntegerType()),
])


@F.pandas_udf(_V6_SCHEMA)
def _parsed_v6(ips: pd.Series) -> pd.DataFrame:
    """Each distinct address of a batch by Python's parser; null rows (IPv4, handled by columns) stay null."""
    found = {None: (None,) * len(_V6_SCHEMA)}
    for s in ips.dropna().unique():
        try:
            a = ipaddress.ip_address(s)
        except ValueError:
            found[s] = (s, False, False, False, False, 0.0, ["invalid"], None)
            continue
        tags = [t for t, on in (("private", a.is_private), ("loopback", a.is_loopback),
                                ("multicast", a.is_multicast)) if on]
        risk = 0.0 if a.is_private else RISK_PUBLIC
        found[s] = (s, True, a.is_private, a.is_loopback, a.is_multicast, risk, tags, a.version)
    rows = [found[s if isinstance(s, str) else None] for s in ips]
    return pd.DataFrame(rows, columns=_V6_SCHEMA.names, dtype=object)


def enrich_ip_v6(ip: Column) -> Column:
    """T4: struct of an address of either version, as Python's parser sees it.

    Dotted quads and anything else without a colon are range tests on columns; only values with a colon
    go to Python, each distinct one of a batch once.  Null and malformed values are invalid."""
    number = ipv4_number(ip)
    flags = ipv4_flags(number)
    tags = F.filter(F.array(*[F.when(flags[f"is_{t}"], F.lit(t)) for t in ("private", "loopback", "multicast")]), lambda t: t.isNotNull())
    v4 = F.struct(
        ip.alias("value"), number.isNotNull().alias("is_valid"), flags["is_private"].alias("is_private"),
        flags["is_loopback"].alias("is_loopback"), flags["is_multicast"].alias("is_multicast"),
        F.when(number.isNotNull() & ~flags["is_private"], F.lit(RISK_PUBLIC)).otherwise(F.lit(0.0)).alias("risk_score"),
        F.when(number.isNull(), F.array(F.lit("invalid"))).otherwise(tags).alias("tags"),
        F.when(number.isNotNull(), F.lit(4)).alias("version"))
    colon = F.coalesce(F.contains(ip, F.lit(":")), F.lit(False))
    return F.when(colon, _parsed_v6(F.when(colon, ip))).otherwise(v4)

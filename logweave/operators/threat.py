"""Threat enrichment of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.ip import (
    BOGON_NETWORKS, HIGH_RISK, IPV4_TOKEN, PRIVATE_EXCEPTIONS, PRIVATE_NETWORKS, cidr_range,
    extract_domains, extract_ipv4, in_networks, ipv4_flags, ipv4_number, ipv4_risk, ipv4_tags,
)


FLAG_COLUMNS = ["is_valid", "is_private", "is_bogon", "is_loopback", "is_multicast"]


def enrich_ips(df: DataFrame, ip_col: str = "ip") -> DataFrame:
    """T1/T2 on a column of address strings, in three projections (number,
    flags, risk/tags) so every step reads plain columns; Catalyst keeps the
    projections apart because the number is reused many times."""
    cols = df.columns
    num = df.withColumn("_num", ipv4_number(F.col(ip_col)))
    flags = num.select(*cols, ipv4_flags(F.col("_num")).alias("_f")).select(*cols, "_f.*")
    v, p, b, lb, mc = (F.col(c) for c in FLAG_COLUMNS)
    return flags.select(
        *cols, *FLAG_COLUMNS,
        ipv4_risk(v, p, b).alias("risk_score"),
        ipv4_tags(v, p, b, lb, mc).alias("tags"),
        F.when(v, F.lit(4)).alias("version"),
    )


def _risk_of_number(n: Column) -> Column:
    valid = n.isNotNull()
    private = valid & in_networks(n, PRIVATE_NETWORKS) & ~in_networks(n, PRIVATE_EXCEPTIONS)
    bogon = valid & in_networks(n, BOGON_NETWORKS)
    return ipv4_risk(valid, private, bogon)


def threat_enrich(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Per text — distinct IPv4 tokens, their count, high-risk count and
    overall (max) risk, 0.0 when none.  Invalid tokens still count.

    In-row array work only (no shuffle, whatever the text length): token
    array -> number array -> risk array, each a separate projection so the
    lambdas read plain array elements.
    """
    cols = df.columns
    step1 = df.withColumn("_ips", extract_ipv4(F.col(text_col)))
    step2 = step1.withColumn("_nums", F.transform("_ips", lambda ip: ipv4_number(ip)))
    step3 = step2.withColumn("_risks", F.transform("_nums", _risk_of_number))
    return step3.select(
        *cols,
        F.col("_ips").alias("ips"),
        F.size("_ips").alias("ip_count"),
        F.size(F.filter("_risks", lambda r: r >= HIGH_RISK)).alias("high_risk_count"),
        F.coalesce(F.array_max("_risks"), F.lit(0.0)).alias("overall_risk"),
    )


def threat_indicators(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """One row per (text, distinct IPv4 token) with its enrichment."""
    exploded = df.select(key, F.explode(extract_ipv4(F.col(text_col))).alias("ip"))
    return enrich_ips(exploded, "ip")


def bogon_table(spark: SparkSession) -> DataFrame:
    """The 13 fixed bogon blocks as (network, lo, hi, octet): one row per
    first octet a block covers (a /4 spans 16), so it joins on equality."""
    rows = [(c, lo, hi, o) for c in BOGON_NETWORKS for lo, hi in [cidr_range(c)]
            for o in range(lo >> 24, (hi >> 24) + 1)]
    return spark.createDataFrame(rows, "network string, lo long, hi long, octet long")


def ip_bogon_join(ips: DataFrame, ip_col: str = "ip") -> DataFrame:
    """Range join of addresses to the bogon blocks as a bucketed
    equi-join: hash join on the first octet, then the range test.  The
    block table is a fixed constant (< 50 rows), so broadcasting it is
    bounded and the address side is only scanned."""
    nets = F.broadcast(bogon_table(ips.sparkSession))
    num = ips.withColumn("_num", ipv4_number(F.col(ip_col))).withColumn("_octet", F.shiftright("_num", 24))
    cond = (F.col("_octet") == F.col("octet")) & F.col("_num").between(F.col("lo"), F.col("hi"))
    return num.join(nets, cond).select(ip_col, "network")


def distinct_ips(df: DataFrame, text_col: str) -> DataFrame:
    """All distinct IPv4 tokens of a text column (partial distinct per task)."""
    return df.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(IPV4_TOKEN), 1)).alias("ip")).distinct()


def domains(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """T5: (key, domain, occurrences) for every domain-looking token."""
    return (
        df.select(key, F.explode(extract_domains(F.col(text_col))).alias("domain"))
        .groupBy(key, "domain").agg(F.count(F.lit(1)).alias("occurrences"))
    )

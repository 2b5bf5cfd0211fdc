"""Literal cases for IP enrichment and text risk."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from logweave.functions.ip import enrich_ip_v6
from logweave.operators.threat import enrich_ips, threat_enrich


def enriched(spark, *ips):
    return {r.ip: r for r in enrich_ips(spark.createDataFrame([(i,) for i in ips], "ip string")).collect()}


def test_classes(spark):
    e = enriched(spark, "172.31.0.9", "127.8.8.8", "185.60.1.2", "0.9.9.9", "100.127.255.255", "239.1.2.3", "192.0.0.10", "241.0.0.1")
    assert e["172.31.0.9"].tags == ["private", "bogon"] and e["172.31.0.9"].risk_score == 0.0
    assert "loopback" in e["127.8.8.8"].tags
    assert (e["185.60.1.2"].tags, e["185.60.1.2"].risk_score) == ([], 0.3)
    assert "bogon" in e["0.9.9.9"].tags
    assert (e["100.127.255.255"].tags, e["100.127.255.255"].risk_score) == (["bogon", "suspicious-bogon"], 0.7)
    assert (e["239.1.2.3"].tags, e["239.1.2.3"].risk_score) == (["multicast"], 0.3)
    assert e["192.0.0.10"].risk_score == 0.7 and e["241.0.0.1"].risk_score == 0.0


@pytest.mark.parametrize("text", ["", "1.2.3", "1.2.3.4.5", "1.2.3.256", "1.02.3.4", "one.two.three.four", "::1"])
def test_not_an_ipv4_address(spark, text):
    assert enriched(spark, text)[text].tags == ["invalid"]


def test_private_equals_the_standard_library(spark):
    ips = [str(ipaddress.ip_address(n * 65_537_003 % 2**32)) for n in range(400)]
    for ip, r in enriched(spark, *ips).items():
        assert ("private" in r.tags) == ipaddress.ip_address(ip).is_private


def test_ipv6(spark):
    df = spark.createDataFrame([(i,) for i in ("2606:4700::1", "fd12::9", "::1", "ff05::2", "1::2::3", None)], "ip string")
    got = {r.ip: r.e for r in df.select("ip", enrich_ip_v6(F.col("ip")).alias("e")).collect()}
    assert got["2606:4700::1"].risk_score == 0.3 and got["fd12::9"].tags == ["private"]
    assert got["::1"].is_loopback and got["ff05::2"].is_multicast
    assert got["1::2::3"].tags == ["invalid"] and got[None].is_valid is False


def test_addresses_of_both_versions_equal_the_standard_library(spark):
    ips = [str(ipaddress.ip_address(n * 65_537_003 % 2**32)) for n in range(200)]
    ips += ["192.0.0.9", "192.0.0.170", "224.0.0.1", "255.255.255.255", "127.3.2.1", "::1", "::ffff:10.0.0.1", "fe80::1%eth0", "2001:db8::7", "ff02::1", "2606:4700::1"]
    bad = ["1.2.3", "01.2.3.4", "1.2.3.256", "", "a:b", "1::2::3", ":", None]
    df = spark.createDataFrame([(i,) for i in [*ips, *bad, "::1"]], "ip string")
    got = df.select("ip", enrich_ip_v6(F.col("ip")).alias("e")).collect()
    for r in got:
        if r.ip in bad:
            assert (r.e["value"], r.e.is_valid, r.e.tags, r.e.risk_score, r.e.version) == (r.ip, False, ["invalid"], 0.0, None), r
            continue
        a = ipaddress.ip_address(r.ip)
        tags = [t for t, on in (("private", a.is_private), ("loopback", a.is_loopback), ("multicast", a.is_multicast)) if on]
        assert (r.e.is_valid, r.e.is_private, r.e.is_loopback, r.e.is_multicast, r.e.tags, r.e.version) == (True, a.is_private, a.is_loopback, a.is_multicast, tags, a.version), r
        assert r.e.risk_score == (0.0 if a.is_private else 0.3)


def test_text_risk(spark):
    texts = ["probe by 91.10.20.30 on port 2222", "nothing to see", "via 172.16.5.5, 91.1.1.1 and 100.100.0.1", None]
    rows = {r.text: r for r in threat_enrich(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert rows[texts[0]].ips == ["91.10.20.30"] and rows[texts[0]].ip_count == 1
    assert (rows[texts[1]].ip_count, rows[texts[1]].overall_risk, rows[texts[1]].high_risk_count) == (0, 0.0, 0)
    assert (rows[texts[2]].ip_count, rows[texts[2]].overall_risk, rows[texts[2]].high_risk_count) == (3, 0.7, 1)

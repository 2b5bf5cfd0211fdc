"""Longest-prefix joins against Python's own address parser."""

import ipaddress
import random

from pyspark.sql import functions as F

from logweave.operators import networks as nw


def parsed(text):
    try:
        return ipaddress.ip_address(text)
    except (ValueError, TypeError):
        return None


def random_address(rng, version):
    if version == 4:
        return str(ipaddress.IPv4Address(rng.choice([10 << 24, 203 << 24]) + rng.getrandbits(20)))
    return str(ipaddress.IPv6Address((0x20010DB8 << 96) + (rng.getrandbits(14) << 80) + rng.getrandbits(rng.choice([8, 70]))))


def test_addresses_are_parsed_as_by_python(spark):
    odd = ["::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::",
           ":1", "1:", "FFFF:ABCD::", "12345::", "g::", "::ffff:1.2.3.4", "::1.2.3.256", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "1.2.3.4::",
           "", " ", None, "1.2.3.4", "01.2.3.4", "1.2.3", "255.255.255.255", "0.0.0.0", ":", "1:2:3:4::5:6:7:8", "::1.2.3.4:5"]
    rng = random.Random(5)
    texts = odd + [random_address(rng, v) for v in (4, 6) for _ in range(300)]
    rows = nw.with_address(spark.createDataFrame([(t,) for t in texts], "ip string"), "ip").collect()
    assert len(rows) == len(texts)
    for r in rows:
        a = parsed(r.ip)
        assert r._version == (a.version if a else None), r.ip
        if a:
            number = int(a) << 96 if a.version == 4 else int(a)
            assert ((r._hi % 2**64) << 64) + r._lo % 2**64 == number, r.ip


def test_longest_of_100000_networks(spark):
    rng = random.Random(7)
    nets = [f"{random_address(rng, 4)}/{rng.randint(8, 32)}" for _ in range(50_000)]
    nets += [f"{random_address(rng, 6)}/{rng.choice([0, 32, 48, 56, 64, 65, 96, 127, 128])}" for _ in range(50_000)]
    odd = [None, "", "x/8", "1.2.3.4/33", "::/129", "10.0.0.1/-1", "10.0.0.0/8/8", "203.0.113.9", "10.0.0.0/", "10.7.7.7/08"]
    ips = [random_address(rng, v) for v in (4, 6) for _ in range(1_500)] + ["99.1.1.1", "bad", None, "", "203.0.113.9"]
    found = nw.longest_prefix(
        spark.createDataFrame([(t,) for t in ips * 2], "ip string"), spark.createDataFrame([(t,) for t in nets + odd], "network string")).collect()

    table = {}
    for text in nets + ["203.0.113.9", "10.7.7.7/08"]:
        net = ipaddress.ip_network(text, strict=False)
        key = net.version, net.prefixlen, int(net.network_address)
        table[key] = min(table.get(key, text), text)
    assert len(found) == len(set(ips))
    for r in found:
        a = parsed(r.ip)
        want = None
        if a:
            for length in range(a.max_prefixlen, -1, -1):
                masked = int(a) >> (a.max_prefixlen - length) << (a.max_prefixlen - length)
                if (a.version, length, masked) in table:
                    want = table[a.version, length, masked], length
                    break
        assert (r.version, r.network, r.prefix_length) == (a.version if a else None, *(want or (None, None))), r.ip


def test_empty_lists_and_hot_addresses(spark):
    ips = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, "10.1.1.1").otherwise(F.concat(F.lit("10.2.0."), F.col("id") % 250)).alias("ip"))
    none = spark.createDataFrame([], "network string")
    assert nw.longest_prefix(ips, none).filter("network IS NOT NULL").isEmpty() and nw.longest_prefix(ips, none).count() == 251
    assert nw.longest_prefix(ips.limit(0), none).isEmpty()
    nets = spark.createDataFrame([("10.0.0.0/8",), ("10.1.1.0/24",)], "network string")
    assert {r.ip: r.network for r in nw.longest_prefix(ips, nets).collect()}["10.1.1.1"] == "10.1.1.0/24"


def test_no_loop_or_product_join(spark):
    rows = spark.createDataFrame([("10.0.0.0/8",)], "network string")
    plan = nw.longest_prefix(rows.withColumnRenamed("network", "ip"), rows)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan

"""Longest-prefix join of addresses with any list of networks.

An address of either version becomes two 64-bit numbers (an IPv4 address fills
the top 32 bits of the first), a network the same with a prefix length.  An
address is masked to each prefix length that the list has, at most 33 + 129 of
them, and joined on (version, length, masked numbers): joins on equal keys,
whatever the size of the list.  The longest match wins.

A short network can hold any share of the addresses.  Those of up to 16 bits
are fewer than 2 x 2^17 (about 20 MB) and are broadcast; a longer one holds at
most 2^16 IPv4 addresses, and IPv6 networks are dealt to ``SALTS`` keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.ip import ipv4_number

V6_GROUP = r"^[0-9A-Fa-f]{1,4}$"
SHORT = 16
SALTS = 32


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns by a generator of one row: later steps and filters read them as plain columns, where
    projections would be merged and each use would repeat the whole expression."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def with_address(df: DataFrame, ip_col: str) -> DataFrame:
    """Adds _version (4, 6; null if the text is no address), _hi and _lo.

    IPv6 groups have one to four hexadecimal digits, ``::`` may stand for one or more groups of zeros, a dotted
    quad for the last two groups; a zone (``%eth0``) is not accepted."""
    own = df.columns
    text = F.col(f"`{ip_col}`")
    six = F.when(F.contains(text, F.lit(":")), text)
    df = _step(df, _n4=ipv4_number(text), _six=six, _quad=ipv4_number(F.regexp_extract(six, r":([0-9.]+)$", 1)))
    tail = F.lpad(F.lower(F.hex("_quad")), 8, "0")
    plain = F.when(F.col("_quad").isNull(), F.col("_six")).otherwise(
        F.concat(F.regexp_extract("_six", r"^(.*:)[^:]*$", 1), tail.substr(1, 4), F.lit(":"), tail.substr(5, 4)))
    df = _step(df, _halves=F.split(plain, "::"))
    groups = lambda half: F.filter(F.split(half, ":"), lambda g: (g != "") | (half != ""))  # noqa: E731  '' has none
    df = _step(df, _head=groups(F.col("_halves")[0]), _rest=groups(F.coalesce(F.get("_halves", F.lit(1)), F.lit(""))))
    df = _step(df, _all=F.concat("_head", "_rest"), _gap=8 - F.size("_head") - F.size("_rest"))
    fits = ((F.size("_halves") == 1) & (F.col("_gap") == 0)) | ((F.size("_halves") == 2) & (F.col("_gap") >= 1))
    valid = fits & F.forall("_all", lambda g: g.rlike(V6_GROUP))
    filled = F.concat("_head", F.array_repeat(F.lit("0"), F.greatest("_gap", F.lit(0))), "_rest")
    df = _step(df, _digits=F.when(valid, F.concat_ws("", F.transform(filled, lambda g: F.lpad(g, 4, "0")))))
    long = lambda at: F.conv(F.col("_digits").substr(at, 16), 16, -10).cast("long")  # noqa: E731  signed
    df = _step(
        df,
        _version=F.when(F.col("_n4").isNotNull(), 4).when(F.col("_digits").isNotNull(), 6),
        _hi=F.when(F.col("_n4").isNotNull(), F.shiftleft("_n4", 32)).otherwise(long(1)),
        _lo=F.when(F.col("_n4").isNotNull(), F.lit(0).cast("long")).otherwise(long(17)),
    )
    return df.select(*[F.col(f"`{c}`") for c in own], "_version", "_hi", "_lo")


def _masked(hi: str, lo: str, length: str) -> tuple[Column, Column]:
    """The first ``length`` bits of two 64-bit numbers, the others zero."""
    high = F.expr(f"CASE WHEN {length} >= 64 THEN {hi} WHEN {length} <= 0 THEN 0L ELSE {hi} & shiftleft(-1L, 64 - {length}) END")
    low = F.expr(f"CASE WHEN {length} >= 128 THEN {lo} WHEN {length} <= 64 THEN 0L ELSE {lo} & shiftleft(-1L, 128 - {length}) END")
    return high, low


def parsed_networks(networks: DataFrame, col: str = "network") -> DataFrame:
    """Distinct valid networks: network (its text), version, length, hi, lo.

    ``address/length``, or an address alone (a network of one).  Host bits are masked off; of texts that name
    one network the least stays.  Null and invalid texts are left out: they hold no address."""
    text = F.col(f"`{col}`")
    parts = F.split(text, "/")
    rows = networks.select(text.alias("network"), parts.getItem(0).alias("_ip"), F.get(parts, F.lit(1)).alias("_given"), F.size(parts).alias("_n"))
    rows = with_address(rows.filter("_n <= 2"), "_ip")
    bits = F.when(F.col("_version") == 4, 32).when(F.col("_version") == 6, 128)
    given = F.when(F.col("_given").rlike("^[0-9]{1,3}$"), F.col("_given").cast("int"))
    rows = _step(rows, length=F.when(F.col("_n") == 1, bits).when(given <= bits, given)).filter("length IS NOT NULL")
    hi, lo = _masked("_hi", "_lo", "length")
    rows = rows.select("network", F.col("_version").alias("version"), "length", hi.alias("hi"), lo.alias("lo"))
    return rows.groupBy("version", "length", "hi", "lo").agg(F.min("network").alias("network"))


def longest_prefix(ips: DataFrame, networks: DataFrame, ip_col: str = "ip", network_col: str = "network") -> DataFrame:
    """One row for each distinct address text: ip, version, network, prefix_length (null without a network).

    Invalid and null addresses have a null version and match nothing.  An address that holds a third of all
    rows is one row here; join the result back on the text."""
    table = parsed_networks(networks, network_col)
    # at most 33 + 129 rows, whatever the list
    lengths = table.groupBy("version").agg(F.collect_set("length").alias("lengths"))
    addresses = with_address(ips.select(F.col(f"`{ip_col}`").alias("ip")).distinct(), "ip").withColumnRenamed("_version", "version")
    asked = addresses.join(F.broadcast(lengths), "version", "left").select(
        "ip", "version", "_hi", "_lo", F.xxhash64("ip").alias("_hash"), F.explode_outer("lengths").alias("length"))
    hi, lo = _masked("_hi", "_lo", "length")
    asked = asked.select("ip", "version", "length", hi.alias("hi"), lo.alias("lo"), "_hash")
    key = ["version", "length", "hi", "lo"]
    short = table.filter(F.col("length") <= SHORT).withColumnRenamed("network", "short")
    asked = asked.join(F.broadcast(short), key, "left")
    # no network of the second join is short: such rows, and those without a length, are spread by their hash
    long = F.coalesce(F.col("length") > SHORT, F.lit(False))
    asked = asked.withColumn("hi", F.when(long, F.col("hi")).otherwise(F.col("_hash"))).withColumn("lo", F.coalesce("lo", F.lit(0)))
    asked = asked.withColumns({"length": F.coalesce("length", F.lit(0)), "salt": F.when(F.col("version") == 6, F.pmod("_hash", F.lit(SALTS))).otherwise(0).cast("int")})
    salts = F.when(F.col("version") == 6, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = table.filter(F.col("length") > SHORT).withColumn("salt", F.explode(salts))
    hits = asked.join(dealt, [*key, "salt"], "left").withColumn("network", F.coalesce("network", "short"))
    best = F.max(F.when(F.col("network").isNotNull(), F.struct("length", "network")))
    return hits.groupBy("ip").agg(F.max("version").alias("version"), best.alias("best")).select(
        "ip", "version", F.col("best.network").alias("network"), F.col("best.length").alias("prefix_length"))

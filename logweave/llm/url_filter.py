"""URL filters: a trie over reversed host labels and path segments, longest match wins.

A rule is a host and a path prefix (``example.org/en/1``); it fits the host and
all its subdomains when the url's path starts with the rule's.  The rule with
more host labels wins, then the one with the longer path; if the same rule is
listed as allow and block, allow wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to which the trie is broadcast; more go through ``judge_by_join``.
BROADCAST_RULES = 200_000
DEFAULT = "allow"


def split_rule(rule: str) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a rule; a rule without a slash has the empty path."""
    host, slash, path = rule.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


class Trie:
    """Children by host label from the last one on; below a host, children by whole path segment.
    A node holds the entries that end at it and those that end within the next segment."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.root: dict = {}
        for rule, verdict in rules:
            host, path = split_rule(rule)
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            whole, _, rest = path.rpartition("/") if path else ("", "", "")
            for segment in whole.split("/")[1:] if whole else []:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            # an entry is the prefix of the next segment at which the rule ends; the empty path stands apart
            entries = node.setdefault("ends", {})
            key = rest if path else None
            if entries.get(key, ("", ""))[1] != "allow":
                entries[key] = (rule, verdict)

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        best = node.get("ends", {}).get(None)
        if not path.startswith("/"):
            return best
        segments = path[1:].split("/")
        for i, segment in enumerate(segments):
            ends = node.get("ends", {})
            if ends:
                longest = max((e for e in ends if e is not None and segment.startswith(e)), key=len, default=None) if len(ends) <= len(segment) else next((segment[:k] for k in range(len(segment), -1, -1) if segment[:k] in ends), None)
                if longest is not None:
                    best = ends[longest]
            node = node.get("segments", {}).get(segment) if i + 1 < len(segments) else None
            if node is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule and its verdict."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                best = self._path(node["paths"], path) or best
        return best


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_by_trie(urls: DataFrame, rules: list[tuple[str, str]], default: str = DEFAULT) -> DataFrame:
    """``urls`` (host, path and any columns) with rule and verdict, by a broadcast trie; no shuffle."""
    trie = urls.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.arrow_udf("rule string, verdict string")
    def judged(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        match = trie.value.match
        for host, path in parts:
            found = [match(h or "", p or "") or (None, default) for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], ["rule", "verdict"])

    return urls.withColumn("judged", judged("host", "path")).withColumns({"rule": F.col("judged.rule"), "verdict": F.col("judged.verdict")}).drop("judged")


def judge_by_join(urls: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """The same for rules (rule, verdict) of any number: each host suffix meets the path lengths that
    rules of it have, then the rule itself; the longest fitting one of a url is kept.

    Joins are on (host suffix) and (host suffix, path prefix); hot suffixes are split by skew joins.
    """
    rule_host = F.translate(F.substring_index("rule", "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    listed = rules.select("rule", "verdict", rule_host.alias("suffix"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("prefix"))
    # allow before block, then the first rule by code point, for rules of one host and path
    listed = listed.groupBy("suffix", "prefix").agg(F.min(F.struct("verdict", "rule")).alias("r")).withColumn("n", F.length("prefix"))
    keyed = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = keyed.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(labels)))).withColumn("suffix", F.expr("substring_index(host, '.', -k)"))
    near = suffixes.join(listed.select("suffix", "n").distinct(), "suffix").where(F.length("path") >= F.col("n"))
    near = near.withColumn("prefix", F.expr("substring(path, 1, n)"))
    hits = near.join(listed.select("suffix", "prefix", "r"), ["suffix", "prefix"])
    best = hits.groupBy("host", "path").agg(F.max_by("r", F.struct("k", "n")).alias("r"))
    out = urls.alias("u").join(best.alias("b"), (F.col("u.host") == F.col("b.host")) & (F.col("u.path") == F.col("b.path")), "left")
    return out.select("u.*", F.col("b.r.rule").alias("rule"), F.coalesce("b.r.verdict", F.lit(default)).alias("verdict"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, rule and verdict (``allow`` or ``block``; ``default`` without a rule).

    ``rules`` is a list or a DataFrame of (rule, verdict).  A null url or one without ``://`` has the
    empty host and path and fits no rule with a host.  Columns of the four names are replaced; all
    others, repeated rows and the row count stay; an empty table stays empty.
    The rule list is broadcast as a trie after a count shows at most ``BROADCAST_RULES`` rules; longer
    lists are joined by key.
    """
    url = F.col(f"`{url_col}`").cast("string")
    urls = pages.withColumns({"_llm_host": host_of(url), "_llm_path": path_of(url)}).drop("host", "path", "rule", "verdict")
    urls = urls.withColumnsRenamed({"_llm_host": "host", "_llm_path": "path"})
    if isinstance(rules, DataFrame):
        if rules.limit(BROADCAST_RULES + 1).count() > BROADCAST_RULES:
            return judge_by_join(urls, rules.select("rule", "verdict"), default)
        rules = [(r.rule, r.verdict) for r in rules.select("rule", "verdict").collect()]
    elif len(rules) > BROADCAST_RULES:
        return judge_by_join(urls, pages.sparkSession.createDataFrame(rules, "rule string, verdict string"), default)
    return judge_by_trie(urls, rules, default)

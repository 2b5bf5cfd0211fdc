"""URL rules: trie against a scan of all rules, and the join against the trie."""

import random

from logweave.llm import url_filter as uf
from logweave.llm.q_llm import URL_RULES

URLS = [
    "http://a.example.org/es/1?q#f", "https://EXAMPLE.ORG/en/1048", "http://example.org", "https://x.com/fr/", "http://com/de/x", "ftp://notcom/de/", "http://a.com?x=/de/",
    "no scheme.org/es/", None, "", "://b.example.org/en/1", "http://u://org/x", "http://a..org/", "http://example.org/es", "https://x.com:80/de/",
]


def by_scan(url, rules):
    """Host, path, rule and verdict as the contract says them."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for rule, verdict in rules:
        rule_host, rule_path = uf.split_rule(rule)
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            key = (rule_host.count("."), len(rule_path), verdict == "allow")
            if best is None or key > best[0]:
                best = key, rule, verdict
    return host, path, best[1] if best else None, best[2] if best else "allow"


def random_case(seed):
    rng = random.Random(seed)
    hosts = ["org", "a.org", "b.a.org", "com", "x.com"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/ab/c", "//", "/a//b"]
    rules = [(rng.choice(hosts) + rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(rng.randint(0, 14))]
    rules = list({(r): v for r, v in rules}.items())
    urls = [f"http://{rng.choice(['', 'w.', 'a.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'b', 'b/c', '?q', '#/a'])}" for _ in range(40)]
    return rules, urls


def test_trie_equals_scan():
    for seed in range(150):
        rules, urls = random_case(seed)
        trie = uf.Trie(rules)
        for url in urls:
            host, path, rule, verdict = by_scan(url, rules)
            assert (trie.match(host, path) or (None, "allow")) == (rule, verdict), (url, rules)


def test_allow_wins_for_one_rule():
    for order in ([("a.org/x", "allow"), ("a.org/x", "block")], [("a.org/x", "block"), ("a.org/x", "allow")]):
        assert uf.Trie(order).match("a.org", "/x")[1] == "allow"


def test_judged_rows(spark):
    pages = spark.createDataFrame([(i, u, "own", "own") for i, u in enumerate(URLS)] + [(0, URLS[0], "own", "own")], "page_id long, url string, rule string, host string")
    out = uf.judge_urls(pages, URL_RULES)
    assert sorted(out.columns) == ["host", "page_id", "path", "rule", "url", "verdict"]
    for r in out.collect():
        assert (r.host, r.path, r.rule, r.verdict) == by_scan(r.url, URL_RULES)
    assert out.count() == len(URLS) + 1
    assert uf.judge_urls(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in uf.judge_urls(pages, []).collect()} == {"allow"}


def test_join_form_equals_trie(spark):
    rules, urls = random_case(77)
    frame = spark.createDataFrame(rules, "rule string, verdict string")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, *URLS])], "page_id long, url string")
    urls = pages.select("page_id", uf.host_of(pages.url).alias("host"), uf.path_of(pages.url).alias("path"))
    a = {tuple(r) for r in uf.judge_by_trie(urls, rules).collect()}
    b = {tuple(r) for r in uf.judge_by_join(urls, frame).collect()}
    assert a == b and len(a) == pages.count()

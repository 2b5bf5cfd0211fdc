"""Registered queries of the subpackage: thin applications of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.session import ensure_small_batches, ensure_utc, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            ensure_small_batches(spark)
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return run

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_url_filter",
    """
    WITH cut AS (
      SELECT page_id,
             coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
      FROM pages),
    rules(rule, rule_host, rule_path, verdict) AS (VALUES
      ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
      ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
    fitting AS (
      SELECT page_id, host, path, max_by(rule, (length(rule_host), length(rule_path))) AS rule,
             max_by(verdict, (length(rule_host), length(rule_path))) AS verdict
      FROM cut JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
      GROUP BY ALL)
    SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
    FROM cut c LEFT JOIN (SELECT DISTINCT * FROM fitting) f ON c.page_id IS NOT DISTINCT FROM f.page_id AND c.host = f.host AND c.path = f.path
    """,
)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    from logweave.llm.url_filter import judge_urls

    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op5_token_output")
def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written with Elias-Fano boundaries and read back."""
    from logweave.llm.token_output import read_boundaries, write_token_ids

    segments = write_token_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_boundaries(segments)


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by heap merging."""
    from logweave.llm.token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op3_kd_shards")
def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    from logweave.llm.kd_shards import kd_shards

    return kd_shards(table(spark, sf_dir, "documents"), shards=40)


@query("op10_source_mix")
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    from logweave.llm.source_mix import mix

    return mix(table(spark, sf_dir, "documents"))


@query("op4_piecewise_hash")
def op4_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    from logweave.llm.piecewise_hash import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a lexicon learned outside the held-out fold."""
    from logweave.llm.toxicity import held_out_scores

    return held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_pu_quality")
def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a model of trusted positives and unlabelled text."""
    from logweave.llm.pu_quality import held_out_scores

    return held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_cgk_decontam")
def op8_cgk_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the least number of edits."""
    from logweave.llm.cgk_decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_lsh_forest")
def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five-word shingles, similarity 0.8 or more."""
    from logweave.llm.lsh_forest import jaccard_links

    return jaccard_links(table(spark, sf_dir, "documents"))


@query("op12_simhash_groups")
def op12_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint of every document and the component of those within two bits."""
    from logweave.llm.simhash_groups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op11_setm_phrases",
    r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, generate_subscripts(cut, 1) AS piece, unnest(cut) AS body
      FROM (SELECT lang, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS cut FROM documents WHERE text IS NOT NULL)),
    listed AS (SELECT lang, list_filter(regexp_split_to_array(body, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
    phrases AS (
      SELECT lang, ws[i : i + size - 1] AS words, count(*) AS f
      FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM listed, (VALUES (1), (2), (3)) sizes(size))
      GROUP BY ALL),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM phrases WHERE len(words) = 1 GROUP BY lang),
    candidates AS (SELECT lang, words, f AS a FROM phrases WHERE len(words) > 1 AND f >= 10),
    covered AS (
      SELECT DISTINCT s.lang, s.words
      FROM (SELECT lang, a, unnest([words[1:2], words[2:3]]) AS words FROM candidates WHERE len(words) = 3) g
      JOIN candidates s ON s.lang = g.lang AND s.words = g.words AND 100 * g.a >= 50 * s.a),
    cuts AS (
      SELECT lang, words, a, unnest(range(1, len(words))) AS k FROM candidates ANTI JOIN covered USING (lang, words)),
    scored AS (
      SELECT c.lang, c.words, c.a, c.k, l.f AS l, r.f AS r, 1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f) AS score
      FROM cuts c JOIN phrases l ON l.lang = c.lang AND l.words = c.words[1 : c.k]
      JOIN phrases r ON r.lang = c.lang AND r.words = c.words[c.k + 1 :]),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
    named AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM lowest),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named QUALIFY rank <= 2000)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang)
    """,
)
def op11_setm_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases of two and three words."""
    from logweave.llm.setm_phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


@query(
    "op13_conversation_trie",
    """
    WITH turns AS (
      SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
      FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (
      SELECT c, max(place) AS own, c - c % 100 AS base,
             xor(list_reduce(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT),
                 lambda crc, x: list_reduce(list_transform(range(8), lambda i: 0::BIGINT), lambda v, z: xor(v >> 1, (v & 1) * 3988292384), xor(crc, x)), 4294967295::BIGINT),
                 4294967295) % 6 AS h
      FROM turns GROUP BY c),
    rebuilt AS (
      SELECT convs.c, place AS d, role, text FROM convs JOIN turns ON turns.c = base AND place <= h
      UNION ALL
      SELECT convs.c, place - h + (SELECT count(*) FROM turns b WHERE b.c = base AND b.place <= h), role, text
      FROM convs JOIN turns ON turns.c = convs.c AND place > h
      UNION ALL SELECT c, 0, NULL, NULL FROM convs),
    prefixes AS (
      SELECT c, d, text, max(d) OVER (PARTITION BY c) AS len,
             sha256(coalesce(string_agg(sha256(length(role) || ':' || role || text), ',') OVER upto, '')) AS node,
             sha256(coalesce(string_agg(sha256(length(role) || ':' || role || text), ',') OVER above, '')) AS parent
      FROM rebuilt
      WINDOW upto AS (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING), above AS (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    nodes AS (
      SELECT d, node, min(parent) AS parent, min(c) AS c, count(*) AS n_convs, coalesce(max(length(text)), 0) * (count(*) - 1) AS saved,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len), '')) AS ends
      FROM prefixes GROUP BY d, node),
    children AS (
      SELECT p.d, p.node, count(k.node) AS n_children, any_value(u.c) AS up
      FROM nodes p LEFT JOIN nodes k ON k.parent = p.node AND k.d = p.d + 1 LEFT JOIN nodes u ON u.node = p.parent AND u.d = p.d - 1
      GROUP BY p.d, p.node),
    whole AS (SELECT n.*, n_children, up FROM nodes n JOIN children USING (d, node)),
    below AS (
      SELECT a.d, a.node, sum(w.saved) AS saved_tokens, count(*) FILTER (w.n_children = 0) AS n_leaves
      FROM whole w JOIN prefixes a ON a.c = w.c AND a.d <= w.d GROUP BY a.d, a.node)
    SELECT c AS conv_id, d AS depth, up AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends AS ends_sha256
    FROM whole JOIN below USING (d, node)
    """,
)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    from logweave.llm.conversation_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))

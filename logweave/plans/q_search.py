"""Vector and keyword search queries.

Two worlds: the F-LOGS/F-VECS fixtures (driver vectors, query = vector of
vec_id 7) and prepared logs embedded by the hashing encoder (text queries).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave import fixtures as fx
from logweave.functions.text import iso_text
from logweave.functions.vector import cosine_to_query, vector_to_sparse_text
from logweave.operators import analytics as an
from logweave.operators import embed as em
from logweave.operators import search as se
from logweave.plans import sqlparts as sp
from logweave.plans.q_core import logs, prepared, search_logs, vecs
from logweave.plans.registry import query
from logweave.session import scratch_path

W = sp.sql_with
QUERY_VEC_ID = 7
QUERY_TEXT = "failed password for invalid user"
KEYWORD = "Failed password"
RES = "l.id, l.line_id, l.log_timestamp, l.level, l.event_id, l.raw_message, l.event_template"
COS = sp.cosine("embedding", "qv.q")
QV = f"qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = {QUERY_VEC_ID})"


def query_vec(spark, d):
    row = fx.table(spark, d, "embeddings").filter(F.col("vec_id") == QUERY_VEC_ID).select("embedding").first()
    return [float(x) for x in row[0]]


def _semantic_sql(level=None, top_k=20, exclude=None, qv=QV, vec_rel="f_vecs", log_rel="f_logs",
                  extra_cols=""):
    where = []
    if level:
        where.append(f"l.level = '{level}'")
    if exclude is not None:
        where.append(f"l.id <> {exclude}")
    wc = ("WHERE " + " AND ".join(where)) if where else ""
    return f"""
WITH {qv},
m AS (SELECT normalized_message, {COS} AS similarity FROM {vec_rel}, qv WHERE embedding IS NOT NULL
      ORDER BY round(1 - similarity, 9) NULLS LAST, normalized_message LIMIT {max(top_k, 20)})
SELECT {RES}, round(m.similarity, 6) AS similarity{extra_cols}
FROM m JOIN {log_rel} l ON l.normalized_message = m.normalized_message {wc}
ORDER BY round(1 - m.similarity, 9), l.log_timestamp NULLS LAST, l.line_id LIMIT {top_k}"""


@query("cosine_pairs", W(f"""
WITH {QV} SELECT vec_id, round({COS}, 6) AS similarity FROM f_vecs, qv""", "f_vecs"))
def q_cosine_pairs(spark, d):
    q = query_vec(spark, d)
    return vecs(spark, d).select("vec_id", F.round(cosine_to_query(F.col("embedding"), q), 6).alias("similarity"))


@query("semantic_search", W(_semantic_sql(), "f_vecs", "f_logs"))
def q_semantic(spark, d):
    return se.semantic_search(search_logs(spark, d), vecs(spark, d), query_vec(spark, d))


@query("semantic_search_level", W(_semantic_sql(level="ERROR"), "f_vecs", "f_logs"))
def q_semantic_level(spark, d):
    return se.semantic_search(search_logs(spark, d), vecs(spark, d), query_vec(spark, d), level="ERROR")


@query("result_projection", W(f"""
SELECT id, line_id, {sp.iso_text('log_timestamp')} AS log_timestamp, level, event_id, raw_message,
 event_template, similarity FROM ({_semantic_sql()}) t""", "f_vecs", "f_logs"))
def q_result_projection(spark, d):
    r = se.semantic_search(search_logs(spark, d), vecs(spark, d), query_vec(spark, d))
    return r.withColumn("log_timestamp", iso_text(F.col("log_timestamp")))


SIM_QV = ("qv AS (SELECT v.embedding AS q FROM f_logs l JOIN f_vecs v "
          "ON v.normalized_message = l.normalized_message WHERE l.id = 8)")


@query("similar_logs", W(_semantic_sql(exclude=8, qv=SIM_QV), "f_vecs", "f_logs"))
def q_similar(spark, d):
    return se.similar_logs(search_logs(spark, d), vecs(spark, d), log_id=8)


_IDS_SQL = f"""
m AS (SELECT normalized_message, {COS} AS similarity FROM f_vecs, qv WHERE embedding IS NOT NULL
      ORDER BY round(1 - similarity, 9) NULLS LAST, normalized_message LIMIT 200),
hits AS (SELECT l.event_id, row_number() OVER (ORDER BY round(1 - m.similarity, 9),
          l.log_timestamp NULLS LAST, l.line_id) AS rank
         FROM m JOIN f_logs l ON l.normalized_message = m.normalized_message
         QUALIFY rank <= 200),
ids AS (SELECT event_id, min(rank) AS first_rank FROM hits WHERE event_id IS NOT NULL AND event_id <> ''
        GROUP BY event_id ORDER BY first_rank LIMIT 5)"""


@query("semantic_event_ids", W(f"WITH {QV}, {_IDS_SQL} SELECT event_id, first_rank FROM ids",
                               "f_vecs", "f_logs"))
def q_event_ids(spark, d):
    return se.semantic_event_ids(search_logs(spark, d), vecs(spark, d), query_vec(spark, d))


@query("timeline_query", W(f"""
WITH {QV}, {_IDS_SQL}
SELECT CAST(date_trunc('day', log_timestamp) AS TIMESTAMP) AS bucket, count(*) AS count,
 (SELECT string_agg(event_id, ',' ORDER BY first_rank) FROM ids) AS matched_event_ids
FROM f_logs WHERE log_timestamp IS NOT NULL
 AND ((SELECT count(*) FROM ids) = 0 OR event_id IN (SELECT event_id FROM ids))
GROUP BY 1 ORDER BY 1""", "f_vecs", "f_logs"))
def q_timeline_query(spark, d):
    # at most five ids reach the driver (the reference applies them as an IN list)
    ids = [r[0] for r in se.semantic_event_ids(search_logs(spark, d), vecs(spark, d), query_vec(spark, d)).collect()]
    return an.timeline(logs(spark, d), "day", event_ids=ids or None).withColumn(
        "matched_event_ids", F.lit(",".join(ids)) if ids else F.lit(None).cast("string")
    )


@query("knn_documents", W(f"""
WITH {QV}, s AS (SELECT normalized_message, {COS} AS similarity FROM f_vecs, qv WHERE embedding IS NOT NULL)
SELECT * FROM (
 SELECT l.id, l.line_id, l.source, l.log_timestamp, l.level, l.event_id, l.raw_message, l.normalized_message,
  l.event_template, round(s.similarity, 6) AS similarity
 FROM f_logs l JOIN s ON s.normalized_message = l.normalized_message
 ORDER BY round(1 - s.similarity, 9), l.line_id LIMIT 20) t WHERE level = 'WARNING'""", "f_vecs", "f_logs"))
def q_knn_documents(spark, d):
    return se.knn_documents(search_logs(spark, d), vecs(spark, d), query_vec(spark, d), level="WARNING")


@query("semantic_search_batch", """
WITH q AS (SELECT min(vec_id) AS query_id FROM embeddings GROUP BY label),
qv AS (SELECT q.query_id, e.embedding AS qe FROM q JOIN embeddings e ON e.vec_id = q.query_id),
pairs AS (SELECT qv.query_id, e.vec_id,
  list_cosine_similarity(e.embedding::DOUBLE[], qv.qe::DOUBLE[]) AS sim
  FROM qv CROSS JOIN embeddings e WHERE e.embedding IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - sim, 9), vec_id) AS rank FROM pairs)
SELECT query_id, rank, vec_id, round(sim, 6) AS similarity FROM r WHERE rank <= 10""")
def q_batch(spark, d):
    emb = fx.table(spark, d, "embeddings")
    firsts = emb.groupBy("label").agg(F.min("vec_id").alias("query_id"))
    queries = firsts.join(emb, firsts["query_id"] == emb["vec_id"]).select("query_id", "embedding")
    return se.semantic_search_batch(emb, queries, k=10, key="vec_id")


# -- hashing-encoder world over prepared logs ---------------------------------

def hash_vecs(spark, d):
    _, new = em.embed_incremental(prepared(spark, d), None, updated_at="2024-01-31 00:00:00")
    return new


HQV = (f"qv AS (SELECT embedding AS q FROM ({sp.hash_embed_from(f'(SELECT {sp.lit(QUERY_TEXT)} AS t) x', 't', 't')}) z)")
PREP_RES_COLS = "line_id AS id"


@query("hash_embed", W("""
SELECT normalized_message, representative_event_id, representative_level, occurrences,
 array_to_string(list_transform(list_filter(list_transform(embedding, lambda x, i: {'i': i - 1, 'x': x}),
   lambda p: p.x <> 0), lambda p: printf('%d:%.6f', p.i, p.x::DOUBLE)), ',') AS embedding
FROM hash_vecs""", "hash_vecs"))
def q_hash_embed(spark, d):
    """E2 over every distinct prepared message; the vector as sparse ``i:x`` text."""
    return hash_vecs(spark, d).drop("updated_at").withColumn(
        "embedding", vector_to_sparse_text(F.col("embedding"), 6))


def _prep_logs(spark, d):
    return prepared(spark, d).withColumn("id", F.col("line_id"))


PREP_LOGS = "(SELECT *, line_id AS id FROM prepared)"


@query("semantic_search_text", W(_semantic_sql(qv=HQV, vec_rel="hash_vecs", log_rel=PREP_LOGS),
                                 "hash_vecs", "prepared"))
def q_semantic_text(spark, d):
    return se.semantic_search(_prep_logs(spark, d), hash_vecs(spark, d), em.encode_query(QUERY_TEXT))


def _keyword_sql(q, level=None, top_k=20):
    lv = f" AND level = '{level}'" if level else ""
    return f"""
SELECT line_id AS id, line_id, log_timestamp, level, event_id, raw_message, event_template
FROM prepared WHERE raw_message ILIKE {sp.lit('%' + q + '%')}{lv}
ORDER BY log_timestamp NULLS LAST, line_id LIMIT {top_k}"""


@query("keyword_search", W(_keyword_sql(KEYWORD), "prepared"))
def q_keyword(spark, d):
    return se.keyword_search(_prep_logs(spark, d), KEYWORD)


@query("keyword_search_level", W(_keyword_sql("preauth", "WARNING"), "prepared"))
def q_keyword_level(spark, d):
    return se.keyword_search(_prep_logs(spark, d), "preauth", level="WARNING")


@query("compare_search", W(f"""
SELECT *, 'semantic' AS method FROM ({_semantic_sql(qv=HQV.replace(sp.lit(QUERY_TEXT), sp.lit(KEYWORD)),
                                                    vec_rel='hash_vecs', log_rel=PREP_LOGS)}) a
UNION ALL
SELECT *, CAST(NULL AS DOUBLE) AS similarity, 'keyword' AS method FROM ({_keyword_sql(KEYWORD)}) b""",
                           "hash_vecs", "prepared"))
def q_compare(spark, d):
    return se.compare_search(_prep_logs(spark, d), hash_vecs(spark, d), KEYWORD, em.encode_query(KEYWORD))


@query("messages_to_embed", W("""
SELECT normalized_message, min(event_id) AS representative_event_id, min(level) AS representative_level,
 count(*) AS occurrences FROM f_logs
WHERE normalized_message NOT IN (SELECT normalized_message FROM f_vecs)
GROUP BY normalized_message ORDER BY occurrences DESC, normalized_message""", "f_logs", "f_vecs"))
def q_to_embed(spark, d):
    return em.messages_to_embed(logs(spark, d), vecs(spark, d))


@query("embed_summary", W("""
SELECT count(*) AS distinct_texts, CAST(coalesce(sum(occurrences), 0) AS BIGINT) AS covered_logs
FROM hash_vecs""", "hash_vecs"))
def q_embed_summary(spark, d):
    return em.embed_summary(hash_vecs(spark, d))


@query("embed_incremental", W("""
SELECT normalized_message, representative_event_id, representative_level, occurrences,
 array_to_string(list_transform(list_filter(list_transform(embedding, lambda x, i: {'i': i - 1, 'x': x}),
   lambda p: p.x <> 0), lambda p: printf('%d:%.6f', p.i, p.x::DOUBLE)), ',') AS embedding,
 TIMESTAMP '2024-01-31 00:00:00' AS updated_at
FROM hash_vecs""", "hash_vecs"))
def q_embed_incremental(spark, d):
    """E1 twice: the second run finds nothing new, so every row keeps its first time."""
    entries = prepared(spark, d)
    path = scratch_path(spark, "embedded")
    em.embed_stored(spark, path, entries, updated_at="2024-01-31 00:00:00", buckets=16)
    table2, _ = em.embed_stored(spark, path, entries, updated_at="2024-02-01 00:00:00", buckets=16)
    return table2.withColumn("embedding", vector_to_sparse_text(F.col("embedding"), 6))


@query("semantic_search_1000", W(_semantic_sql(top_k=1000), "f_vecs", "f_logs"))
def q_semantic_1000(spark, d):
    """K1 with a large k."""
    return se.semantic_search(search_logs(spark, d), vecs(spark, d), query_vec(spark, d), top_k=1000)


@query("keyword_search_1000", W(_keyword_sql(KEYWORD, top_k=1000), "prepared"))
def q_keyword_1000(spark, d):
    """K2 with a large k."""
    return se.keyword_search(_prep_logs(spark, d), KEYWORD, top_k=1000)


@query("semantic_search_blocks", f"""
SELECT q.vec_id AS query_id, r.rank, r.vec_id, r.similarity FROM embeddings q, LATERAL (
 SELECT vec_id, round(s, 6) AS similarity, row_number() OVER (ORDER BY round(1 - s, 9), vec_id) AS rank
 FROM (SELECT e.vec_id, {sp.cosine("e.embedding", "q.embedding")} AS s FROM embeddings e WHERE e.embedding IS NOT NULL) c
 ORDER BY round(1 - s, 9), vec_id LIMIT 5) r WHERE q.label IN (1, 2, 3)""")
def q_batch_blocks(spark, d):
    """K9 with the queries of three labels, in blocks smaller than their number."""
    emb = fx.table(spark, d, "embeddings")
    queries = emb.filter("label IN (1, 2, 3)").select(F.col("vec_id").alias("query_id"), "embedding")
    return se.semantic_search_batch(emb, queries, k=5, query_block=16, corpus_block=128)

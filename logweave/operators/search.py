"""Semantic, keyword, neighbour and batch searches.

Corpus-side work is one scan of the vectors with a per-task top-N
(TakeOrderedAndProject).  Up to ``PUSHED`` matched messages then go to the log
scan as literals: on a store written by ``sources.parquet.write_search_store``
only the row groups and pages that hold them are read.  More of them are
joined without a hint, so their measured size decides between broadcast and
shuffle.  Query vectors are literals, as a bound SQL parameter would be.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.config import DEFAULT
from logweave.functions.vector import RANK_DECIMALS, cosine_to_query, rank_key
from logweave.operators.analytics import filter_level

RESULT_COLUMNS = ["id", "line_id", "log_timestamp", "level", "event_id", "raw_message", "event_template"]
QUERY_BLOCK = 512  # queries that one task of the batch search holds
CORPUS_BLOCK = 50_000  # vectors that one task of the batch search holds
LEAST_QUERIES, LEAST_VECTORS = 2048, 20_000  # smaller blocks are sent too often
CELLS = 1 << 20  # similarities that one task holds at a time
PUSHED = 512  # matched messages that go to the log scan as literals


def _check_k(top_k: int) -> int:
    if int(top_k) < 1:
        raise ValueError("top_k must be at least 1")
    return int(top_k)


def _with_id(logs: DataFrame) -> DataFrame:
    return logs if "id" in logs.columns else logs.withColumn("id", F.col("line_id"))


def nearest_messages(vecs: DataFrame, query: Sequence[float], n: int) -> DataFrame:
    """Top-``n`` messages by cosine distance (one scan, per-task top-n)."""
    sim = cosine_to_query(F.col("embedding"), query)
    return (
        vecs.filter(F.col("embedding").isNotNull())
        .select("normalized_message", sim.alias("similarity"), (1 - sim).alias("distance"))
        .orderBy(rank_key(F.col("distance")).asc_nulls_last(), F.col("normalized_message"))
        .limit(n)
    )


def hit_order() -> list:
    """(distance, time NULLS LAST, line) — the reference's result order."""
    return [
        rank_key(F.col("distance")).asc_nulls_last(),
        F.col("log_timestamp").asc_nulls_last(),
        F.col("line_id"),
    ]


def rows_of_messages(logs: DataFrame, matches: DataFrame, n: int) -> DataFrame:
    """Log rows of the matched messages (at most ``n``, with similarity and distance)."""
    if n > PUSHED:
        return _with_id(logs).join(matches, "normalized_message")
    found = matches.select("normalized_message", "similarity", "distance").collect()
    return _rows_of(logs, [tuple(r) for r in found])


def _rows_of(logs: DataFrame, found: list[tuple]) -> DataFrame:
    """Log rows of a short list of (message, similarity, distance): looked up by literals, without a join."""
    messages = [m for m, _, _ in found]
    asked = _with_id(logs).filter(F.col("normalized_message").isin(messages))
    place = F.array_position(F.array(*[F.lit(m) for m in messages]) if found else F.array().cast("array<string>"), F.col("normalized_message"))
    of = lambda values: F.get(F.array(*[F.lit(v).cast("double") for v in values]) if found else F.array().cast("array<double>"), F.col("_place") - 1)
    asked = asked.withColumn("_place", place.cast("int"))
    return asked.withColumns({"similarity": of([x for _, x, _ in found]), "distance": of([x for _, _, x in found])}).drop("_place")


def _hits(matches: DataFrame, logs: DataFrame, n: int, top_k: int, level: str | None,
          exclude_id: int | None = None) -> DataFrame:
    """Top-k log rows of the ``n`` matched messages, with the raw distance kept."""
    hits = rows_of_messages(logs, matches, n)
    hits = filter_level(hits, level)  # after the cut, as in the reference
    if exclude_id is not None:
        hits = hits.filter(F.col("id") != F.lit(exclude_id))
    return hits.orderBy(*hit_order()).limit(top_k)


def _ranked_hits(vecs: DataFrame, query: Sequence[float], logs: DataFrame, top_k: int, overfetch: int,
                 level: str | None, exclude_id: int | None = None) -> DataFrame:
    n = max(top_k, overfetch)
    return _hits(nearest_messages(vecs, query, n), logs, n, top_k, level, exclude_id).select(
        *RESULT_COLUMNS, F.round("similarity", 6).alias("similarity")
    )


def semantic_search(logs: DataFrame, vecs: DataFrame, query: Sequence[float],
                    top_k: int = DEFAULT.search_top_k, level: str | None = None,
                    overfetch: int = DEFAULT.semantic_overfetch) -> DataFrame:
    """K1: nearest ``max(top_k, overfetch)`` messages -> their log rows ->
    optional level filter -> first ``top_k`` by (distance, time NULLS LAST,
    line).  The level filter runs after the cut, so fewer than ``top_k``
    rows can come back (reference semantics)."""
    top_k = _check_k(top_k)
    return _ranked_hits(vecs, query, logs, top_k, overfetch, level)


def message_vector(logs: DataFrame, vecs: DataFrame, log_id: int) -> list[float] | None:
    """The vector of one log row's message: two look-ups by literal, the row's message and its vector."""
    row = _with_id(logs).filter(F.col("id") == F.lit(log_id)).select("normalized_message").first()
    if row is None or row[0] is None:
        return None
    own = vecs.filter(F.col("normalized_message") == F.lit(row[0])).select("embedding").first()
    return None if own is None or own[0] is None else [float(x) for x in own[0]]


def similar_logs(logs: DataFrame, vecs: DataFrame, log_id: int,
                 top_k: int = DEFAULT.search_top_k,
                 overfetch: int = DEFAULT.semantic_overfetch) -> DataFrame:
    """K3: neighbours of a log row's message, excluding that row only
    (other rows with the same message stay); unknown id -> empty."""
    top_k = _check_k(top_k)
    if int(log_id) < 1:
        raise ValueError("log_id must be >= 1")
    vec = message_vector(logs, vecs, log_id)
    if vec is None:
        empty = _with_id(logs).limit(0)
        return empty.select(*RESULT_COLUMNS, F.lit(None).cast("double").alias("similarity"))
    return _ranked_hits(vecs, vec, logs, top_k, overfetch, None, exclude_id=log_id)


def like_pattern(query: str) -> str:
    """``%query%`` with the query's own ``%``/``_`` left live.  A backslash
    before any other character escapes it to itself (PostgreSQL's rule);
    Spark only accepts escapes of ``%``, ``_`` and ``\\``."""
    fixed = re.sub(r"\\(.)", lambda m: m.group(0) if m.group(1) in "%_\\" else m.group(1), query)
    return f"%{fixed}%"


def keyword_search(logs: DataFrame, query: str, top_k: int = DEFAULT.search_top_k,
                   level: str | None = None) -> DataFrame:
    """K2: case-insensitive substring match, oldest first (NULL times last)."""
    top_k = _check_k(top_k)
    if not query:
        raise ValueError("query must not be empty")
    rows = _with_id(logs).filter(F.col("raw_message").ilike(like_pattern(query)))
    rows = filter_level(rows, level)
    return (
        rows.orderBy(F.col("log_timestamp").asc_nulls_last(), F.col("line_id"))
        .limit(top_k)
        .select(*RESULT_COLUMNS)
    )


def compare_search(logs: DataFrame, vecs: DataFrame, query_text: str, query_vec: Sequence[float],
                   top_k: int = DEFAULT.search_top_k, level: str | None = None) -> DataFrame:
    """Semantic and keyword hits side by side, tagged by ``method``."""
    sem = semantic_search(logs, vecs, query_vec, top_k, level).withColumn("method", F.lit("semantic"))
    kw = keyword_search(logs, query_text, top_k, level).withColumn("method", F.lit("keyword"))
    return sem.unionByName(kw, allowMissingColumns=True)


def semantic_event_ids(logs: DataFrame, vecs: DataFrame, query: Sequence[float],
                       top_k: int = DEFAULT.semantic_event_ids_top_k,
                       max_events: int = DEFAULT.semantic_event_ids_max) -> DataFrame:
    """First ``max_events`` distinct non-empty event ids in rank order of
    a semantic result (``top_k`` rows, ranked in one small window)."""
    top_k = _check_k(top_k)
    n = max(top_k, DEFAULT.semantic_overfetch)
    hits = _hits(nearest_messages(vecs, query, n), logs, n, top_k, None)
    w = Window.orderBy(*hit_order())  # a global window over top_k rows
    ranked = hits.withColumn("rank", F.row_number().over(w).cast("long"))
    return (
        ranked.filter(F.col("event_id").isNotNull() & (F.col("event_id") != ""))
        .groupBy("event_id").agg(F.min("rank").alias("first_rank"))
        .orderBy("first_rank")
        .limit(max_events)
    )


def knn_documents(logs: DataFrame, vecs: DataFrame, query: Sequence[float],
                  top_k: int = DEFAULT.search_top_k, level: str | None = None) -> DataFrame:
    """K5: k nearest *log rows* (each row scored by its message vector),
    level as a post-filter, vector dropped, score = cosine similarity.

    Exact without joining every log row to its vector: the k best rows come
    from the k best messages that have a row.  The nearest messages are looked
    up in the logs, more of them each time, until k of them have rows; only
    past ``PUSHED`` messages are the logs reduced to one row per message.
    """
    top_k = _check_k(top_k)
    logs = _with_id(logs)
    n = 2 * top_k
    while True:
        if n > PUSHED:
            present = logs.groupBy("normalized_message").agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")
            rows = logs.join(nearest_messages(vecs.join(present, "normalized_message", "left_semi"), query, top_k), "normalized_message")
            break
        found = [tuple(r) for r in nearest_messages(vecs, query, n).select("normalized_message", "similarity", "distance").collect()]
        rows = _rows_of(logs, found)
        if len(found) < n or rows.select("normalized_message").distinct().count() >= top_k:
            break
        n *= 4
    top = rows.orderBy(rank_key(F.col("distance")).asc_nulls_last(), F.col("line_id")).limit(top_k)
    top = filter_level(top, level)
    keep = [c for c in logs.columns if c != "embedding"]
    return top.select(*keep, F.round("similarity", 6).alias("similarity"))


# -- K9: batch search -----------------------------------------------------------

def _matrix(values: pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of vectors as doubles; NaN for a missing vector."""
    column = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    there = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.unique(pc.list_value_length(column).drop_null().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError("vectors of one search must have one length")
    out = np.full((len(column), int(sizes[0]) if len(sizes) else 0), np.nan)
    out[there] = column.flatten().to_numpy(zero_copy_only=False).reshape(int(there.sum()), out.shape[1])
    return out


def _best_of(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best of each row by rounded distance, then id; missing similarities (-inf) last."""
    t, n = sims.shape
    k = min(k, n)
    # the k-th best of the maxima of groups of columns is no better than the k-th best of all
    groups = max(k, n // 32)
    most = sims[:, : n // groups * groups].reshape(t, -1, groups).max(axis=1)
    kth = np.partition(most, groups - k, axis=1)[:, groups - k]
    # distances that round to that of the k-th compete by id
    rows, cols = np.nonzero(sims >= (kth - 2 * 10.0**-RANK_DECIMALS)[:, None])
    dist = np.round(1.0 - sims[rows, cols], RANK_DECIMALS)
    order = np.lexsort((ids[cols], dist, rows))
    rows, cols = rows[order], cols[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, np.arange(t))[rows] < k
    return rows[kept], cols[kept]


def _block_topk(k: int, key: str):
    """Scorer of one block of vectors against one block of queries: the k best of each query."""

    def run(pair, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), (key, pa.int64()), ("similarity", pa.float64()), ("part", pa.int64())])
        if not len(vectors) or not len(queries):
            return schema.empty_table()
        q, m = _matrix(queries["vector"]), _matrix(vectors["embedding"])
        if not q.shape[1]:  # no query has a vector
            q = np.full((len(q), m.shape[1]), np.nan)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        norm = np.sqrt(np.einsum("ij,ij->i", m, m))
        norm[norm == 0] = np.nan
        m /= norm[:, None]
        keys, asked = vectors[key].combine_chunks().cast(pa.int64()), queries["query_id"].combine_chunks().cast(pa.int64())
        ids = keys.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        step, out = max(1, CELLS // len(m)), []
        for at in range(0, len(q), step):
            sims = q[at : at + step] @ m.T
            sims[np.isnan(sims)] = -np.inf
            rows, cols = _best_of(sims, ids, k)
            found = sims[rows, cols]
            columns = [asked.take(pa.array(rows + at)), keys.take(pa.array(cols)), pa.array(found, mask=np.isinf(found)), pa.array(np.full(len(rows), pair[0].as_py()), pa.int64())]
            out.append(pa.Table.from_arrays(columns, schema=schema))
        return pa.concat_tables(out)

    return run


def semantic_search_batch(vecs: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id",
                          query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """K9: top-``k`` neighbours for any number of query vectors.

    Queries and vectors are dealt into blocks by hash; each pair of blocks is
    one cogrouped task that keeps the k best of each query, so no pair table
    is formed and nothing passes through the driver but two counts.  Every
    block of queries is sent to each block of vectors, so the copies grow with
    the number of blocks: sizes under ``LEAST_QUERIES`` and ``LEAST_VECTORS``
    are raised to these.  A task scores ``CELLS`` pairs at a time.  The
    results merge by query and a part of the corpus, then by query.  A query
    without a vector has the least keys, without a similarity.
    """
    vecs = vecs.filter(F.col("embedding").isNotNull()).select(key, "embedding")
    queries = queries.select("query_id", F.col("embedding").alias("vector"))
    n_q = _blocks_of(queries.count(), query_block, LEAST_QUERIES)
    n_c = _blocks_of(vecs.count(), corpus_block, LEAST_VECTORS)

    def dealt(df: DataFrame, by: str, own: int, other: int, names: tuple[str, str]) -> DataFrame:
        block = F.pmod(F.xxhash64(by), F.lit(own))
        placed = df.withColumn(names[0], block).withColumn(
            names[1], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))))
        # with a number: merged by their size, few tasks would score all pairs
        return placed.repartition(min(2 * n_q * n_c, 2000), "_c", "_q")

    left = dealt(vecs, key, n_c, n_q, ("_c", "_q"))
    right = dealt(queries, "query_id", n_q, n_c, ("_q", "_c"))
    found = left.groupBy("_c", "_q").cogroup(right.groupBy("_c", "_q")).applyInArrow(
        _block_topk(k, key), f"query_id long, {key} long, similarity double, part long")
    order = [F.round(1 - F.col("similarity"), 9).asc_nulls_last(), F.col(key)]
    w1 = Window.partitionBy("query_id", F.pmod("part", F.lit(64))).orderBy(*order)
    stage1 = found.withColumn("r", F.row_number().over(w1)).filter(F.col("r") <= k).drop("r")
    w2 = Window.partitionBy("query_id").orderBy(*order)
    return (
        stage1.withColumn("rank", F.row_number().over(w2).cast("long"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", key, F.round("similarity", 6).alias("similarity"))
    )


def _blocks_of(n: int, block: int, least: int) -> int:
    """Number of blocks of ``n`` rows."""
    return max(1, -(-n // max(block, least)))

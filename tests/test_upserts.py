"""Bucketed upserts leave other files alone; compressed cells keep their recall."""

import os

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from logweave.operators import ann
from logweave.operators import embed as em
from logweave.operators import search as se
from logweave.session import scratch_path
from logweave.sources import bucketed as bk
from logweave.sources import tables as tb


def files(path):
    return {os.path.join(top, f): os.stat(os.path.join(top, f)).st_mtime_ns for top, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upsert_rewrites_the_buckets_of_changed_keys(spark):
    path = scratch_path(spark, "bucketed")
    bk.upsert_bucketed(spark, path, spark.range(5_000).selectExpr("id", "'old' AS v"), "id", buckets=32)
    before = files(path)
    keys = [r.id for r in spark.range(5_000).filter(bk.bucket_of("id", 32).isin(3, 17)).limit(50).collect()]
    new = spark.createDataFrame([(k, "new") for k in keys], "id long, v string")
    after_table = bk.upsert_bucketed(spark, path, new, "id", buckets=32)
    after = files(path)
    kept = {f for f in before if before[f] == after.get(f)}
    assert len(kept) == len(before) - 2 and len(after) == len(before)
    rows = sorted(map(tuple, after_table.collect()))
    assert [v for _, v in rows].count("new") == 50 and len(rows) == 5_000
    # again, as after a lost job: the same table; without rows: no file is written
    assert sorted(map(tuple, bk.upsert_bucketed(spark, path, new, "id", buckets=32).collect())) == rows
    held = files(path)
    assert bk.upsert_bucketed(spark, path, new.limit(0), "id", buckets=32).count() == 5_000 and files(path) == held


def test_null_key_is_one_key(spark):
    path = scratch_path(spark, "null_key")
    for v in ("a", "b"):
        table = bk.upsert_bucketed(spark, path, spark.createDataFrame([(None, v), ("k", v)], "id string, v string"), "id", buckets=4)
    assert sorted(map(tuple, table.collect()), key=repr) == sorted([(None, "b"), ("k", "b")], key=repr)


def test_stored_index_equals_the_whole_upsert(spark):
    docs = spark.range(300).selectExpr("nullif(id, 7) AS id", "id % 5 AS version", "array(1.0D, id) AS embedding", "concat('d', id) AS text")
    more = docs.withColumn("version", F.lit(9)).filter("id % 3 = 0").unionByName(docs.filter("id = 4").withColumn("embedding", F.array(F.lit(1.0))))
    path = scratch_path(spark, "index")
    tb.upsert_index(spark, path, docs, "id", 2, "version", buckets=8)
    got, counts = tb.upsert_index(spark, path, more, "id", 2, "version", buckets=8)
    first, _ = tb.upsert_documents(None, docs, "id", 2, "version")
    want, same = tb.upsert_documents(first, more, "id", 2, "version")
    assert got.select(*want.columns).exceptAll(want).isEmpty() and want.exceptAll(got.select(*want.columns)).isEmpty()
    assert counts.collect() == same.collect()


def test_large_buckets_are_written_by_many_tasks(spark, monkeypatch):
    """What a task sorts and writes doesn't grow with the table; documents are dealt by key before they are sorted."""
    monkeypatch.setattr(bk, "PART_ROWS", 50)
    path = scratch_path(spark, "large_buckets")
    bk.upsert_bucketed(spark, path, spark.range(4_000).selectExpr("id", "'old' AS v"), "id", buckets=4)
    sizes = [pq.read_metadata(f.removeprefix("file:")).num_rows for f in files(path.removeprefix("file:"))]
    assert sum(sizes) == 4_000 and max(sizes) <= 100 and len(sizes) >= 60
    table = bk.upsert_bucketed(spark, path, spark.range(10).selectExpr("id", "'new' AS v"), "id", buckets=4)
    assert sorted(map(tuple, table.collect())) == [(k, "new" if k < 10 else "old") for k in range(4_000)]
    docs = spark.range(50).selectExpr("id", "1 AS version", "array(1.0D, id) AS embedding")
    plan = tb.accepted_documents(docs, "id", 2, "version")[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max_by") < plan.index("Exchange") and plan.count("Exchange") == 1


def test_stored_embeddings_write_new_messages_alone(spark):
    logs = spark.range(400).selectExpr("concat('message ', id % 40) AS normalized_message", "'E' AS event_id", "'INFO' AS level")
    path = scratch_path(spark, "stored")
    table, new = em.embed_stored(spark, path, logs, dim=16, updated_at="2024-01-01 00:00:00", buckets=16)
    assert table.count() == 40 and new.count() == 40
    before = files(path)
    assert em.embed_stored(spark, path, logs, dim=16, buckets=16)[1].isEmpty() and files(path) == before
    table, new = em.embed_stored(spark, path, logs.limit(1).withColumn("normalized_message", F.lit("another")), dim=16, updated_at="2024-02-01 00:00:00", buckets=16)
    assert (table.count(), new.count()) == (41, 1)
    assert len([f for f in before if before[f] == files(path).get(f)]) >= len(before) - 1


def clustered(spark, n=600, dim=24):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, dim))
    rows = [(k, (centres[0 if k % 3 == 0 else k % 12] + 0.4 * rng.normal(size=dim)).tolist()) for k in range(n)]
    return spark.createDataFrame([*rows, (n, None)], "vec_id long, embedding array<double>")


def test_compressed_cells_keep_their_recall(spark, monkeypatch):
    """A third of the vectors lie around one centre; blocks of any size give the same rows."""
    vecs = clustered(spark)
    idx = ann.open_index(spark, ann.build(vecs, scratch_path(spark, "ann"), n_cells=8, key="vec_id").path)
    ann.compress(spark, idx, subspaces=6, codewords=32)
    asked = vecs.filter("vec_id % 20 = 0 OR embedding IS NULL").withColumnRenamed("vec_id", "query_id")
    exact = se.semantic_search_batch(vecs, asked.filter("embedding IS NOT NULL"), k=20)
    found = ann.search_many(spark, idx, asked, k=20, nprobe=4).collect()
    row = ann.recall_many(spark.createDataFrame(found), exact, "vec_id").first()
    assert row.n_queries == 30 and row.recall >= 0.9
    monkeypatch.setattr(ann, "CODE_BLOCK", 40)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 5)
    again = ann.search_many(spark, idx, asked, k=20, nprobe=4).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    whole = ann.search_many(spark, idx, asked, k=3, nprobe=8, rerank=200).select("query_id", "rank", "vec_id")
    assert sorted(map(tuple, whole.collect())) == sorted((r.query_id, r["rank"], r.vec_id) for r in exact.filter("rank <= 3").collect())


def test_probed_cells_of_many_queries_come_in_pieces():
    rng = np.random.default_rng(6)
    cents, m = rng.normal(size=(9, 5)), rng.normal(size=(1_000, 5))
    pieces = list(ann._probes(cents, 4)([pd.DataFrame({"query_id": range(1_000), "embedding": list(m)})]))
    assert max(map(len, pieces)) <= 4 * ann.QUERY_BLOCK and len(pieces) == 4
    rows = pd.concat(pieces)
    want = np.argsort(-(m / np.linalg.norm(m, axis=1, keepdims=True) @ cents.T), axis=1)[:, :4]
    assert rows["cell"].tolist() == want.reshape(-1).tolist() and rows["query_id"].tolist() == np.repeat(range(1_000), 4).tolist()

"""Invariants and brute-force checks for the non-SQL operators."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from logweave import fixtures as fx
from logweave.operators import analytics as an
from logweave.operators import ann
from logweave.operators import anomaly
from logweave.operators import embed as em
from logweave.operators import search as se
from logweave.session import scratch_path
from logweave.sources import lines as ln
from tests.conftest import SF_SMALL


def f_logs(spark):
    return fx.fixture(spark, SF_SMALL, "f_logs")


def f_vecs(spark):
    return fx.fixture(spark, SF_SMALL, "f_vecs")


def qvec(spark):
    return [float(x) for x in f_vecs(spark).filter("vec_id = 7").first()["embedding"]]


def test_level_filter_is_a_post_filter(spark):
    full = se.semantic_search(f_logs(spark), f_vecs(spark), qvec(spark), 20).collect()
    err = se.semantic_search(f_logs(spark), f_vecs(spark), qvec(spark), 20, level="ERROR").collect()
    assert len(err) <= 20 and all(r.level == "ERROR" for r in err)
    sims = [r.similarity for r in full]
    assert sims == sorted(sims, reverse=True) and all(-1 <= s <= 1 for s in sims)


def test_level_counts_sum_to_total(spark):
    logs = f_logs(spark)
    assert sum(r["count"] for r in an.level_distribution(logs).collect()) == logs.count()


def test_similar_logs_unknown_id_is_empty(spark):
    assert se.similar_logs(f_logs(spark), f_vecs(spark), log_id=10 ** 9).count() == 0


def test_knn_documents_brute_force(spark):
    logs, vecs, q = f_logs(spark), f_vecs(spark), qvec(spark)
    got = [r.line_id for r in se.knn_documents(logs, vecs, q, 15).collect()]
    lp = logs.select("line_id", "normalized_message").toPandas()
    vp = vecs.select("normalized_message", "embedding").toPandas()
    m = np.stack(vp["embedding"].to_numpy()).astype(np.float64)
    qa = np.asarray(q)
    sim = dict(zip(vp["normalized_message"], m @ qa / (np.linalg.norm(m, axis=1) * np.linalg.norm(qa))))
    lp["d"] = [round(1 - sim[x], 9) if x in sim else None for x in lp["normalized_message"]]
    want = lp.dropna().sort_values(["d", "line_id"]).head(15)["line_id"].tolist()
    assert got == want


def test_batch_search_brute_force(spark):
    emb = fx.table(spark, SF_SMALL, "embeddings")
    queries = emb.filter(F.col("label") == 3).select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.rank): r.vec_id for r in se.semantic_search_batch(emb, queries, k=5).collect()}
    pdf = emb.toPandas()
    m = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    mn = m / np.linalg.norm(m, axis=1, keepdims=True)
    ids = pdf["vec_id"].to_numpy()
    for qi in pdf.index[pdf["label"] == 3]:
        d = np.round(1 - mn @ mn[qi], 9)
        order = np.lexsort((ids, d))[:5]
        for rank, j in enumerate(order, 1):
            assert got[(int(ids[qi]), rank)] == int(ids[j])


def test_embedding_twice_is_noop(spark):
    logs = f_logs(spark)
    table, new = em.embed_incremental(logs, None, dim=32, updated_at="2024-01-01 00:00:00")
    table = table.checkpoint(eager=True)
    _, new2 = em.embed_incremental(logs, table, dim=32)
    assert new.count() == logs.select("normalized_message").distinct().count()
    assert new2.count() == 0


def test_encode_query_matches_spark_encoder(spark):
    text = "Failed password for invalid user <*> from <*> port <*> ssh2"
    df = em.encode(spark.createDataFrame([(text,)], "normalized_message string"), dim=64)
    assert [float(x) for x in df.first()["embedding"]] == em.encode_query(text, 64)


def test_numbered_lines_follow_file_order(spark):
    lines = fx.fixture(spark, SF_SMALL, "f_lines").select("line_id", "raw_line")
    path = scratch_path(spark, "lines_test")
    lines.repartition(3).orderBy("line_id").select("raw_line").write.text(path)
    got = ln.read_numbered_lines(spark, path).orderBy("line_id").collect()
    want = lines.orderBy("line_id").collect()
    assert [(r.line_id, r.raw_line) for r in got] == [(r.line_id, r.raw_line) for r in want]


def test_ann_full_probe_is_exact(spark):
    vecs, q = f_vecs(spark), qvec(spark)
    idx = ann.build(vecs, scratch_path(spark, "ann_test"), n_cells=8)
    exact = se.nearest_messages(vecs, q, 20)
    assert ann.recall_at_k(ann.search(spark, idx, q, 20, nprobe=8), exact, "normalized_message") == 1.0


def test_forest_flags_contamination_and_planted_outliers(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(400, 8)) * 0.1
    far = rng.normal(size=(5, 8)) * 0.1 + 5.0
    rows = [(f"n{i}", [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(f"out{i}", [float(x) for x in v]) for i, v in enumerate(far)]
    df = spark.createDataFrame(rows, "normalized_message string, embedding array<float>")
    model = anomaly.train(df, n_trees=50, max_samples=128, contamination=0.05)
    scores = anomaly.score(df, model).toPandas().sort_values("raw_score")
    assert set(scores.head(5)["normalized_message"]) == {f"out{i}" for i in range(5)}
    share = scores["is_anomaly"].mean()
    assert scores["is_anomaly"].sum() == int(404 * 0.05) + 1 and share < 0.06
    again = anomaly.score(df, anomaly.train(df, n_trees=50, max_samples=128)).toPandas()
    assert np.allclose(scores.sort_values("normalized_message")["raw_score"].to_numpy(),
                       again.sort_values("normalized_message")["raw_score"].to_numpy())


def test_stream_timeline_equals_batch(spark):
    q = entry.queries()
    s = {(r.bucket, r["count"]) for r in q["stream_timeline"](spark, SF_SMALL).collect()}
    b = {(r.bucket, r["count"]) for r in q["timeline_hour"](spark, SF_SMALL).collect()}
    assert s == b


def test_forest_save_and_load(spark):
    vecs = f_vecs(spark)
    model = anomaly.train(vecs, n_trees=10, max_samples=64)
    path = anomaly.save(model, scratch_path(spark, "forest"))
    again = anomaly.load(spark, path)
    a = anomaly.score(vecs, model).orderBy("normalized_message").collect()
    b = anomaly.score(vecs, again).orderBy("normalized_message").collect()
    assert [r.raw_score for r in a] == [r.raw_score for r in b]


def test_contract_imports_without_spark():
    import subprocess
    import sys

    code = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120,
                         cwd=__import__("os").path.dirname(__import__("os").path.dirname(__file__)))
    assert out.returncode == 0, out.stderr


def test_ann_finds_planted_near_copies(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(600, 16))
    q = rng.normal(size=16)
    near = q + rng.normal(size=(10, 16)) * 0.01
    rows = [(f"b{i}", [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(f"near{i}", [float(x) for x in v]) for i, v in enumerate(near)]
    vecs = spark.createDataFrame(rows, "normalized_message string, embedding array<float>")
    idx = ann.build(vecs, scratch_path(spark, "ann_planted"), n_cells=12)
    got = {r.normalized_message for r in ann.search(spark, idx, list(q), k=10, nprobe=2).collect()}
    assert len(got & {f"near{i}" for i in range(10)}) >= 9


def test_covered_logs_equal_embedded_rows(spark):
    logs = f_logs(spark)
    table, new = em.embed_incremental(logs, None, dim=16, updated_at="2024-01-01 00:00:00")
    covered = em.embed_summary(new).first()["covered_logs"]
    assert covered == an.embedded_log_count(logs, table).first()["embedded_logs"] == logs.count()


def test_encode_with_model_hook(spark):
    df = spark.createDataFrame([("a b",), ("ccc",), (None,)], "normalized_message string")

    def model(texts):
        return [[float(len(t)), 1.0] for t in texts]

    out = {r.normalized_message: list(r.embedding) for r in em.encode_with(df, model).collect()}
    assert out == {"a b": [3.0, 1.0], "ccc": [3.0, 1.0], None: [0.0, 1.0]}
    assert df.columns == ["normalized_message"]


def test_batch_search_without_queries_is_empty(spark):
    emb = fx.table(spark, SF_SMALL, "embeddings")
    none = emb.filter(F.lit(False)).select(F.col("vec_id").alias("query_id"), "embedding")
    out = se.semantic_search_batch(emb, none, k=3)
    assert out.count() == 0 and out.columns == ["query_id", "rank", "vec_id", "similarity"]


def test_batch_search_sends_small_blocks_together(spark, monkeypatch):
    """Copies of queries and vectors don't grow with the square of the table; any dealing gives the same rows."""
    rng = np.random.default_rng(5)
    m = np.round(rng.normal(size=(90, 4)), 1).astype(np.float32)
    m[40:70] = m[3]  # equal vectors rank by id
    m[7] = 0
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(90, None)]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vecs.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    assert se._blocks_of(30_000, 16, se.LEAST_QUERIES) * 100_000 <= 2_000_000 and se._blocks_of(0, 16, 4) == 1
    pairs = se.semantic_search_batch(vecs, queries, k=5, query_block=1, corpus_block=1)
    assert "FlatMapCoGroups" in pairs._jdf.queryExecution().executedPlan().toString()
    norm = np.linalg.norm(m.astype(float), axis=1)
    want = set()
    for q in [k for k, _ in rows if k % 3 == 0]:
        with np.errstate(invalid="ignore", divide="ignore"):
            s = m.astype(float) @ m[q].astype(float) / (norm * max(norm[q], 1e-300)) if q < 90 else np.full(90, np.nan)
        order = np.lexsort((np.arange(90), np.round(1 - s, 9)))[:5]
        want |= {(q, r + 1, int(v), None if np.isnan(s[v]) else round(float(s[v]), 6)) for r, v in enumerate(order)}
    assert {tuple(r) for r in pairs.collect()} == want
    monkeypatch.setattr(se, "LEAST_QUERIES", 7)
    monkeypatch.setattr(se, "LEAST_VECTORS", 11)
    assert {tuple(r) for r in se.semantic_search_batch(vecs, queries, k=5, query_block=1, corpus_block=1).collect()} == want


def test_append_timeline_drops_rows_behind_the_watermark(spark):
    import datetime as dt

    from logweave.streaming import jobs as st

    src = scratch_path(spark, "late_src")
    schema = "log_timestamp timestamp_ntz, level string"
    first = [(dt.datetime(2024, 1, 1, h, 5), "INFO") for h in range(0, 6)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(src + "/b1")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    out, ckpt = scratch_path(spark, "late_out"), scratch_path(spark, "late_ckpt")
    st.timeline(stream, out, ckpt, complete=False, watermark="1 hour")
    # a later batch: one row far behind the watermark (dropped), one new row
    late = [(dt.datetime(2024, 1, 1, 0, 30), "INFO"), (dt.datetime(2024, 1, 1, 9, 0), "INFO")]
    spark.createDataFrame(late, schema).coalesce(1).write.parquet(src + "/b2")
    st.timeline(stream, out, ckpt, complete=False, watermark="1 hour")
    got = {r.bucket: r["count"] for r in spark.read.parquet(out).collect()}
    assert got[dt.datetime(2024, 1, 1, 0, 0)] == 1  # the late 00:30 row did not count
    assert dt.datetime(2024, 1, 1, 9, 0) not in got  # still open: behind no watermark yet


def test_interpolated_percentile_equals_numpy(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=501), np.repeat([1.0, 2.0, 3.0], 40), np.array([5.0])):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        for share in (0.0, 0.05, 0.5, 0.973, 1.0):
            assert anomaly.interpolated_percentile(df, "v", share) == __import__("pytest").approx(np.percentile(values, 100 * share))


def test_forest_of_many_trees_is_scored_in_blocks(spark, monkeypatch):
    vecs = f_vecs(spark).limit(60)
    model = anomaly.train(vecs, n_trees=12, max_samples=16)
    whole = {r[0]: r[1] for r in anomaly.score_samples(vecs, model).collect()}
    model.release()
    monkeypatch.setattr(anomaly, "TREES_A_BLOCK", 5)
    blocks = {r[0]: r[1] for r in anomaly.score_samples(vecs, model).collect()}
    assert len(model.blocks()) == 3 and all(abs(whole[k] - blocks[k]) < 1e-12 for k in whole)


def test_large_limits_are_accepted(spark):
    assert se.semantic_search(f_logs(spark), f_vecs(spark), qvec(spark), top_k=201).count() == 201
    assert an.frequent_errors(f_logs(spark), limit=101).count() > 0


def test_index_opens_from_its_path(spark):
    path = ann.build(f_vecs(spark), scratch_path(spark, "ann_stored"), n_cells=6).path
    again = ann.open_index(spark, path)
    assert again.key == "normalized_message" and again.centroids.shape[0] == 6
    exact = se.nearest_messages(f_vecs(spark), qvec(spark), 10)
    assert ann.recall_at_k(ann.search(spark, again, qvec(spark), 10, nprobe=6), exact, "normalized_message") == 1.0


def entries_stream(spark, src, rows):
    schema = "event_id string, level string, normalized_message string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_stream_embedding_adds_up_recurring_messages(spark):
    from logweave.streaming import jobs as st

    src, table, ckpt = (scratch_path(spark, n) for n in ("emb_src", "emb_table", "emb_ckpt"))
    st.embed_stream(entries_stream(spark, src, [("E2", "INFO", "a"), ("E1", "INFO", "a"), (None, "INFO", "b")]), table, ckpt, dim=8)
    st.embed_stream(entries_stream(spark, src, [("E0", "ERROR", "a"), ("E9", "INFO", "c")]), table, ckpt, dim=8)
    got = {r.normalized_message: (r.occurrences, r.representative_event_id, r.representative_level, len(r.embedding)) for r in st.stored_embeddings(spark, table).collect()}
    assert got == {"a": (3, "E0", "ERROR", 8), "b": (1, None, "INFO", 8), "c": (1, "E9", "INFO", 8)}
    vectors = spark.read.parquet(table).filter("embedding IS NOT NULL")
    assert vectors.count() == 3  # each message has one vector


def test_replayed_alert_batch_changes_nothing(spark):
    from logweave.plans.q_anomaly import stored_model
    from logweave.streaming import jobs as st

    model = stored_model(spark)
    src, out = scratch_path(spark, "alert_src"), scratch_path(spark, "alert_out")
    f_vecs(spark).select("normalized_message", "embedding").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    for run in range(2):  # a new checkpoint runs batch 0 again
        st.alerts_stream(stream, model, out, scratch_path(spark, f"alert_ckpt{run}"))
    assert spark.read.parquet(out).count() == f_vecs(spark).count()


def test_search_store_skips_what_it_does_not_hold(spark):
    """Messages pushed as literals: the scan of a store clustered by message reads about their rows alone."""
    from logweave.session import scratch_path
    from logweave.sources.parquet import write_search_store

    logs = spark.range(60_000).selectExpr(
        "id", "id AS line_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS log_timestamp",
        "'INFO' AS level", "'E1' AS event_id", "concat('raw ', id) AS raw_message", "'t' AS event_template",
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('message ', id % 900) END AS normalized_message")
    path = write_search_store(logs, scratch_path(spark, "store"), files=4, row_group_bytes=128 << 10, page_rows=200)
    store = spark.read.parquet(path)
    assert store.count() == 60_000 and sorted(store.columns) == sorted(logs.columns)

    def scanned(df):
        df.collect()
        nodes = [df._jdf.queryExecution().executedPlan()]
        while nodes:
            node = nodes.pop()
            if "FileSourceScan" in node.getClass().getName():
                return node.metrics().apply("numOutputRows").value()
            if "AdaptiveSparkPlan" in node.getClass().getName():
                nodes.append(node.executedPlan())
                continue
            if "QueryStage" in node.getClass().getName():
                nodes.append(node.plan())
                continue
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        raise AssertionError("no scan")

    found = [(f"message {k}", 0.9 - k / 1000, 0.1 + k / 1000) for k in (1, 400, 899)]
    rows = se._rows_of(store, found)
    assert rows.count() == 200 and scanned(rows) <= 0.05 * 60_000
    assert scanned(se._with_id(store).filter(F.col("id") == 777)) <= 0.05 * 60_000
    want = {(r.id, round(r.similarity, 6)) for r in se._rows_of(logs, found).collect()}
    assert {(r.id, round(r.similarity, 6)) for r in rows.collect()} == want
    assert se._rows_of(store, []).count() == 0 and se._rows_of(store, [("hot", None, None)]).count() == 20_000
    many = spark.createDataFrame(found, "normalized_message string, similarity double, distance double")
    assert se.rows_of_messages(store, many, se.PUSHED + 1).count() == 200  # a long list is joined


def test_knn_documents_looks_further_until_rows_are_found(spark):
    """Nearest messages without rows don't count; the search goes on to those with rows."""
    vecs = spark.createDataFrame([(f"m{k}", [1.0, k / 100.0]) for k in range(300)], "normalized_message string, embedding array<double>")
    rows = [(k, k, f"m{270 + k % 20}") for k in range(1, 41)]
    logs = spark.createDataFrame(rows, "id long, line_id long, normalized_message string").selectExpr(
        "*", "cast(null AS timestamp_ntz) AS log_timestamp", "'INFO' AS level", "'e' AS event_id", "'r' AS raw_message", "'t' AS event_template")
    got = [r.line_id for r in se.knn_documents(logs, vecs, [1.0, 0.0], 5).collect()]
    assert got == [20, 40, 1, 21, 2]

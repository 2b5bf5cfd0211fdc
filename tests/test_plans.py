"""Physical-plan checks: pruning, pushdown, join strategies, no pair tables."""

from logweave import fixtures as fx
from logweave.operators import search as se
from logweave.operators.prepare import prepare_log_entries
from logweave.session import scratch_path
from logweave.sources import parquet as pq
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_level_filter_prunes_partitions(spark):
    lines = fx.fixture(spark, SF_SMALL, "f_lines")
    path = pq.write_log_entries(prepare_log_entries(lines, fx.fixture(spark, SF_SMALL, "f_struct")),
                                scratch_path(spark, "plan_logs"))
    p = plan(pq.read_log_entries(spark, path).filter("level = 'ERROR'").select("line_id"))
    assert "PartitionFilters: [isnotnull(level" in p and "ERROR" in p
    assert "ReadSchema: struct<line_id:bigint>" in p


def test_staged_tables_prune_and_push_down(spark):
    import __spark_entry__ as entry

    q = entry.queries()
    level = plan(q["filter_level"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(level)" in level and "ExistingRDD" not in level
    for name in ("timeline_event", "errors_last_24h", "keyword_search"):
        p = plan(q[name](spark, SF_SMALL))
        assert "FileScan parquet" in p and "ExistingRDD" not in p and "embedding" not in p.split("ReadSchema")[1].split("\n")[0]


def test_numbered_lines_never_shuffle_the_text(spark):
    from logweave.sources.lines import read_numbered_lines

    path = scratch_path(spark, "plan_text")
    fx.fixture(spark, SF_SMALL, "f_lines").select("raw_line").write.text(path)
    p = plan(read_numbered_lines(spark, path).filter("line_id > 3"))
    assert "BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p


def test_stats_scan_the_logs_once(spark):
    from logweave.operators.analytics import stats_overview

    logs = spark.read.schema("level string, event_id string, normalized_message string, log_timestamp timestamp_ntz").parquet(SF_SMALL + "/events.parquet")
    vecs = fx.fixture(spark, SF_SMALL, "f_vecs")
    text = stats_overview(logs, vecs)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("normalized_message#") and sum("Relation [level" in line for line in text.splitlines()) == 1


def test_semantic_search_broadcasts_bounded_matches(spark):
    logs, vecs = fx.fixture(spark, SF_SMALL, "f_logs"), fx.fixture(spark, SF_SMALL, "f_vecs")
    q = [float(x) for x in vecs.filter("vec_id = 7").first()["embedding"]]
    p = plan(se.semantic_search(logs, vecs, q, 20))
    assert "TakeOrderedAndProject" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_no_pair_tables_in_batch_search(spark):
    emb = fx.table(spark, SF_SMALL, "embeddings")
    queries = emb.filter("label = 1").selectExpr("vec_id AS query_id", "embedding")
    p = plan(se.semantic_search_batch(emb, queries, k=5))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p and "FlatMapCoGroups" in p


def test_no_registered_query_plans_a_cross_or_nested_loop_join(spark):
    import __spark_entry__ as entry

    offenders = []
    for name, build in sorted(entry.queries().items()):
        qe = build(spark, SF_SMALL)._jdf.queryExecution()
        text = qe.executedPlan().toString() + qe.optimizedPlan().toString()
        if any(k in text for k in ("CartesianProduct", "BroadcastNestedLoopJoin", "Join Cross")):
            offenders.append(name)
    assert offenders == []


def test_hot_message_is_pre_aggregated_before_shuffles(spark):
    from pyspark.sql import functions as F

    from logweave.operators import analytics as an
    from logweave.operators import embed as em

    n = 30_000
    logs = spark.range(n).select(
        F.col("id").alias("line_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot message")).otherwise(
            F.concat(F.lit("msg "), (F.col("id") % 997).cast("string"))).alias("normalized_message"),
        F.lit("E1").alias("event_id"), F.lit("ERROR").alias("level"),
    )
    vecs = spark.createDataFrame([("hot message",), ("msg 1",)], "normalized_message string")
    hot = n // 3
    msg1 = logs.filter("normalized_message = 'msg 1'").count()
    assert an.embedded_log_count(logs, vecs).first()["embedded_logs"] == hot + msg1
    top = an.distinct_messages(logs, limit=1).first()
    assert (top.normalized_message, top.occurrences) == ("hot message", hot)
    p = plan(em.messages_to_embed(logs, vecs))
    assert "partial_min" in p or "partial_count" in p  # map-side aggregation before the exchange


def test_line_limit_reaches_both_scans(spark):
    lines_path, struct_path = scratch_path(spark, "plan_lines"), scratch_path(spark, "plan_struct")
    fx.fixture(spark, SF_SMALL, "f_lines").select("line_id", "raw_line").write.parquet(lines_path)
    fx.fixture(spark, SF_SMALL, "f_struct").write.parquet(struct_path)
    df = prepare_log_entries(spark.read.parquet(lines_path), spark.read.parquet(struct_path), limit=100)
    p = plan(df)
    assert p.count("LessThanOrEqual(line_id,100)") >= 2
    assert df.count() == 100

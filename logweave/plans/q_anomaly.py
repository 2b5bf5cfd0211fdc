"""Anomaly, alert and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave import fixtures as fx
from logweave import schemas
from logweave.functions.severity import anomaly_probability, severity
from logweave.operators import alerts as al
from logweave.operators import anomaly as an
from logweave.operators import quality as qa
from logweave.plans import sqlparts as sp
from logweave.plans.q_core import prepared, vecs
from logweave.plans.registry import query
from logweave.session import scratch_path
from logweave.sources import tables as tb

W = sp.sql_with


def scored(spark, d):
    s = fx.fixture(spark, d, "f_scores")
    prob = anomaly_probability(F.col("raw_score"))
    return s.select(
        "event_id", "ts", F.col("event_type").alias("message"),
        (F.col("raw_score") < 0).alias("is_anomaly"),
        F.round(prob, 4).alias("anomaly_probability"),
        F.round("raw_score", 4).alias("raw_score"),
        severity(prob).alias("severity"),
    )


SCORED_SQL = """(SELECT event_id, ts, event_type AS message, raw_score < 0 AS is_anomaly,
 round(p, 4) AS anomaly_probability, round(raw_score, 4) AS raw_score,
 CASE WHEN p > 0.8 THEN 'critical' WHEN p > 0.65 THEN 'high' WHEN p > 0.5 THEN 'medium' ELSE 'low' END AS severity
 FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 - raw_score)) AS p FROM f_scores) s0) sc"""


@query("anomaly_severity", W(f"SELECT * FROM {SCORED_SQL}", "f_scores"))
def q_severity(spark, d):
    return scored(spark, d)


@query("recent_anomalies", W(f"""
SELECT event_id, ts, severity, anomaly_probability FROM {SCORED_SQL}
WHERE severity IN ('high', 'critical') ORDER BY ts DESC NULLS LAST, event_id LIMIT 50""", "f_scores"))
def q_recent(spark, d):
    return al.recent_anomalies(scored(spark, d)).select("event_id", "ts", "severity", "anomaly_probability")


ALERTS_SQL = f"""(SELECT 'Anomalous log detected — ' || upper(severity) AS title, severity, message,
 'unknown' AS source, ts AS "timestamp", anomaly_probability, raw_score FROM {SCORED_SQL}) al"""


@query("anomaly_alerts", W(f"SELECT * FROM {ALERTS_SQL}", "f_scores"))
def q_alerts(spark, d):
    return al.anomaly_alerts(scored(spark, d), ts=F.col("ts"))


@query("alert_filter", W(f"""
SELECT *, severity IN ('high', 'critical') AS dispatched,
 CASE WHEN severity IN ('high', 'critical') THEN NULL ELSE 'below threshold' END AS reason
FROM {ALERTS_SQL}""", "f_scores"))
def q_alert_filter(spark, d):
    return al.alert_gate(al.anomaly_alerts(scored(spark, d), ts=F.col("ts")), "high")


def _forest(spark, d):
    v = vecs(spark, d)
    return v, an.train(v)


@query("iforest_train", W("""
SELECT range AS tree, least(256, (SELECT count(*) FROM f_vecs WHERE embedding IS NOT NULL)) AS root_size,
 0::BIGINT AS uneven, true AS shallow FROM range(100)""", "f_vecs"))
def q_iforest_train(spark, d):
    """M1: the trees of a 100-tree forest over all driver vectors: rows at the root, inner nodes whose
    children don't add up to them (none), and whether the depth stays within its bound."""
    nodes = _forest(spark, d)[1].nodes
    child = nodes.select("tree", F.col("node").alias("child"), F.col("size").alias("child_size"))
    inner = nodes.filter("feature >= 0")
    sums = inner.select("tree", "node", "size", F.explode(F.array("left", "right")).alias("child")).join(
        child, ["tree", "child"]).groupBy("tree", "node", "size").agg(F.sum("child_size").alias("below"))
    uneven = sums.groupBy("tree").agg(F.sum((F.col("below") != F.col("size")).cast("long")).alias("uneven"))
    roots = nodes.groupBy("tree").agg(F.max(F.when(F.col("node") == 0, F.col("size"))).alias("root_size"),
                                      (F.max("depth") <= 8).alias("shallow"))
    return roots.join(uneven, "tree", "left").select("tree", "root_size", F.coalesce("uneven", F.lit(0)).alias("uneven"), "shallow")


#: A stored model of three stumps: tree t asks whether the t-th number of a vector is below 0.
STUMPS = 3


def stored_model(spark):
    """M6: the stumps, saved as a table and loaded again."""
    rows = [r for t in range(STUMPS) for r in ((t, 0, t, 0.0, 1, 2, 256, 0), (t, 1, -1, 0.0, -1, -1, 1, 1), (t, 2, -1, 0.0, -1, -1, 255, 1))]
    model = an.IsolationForestModel(spark.createDataFrame(rows, an.NODE_SCHEMA), 256, -0.5, STUMPS)
    return an.load(spark, an.save(model, scratch_path(spark, "stored_forest")))


_C = "(2.0::DOUBLE * (ln({n}::DOUBLE - 1) + 0.5772156649015329) - 2.0::DOUBLE * ({n} - 1) / {n})"
STORED_SQL = f"""(SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 - raw)) AS p FROM (
 SELECT normalized_message, 0.5 - pow(2.0::DOUBLE, -(({' + '.join(
    f"CASE WHEN embedding[{t + 1}] < 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE + {_C.format(n=255)} END" for t in range(STUMPS))}) / {STUMPS}.0) / {_C.format(n=256)}) AS raw
 FROM f_vecs WHERE embedding IS NOT NULL) s0) s1"""
SEVERITY_SQL = "CASE WHEN p > 0.8 THEN 'critical' WHEN p > 0.65 THEN 'high' WHEN p > 0.5 THEN 'medium' ELSE 'low' END"


@query("iforest_score", W(f"""
SELECT normalized_message, raw < 0 AS is_anomaly, round(p, 4) AS anomaly_probability, round(raw, 4) AS raw_score,
 {SEVERITY_SQL} AS severity FROM {STORED_SQL}""", "f_vecs"))
def q_iforest_score(spark, d):
    """M2/M3/M6: decision value, flag, probability and severity per vector by a stored and loaded model."""
    return an.score(vecs(spark, d), stored_model(spark))


@query("anomaly_summary", W("""
SELECT count(*) AS n_samples, CAST(floor((count(*) - 1) * 0.05) AS BIGINT) + 1 AS n_anomalies,
 0.05::DOUBLE AS contamination FROM f_vecs WHERE embedding IS NOT NULL""", "f_vecs"))
def q_anomaly_summary(spark, d):
    """A10: rows, and anomalies below the interpolated quantile of the scores."""
    v, model = _forest(spark, d)
    return an.summary(v, model).select("n_samples", "n_anomalies", "contamination")


@query("anomaly_summary_stored", W(f"""
SELECT count(*) AS n_samples, count(*) FILTER (raw < 0) AS n_anomalies, 0.05::DOUBLE AS contamination,
 round(avg(raw), 6) AS score_mean, round(stddev_pop(raw), 6) AS score_std FROM {STORED_SQL}""", "f_vecs"))
def q_anomaly_summary_stored(spark, d):
    """A10 of a stored model: all five columns, mean and population deviation of the decision values too."""
    s = an.summary(vecs(spark, d), stored_model(spark))
    return s.withColumns({c: F.round(c, 6) for c in ("score_mean", "score_std")})


# -- data quality ----------------------------------------------------------------

@query("dq_duplicates", W("SELECT line_id, CAST(2 AS BIGINT) AS n FROM prepared", "prepared"))
def q_dq_duplicates(spark, d):
    """Q1 after a reset load followed by an append of the same entries."""
    root = scratch_path(spark, "dq_tables")
    entries = prepared(spark, d)
    tb.load_processed(spark, entries, fx.fixture(spark, d, "f_templ"), root, reset=True)
    tb.load_table(tb.conform(entries, schemas.LOG_ENTRIES), f"{root}/log_entries", reset=False)
    return qa.duplicate_keys(spark.read.parquet(f"{root}/log_entries"), "line_id")


@query("dq_orphans", W("""
SELECT event_id, count(*) AS n_rows FROM prepared
WHERE event_id IS NOT NULL AND event_id NOT IN (SELECT event_id FROM f_templ) GROUP BY event_id""",
                       "prepared", "f_templ"))
def q_dq_orphans(spark, d):
    return qa.orphans(prepared(spark, d), fx.fixture(spark, d, "f_templ"))


DQ_COLS = list(schemas.REQUIRED_LOG_COLUMNS) + ["event_id", "event_template", "log_timestamp", "month"]


@query("dq_nulls", W("SELECT " + ", ".join(
    f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_{c}" for c in DQ_COLS)
    + " FROM prepared", "prepared"))
def q_dq_nulls(spark, d):
    return qa.null_counts(prepared(spark, d), DQ_COLS)


@query("dq_vector_dim", W("""
SELECT count(*) AS n_vectors, CAST(sum(CASE WHEN embedding IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null,
 CAST(sum(CASE WHEN embedding IS NOT NULL AND len(embedding) <> 64 THEN 1 ELSE 0 END) AS BIGINT) AS n_bad_dim
FROM f_vecs""", "f_vecs"))
def q_dq_vector_dim(spark, d):
    return qa.vector_check(vecs(spark, d), 64)


@query("dq_vector_dim_384", W("""
SELECT count(*) AS n_vectors, CAST(sum(CASE WHEN embedding IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null,
 CAST(sum(CASE WHEN embedding IS NOT NULL AND len(embedding) <> 384 THEN 1 ELSE 0 END) AS BIGINT) AS n_bad_dim
FROM f_vecs""", "f_vecs"))
def q_dq_vector_dim_384(spark, d):
    """Q4 against the reference's configured 384 dimensions: every driver vector (64) fails."""
    return qa.vector_check(vecs(spark, d), 384)


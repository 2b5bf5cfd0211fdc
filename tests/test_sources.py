"""Tables, index stats, ledger and schema utilities."""

import json

from logweave import schemas
from logweave.session import scratch_path
from logweave.sources import tables as tb


def test_index_stats_and_drop(spark):
    path = scratch_path(spark, "idx_test")
    missing = tb.index_stats(spark, path).first()
    assert missing.exists is False and missing.doc_count is None
    spark.range(25).selectExpr("id", "array(1.0f, 2.0f) AS embedding").write.parquet(path)
    st = tb.index_stats(spark, path).first()
    assert st.exists and st.doc_count == 25 and st.store_size_bytes > 0
    assert tb.drop_index(spark, path) is True
    assert tb.index_stats(spark, path).first().exists is False


def test_ledger_appends_json_details(spark):
    path = scratch_path(spark, "ledger_test")
    tb.record_run(spark, path, "prepare-data", "SUCCESS", {"log_rows": 3})
    rows = tb.record_run(spark, path, "embed", "FAILED", {"error": "x"}).collect()
    assert {(r.command, r.status) for r in rows} == {("prepare-data", "SUCCESS"), ("embed", "FAILED")}
    assert {json.dumps(json.loads(r.details), sort_keys=True) for r in rows} == {'{"log_rows": 3}', '{"error": "x"}'}


def test_empty_tables_have_declared_schemas(spark):
    root = scratch_path(spark, "schemas_test")
    paths = schemas.create_empty_tables(spark, root)
    for name, schema in schemas.TABLES.items():
        df = spark.read.parquet(paths[name])
        assert df.count() == 0 and [f.name for f in df.schema.fields] == [f.name for f in schema.fields]


def test_upsert_counts_errors(spark):
    docs = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [1.0])],
        "id long, embedding array<double>")
    index, counts = tb.upsert_documents(None, docs, "id", dim=2)
    c = counts.first()
    assert (c.indexed, c.errors) == (1, 3) and index.count() == 1
    again, _ = tb.upsert_documents(index, spark.createDataFrame([(1, [0.0, 1.0])], "id long, embedding array<double>"), "id", 2)
    assert [list(r.embedding) for r in again.collect()] == [[0.0, 1.0]]


def test_repeated_ids_leave_one_document(spark):
    schema = "id long, embedding array<double>, version int, source string"
    docs = spark.createDataFrame([(1, [1.0], 2, "new"), (1, [0.0], 1, "old"), (2, [3.0], None, "x")], schema)
    index, counts = tb.upsert_documents(None, docs, "id", dim=1, order_by="version")
    assert sorted((r.id, r.source) for r in index.collect()) == [(1, "new"), (2, "x")]
    assert tuple(counts.first()) == (3, 0)


def test_reset_empties_embeddings(spark):
    root = scratch_path(spark, "reset")
    schemas.create_empty_tables(spark, root)
    row = spark.createDataFrame([("m", None, "INFO", 1, [0.5], None)], schemas.MESSAGE_EMBEDDINGS.simpleString()[7:-1].replace(":", " ").replace(",", ", "))
    tb.load_table(tb.conform(row, schemas.MESSAGE_EMBEDDINGS), f"{root}/message_embeddings", reset=False)
    empty = {n: spark.createDataFrame([], schemas.TABLES[n]) for n in ("log_entries", "event_templates")}
    tb.load_processed(spark, empty["log_entries"], empty["event_templates"], root, reset=False)
    assert spark.read.parquet(f"{root}/message_embeddings").count() == 1
    tb.load_processed(spark, empty["log_entries"], empty["event_templates"], root, reset=True)
    assert spark.read.parquet(f"{root}/message_embeddings").count() == 0


def test_failed_pipeline_is_recorded_and_raised(spark):
    import pytest
    from pyspark.errors import AnalysisException

    from logweave.operators.pipeline import run_pipeline

    root = scratch_path(spark, "failing")
    with pytest.raises(AnalysisException):
        run_pipeline(spark, root + "/none", root + "/none", root + "/none", root)
    row = spark.read.parquet(f"{root}/pipeline_runs").first()
    assert row.status == "FAILED" and "PATH_NOT_FOUND" in row.details


def test_missing_shared_folder_is_an_error_on_a_cluster():
    import pytest

    from logweave.session import shared_dir

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        shared_dir(Cluster)

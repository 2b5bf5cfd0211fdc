"""Counts kept by batch give the reports of a full scan; table sets commit all or nothing."""

import os

import pytest
from pyspark.sql import functions as F

from logweave.operators import analytics as an
from logweave.operators import rollups as ru
from logweave.plans.q_core import logs, vecs
from logweave.session import scratch_path
from logweave.sources import tables as tb
from logweave.sources.versioned import Conflict, Steps, TableSet, inputs_key
from tests.conftest import SF_SMALL


def same(a, b):
    assert a.columns == b.columns
    assert [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()]


def reports(rows, module, vectors):
    yield module.stats_overview(rows, vectors)
    yield module.frequent_errors(rows, 1000)
    yield module.frequent_errors(rows, 5, "INFO")
    yield module.timeline(rows, "hour", level="ERROR")
    yield module.timeline(rows, "day", event_ids=["E1", "E3"])
    yield module.level_distribution(rows)
    yield module.volume_hour_level(rows)
    yield module.volume_hour_level(rows, pivot=True)
    yield module.top_error_templates(rows)
    yield module.panel_totals(rows, vectors)


def test_three_batches_and_a_replay_equal_the_full_scan(spark):
    odd = F.when(F.col("id") % 50 == 0, None)
    whole = logs(spark, SF_SMALL).withColumn("log_timestamp", odd.otherwise(F.col("log_timestamp")).cast("timestamp_ntz"))
    whole = whole.withColumn("event_template", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("event_template")))
    vectors = vecs(spark, SF_SMALL)
    ts = TableSet(spark, scratch_path(spark, "rollup"))
    batch = lambda k: whole.filter(F.col("id") % 4 == k)
    for k in (0, 1, 1, 2):
        assert ru.add_batch(ts, k, batch(k))
    assert ru.compact(ts, 1) and not ru.compact(ts, 1)
    assert not ru.add_batch(ts, 0, batch(0))  # merged: a replay is left out
    assert ru.add_batch(ts, 3, batch(3)) and ru.add_batch(ts, 3, batch(3))
    counts = ru.read_counts(ts)
    for got, want in zip(reports(counts, ru, vectors), reports(whole, an, vectors), strict=True):
        same(got, want)
    assert ts.vacuum(keep=1) == 4
    same(ru.level_distribution(ru.read_counts(ts)), an.level_distribution(whole))


def test_counts_of_nothing(spark):
    empty = logs(spark, SF_SMALL).limit(0)
    ts = TableSet(spark, scratch_path(spark, "rollup-none"))
    with pytest.raises(KeyError):
        ru.read_counts(ts)
    ru.add_batch(ts, 0, empty)
    for got, want in zip(reports(ru.read_counts(ts), ru, vecs(spark, SF_SMALL)), reports(empty, an, vecs(spark, SF_SMALL)), strict=True):
        same(got, want)


def test_a_load_that_fails_leaves_the_former_tables(spark):
    rows = logs(spark, SF_SMALL).withColumns({c: F.lit(None).cast("string") for c in ("month", "time_text", "host", "service")})
    rows = rows.withColumns({"day": F.lit(1), "process_id": F.lit(2)})
    templates = spark.createDataFrame([("E1", "t", 3)], "event_id string, event_template string, occurrences int")
    ts = TableSet(spark, scratch_path(spark, "set"))
    n = rows.count()
    assert tb.load_versioned(ts, rows, templates) == {"event_templates": 1, "log_entries": n}
    bad = rows.withColumn("host", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        tb.load_versioned(ts, bad, templates.unionByName(templates))
    assert ts.version() == 1 and ts.read("event_templates").count() == 1 and ts.read("log_entries").count() == n
    tb.load_versioned(ts, rows.limit(10), templates, reset=False)
    assert ts.read("log_entries").count() == n + 10 and ts.read("log_entries", 1).count() == n
    ts.append(ts.read("event_templates").limit(1), "message_embeddings")
    tb.load_versioned(ts, rows.limit(4), templates)
    assert ts.read("log_entries").count() == 4 and "message_embeddings" not in ts.tables()


def test_of_two_writers_on_one_base_one_gives_way(spark):
    ts = TableSet(spark, scratch_path(spark, "race"))
    path, _ = ts.stage(spark.range(3), "t")
    ts.commit({"t": [path]}, 0)
    with pytest.raises(Conflict):
        ts.commit({"t": []}, 0)
    assert ts.read("t").count() == 3 and ts.version() == 1


def test_a_rerun_repeats_only_what_was_lost(spark):
    source = scratch_path(spark, "source")
    spark.range(4).write.parquet(source)
    root, tried = scratch_path(spark, "steps"), []

    def run(fail):
        steps = Steps(spark, root, inputs_key(spark, [source], limit=1))
        for name in ("one", "two", "three"):
            def work(folder, name=name):
                tried.append(name)
                if name == fail:
                    raise RuntimeError(name)
                spark.range(2).write.parquet(folder)
                return {"folder": folder}
            assert os.path.isdir(steps.step(name, work)["folder"])
        return steps.repeated

    for fail in ("one", "two", "three"):
        with pytest.raises(RuntimeError):
            run(fail)
    assert run(None) == ["three"] and run(None) == []
    assert tried == ["one", "one", "two", "two", "three", "three"]
    spark.range(1).write.mode("append").parquet(source)
    assert run(None) == ["one", "two", "three"]


@pytest.mark.parametrize("step", ["prepare_dataset", "load_table", "embed_incremental", "build"])
def test_a_failed_build_keeps_the_former_tables(spark, monkeypatch, step):
    from logweave.operators import ann, embed, pipeline
    from logweave.plans import q_sources as q
    from logweave.sources import csv as cs
    from logweave.sources import lines as ln

    src, root = scratch_path(spark, "in"), scratch_path(spark, "build")
    raw = ln.write_lines(q.lines(spark, SF_SMALL).limit(300), f"{src}/raw")
    cs.write_structured_csv(q.structured(spark, SF_SMALL), f"{src}/structured")
    cs.write_templates_csv(q.fx.fixture(spark, SF_SMALL, "f_templ"), f"{src}/templates")
    args = (spark, raw, f"{src}/structured", f"{src}/templates", root)
    pipeline.run_pipeline(*args, limit=20, dim=8, n_cells=2)
    where = {"prepare_dataset": pipeline, "load_table": tb, "embed_incremental": embed, "build": ann}[step]
    real = getattr(where, step)

    def broken(*a, **k):
        raise RuntimeError("lost")

    monkeypatch.setattr(where, step, broken)
    with pytest.raises(RuntimeError):
        pipeline.run_pipeline(*args, limit=30, dim=8, n_cells=2)
    assert TableSet(spark, root).read("log_entries").count() == 20
    monkeypatch.setattr(where, step, real)
    pipeline.run_pipeline(*args, limit=30, dim=8, n_cells=2)
    ts = TableSet(spark, root)
    assert ts.read("log_entries").count() == 30 and ts.version() == 2
    assert sorted(r.status for r in spark.read.parquet(f"{root}/pipeline_runs").collect()) == ["FAILED", "SUCCESS", "SUCCESS"]

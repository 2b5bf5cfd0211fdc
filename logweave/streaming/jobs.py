"""Streaming operators (ST1-ST5).

Every query keeps its checkpoint in the shared folder, so a restarted
driver or lost executors resume from the last committed batch.  Sinks are
file tables (exactly-once via the checkpoint); each batch of a
``foreachBatch`` sink overwrites the folder of its own id, so a replayed
batch leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.parse import parse_lines


def _run(writer, live_trigger: str | None = None, timeout_s: int | None = None):
    """Run to the end of the available input (batch-like ``availableNow``),
    or, with ``live_trigger`` (e.g. "30 seconds", a dashboard's refresh
    cadence), start a continuous query and return it without waiting."""
    if live_trigger:
        return writer.trigger(processingTime=live_trigger).start()
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(timeout_s)
    return q


def ingest_lines(spark: SparkSession, source_dir: str, out_path: str, checkpoint: str,
                 year: int = 2024, max_files_per_trigger: int | None = None, run: bool = True,
                 live_trigger: str | None = None):
    """ST1: new text files -> parsed rows (auto-detected format) -> Parquet."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(source_dir)
    parsed = parse_lines(lines, "value", year=year, out="p").select("p.*")
    out = parsed.select("source", "log_timestamp", "level", "host", "process", "pid", "message", "raw")
    writer = (out.writeStream.format("parquet").option("path", out_path)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    return _run(writer, live_trigger) if run else writer


def _with_event_time(logs: DataFrame, ts_col: str) -> DataFrame:
    # watermarks need TIMESTAMP (not NTZ); the session zone is UTC
    return logs.filter(F.col(ts_col).isNotNull()).withColumn("_et", F.col(ts_col).cast("timestamp"))


def _keep_each_batch(path: str):
    """Each batch's changed counts in a folder of its own: a replayed batch leaves the same rows, and readers
    never see a folder being rewritten."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def _window_counts(stream: DataFrame, ts_col: str, watermark: str, size: str) -> DataFrame:
    """Rows per tumbling window, with the window's start; state goes when the watermark has passed its end."""
    return (
        _with_event_time(stream, ts_col).withWatermark("_et", watermark)
        .groupBy(F.window("_et", size).alias("w"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "count")
    )


def timeline(stream: DataFrame, out_path: str, checkpoint: str, ts_col: str = "log_timestamp",
             granularity: str = "hour", watermark: str = "1 hour", complete: bool = True,
             live_trigger: str | None = None):
    """ST2: live counts per tumbling hour/day window.

    ``complete`` gives every window's count as soon as a batch changes it (read
    by ``current_counts``); else a window comes once, when the watermark has
    passed its end.  In both forms the state holds the windows that the
    watermark hasn't passed, and rows of passed windows are dropped; within
    the watermark a late row is counted.
    """
    agg = _window_counts(stream, ts_col, watermark, {"hour": "1 hour", "day": "1 day"}[granularity])
    if complete:
        writer = agg.writeStream.outputMode("update").foreachBatch(_keep_each_batch(out_path))
    else:
        writer = agg.writeStream.outputMode("append").format("parquet").option("path", out_path)
    return _run(writer.option("checkpointLocation", checkpoint), live_trigger)


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, count): each window's count by the last batch that changed it."""
    return spark.read.parquet(path).groupBy("bucket").agg(F.max_by("count", "batch_id").alias("count"))


def errors_sliding(stream: DataFrame, out_path: str, checkpoint: str, ts_col: str = "log_timestamp",
                   level: str = "ERROR", watermark: str = "1 hour", live_trigger: str | None = None):
    """ST3: live counts an hour of the rows of a level, from which ``trailing_counts`` adds up the
    windows.

    A row is counted once, in its hour, and not in each window that holds it.
    The state is the hours that the watermark hasn't passed, however long the
    stream runs; rows of passed hours are dropped, later rows within the
    watermark change their hour's count and so the windows above it."""
    counts = _window_counts(stream.filter(F.col("level") == level), ts_col, watermark, "1 hour")
    writer = counts.writeStream.outputMode("update").foreachBatch(_keep_each_batch(out_path))
    return _run(writer.option("checkpointLocation", checkpoint), live_trigger)


def trailing_counts(spark: SparkSession, path: str, hours: int = 24) -> DataFrame:
    """(window_start, count) of the windows of ``hours``, advancing hourly, that hold a row."""
    back = F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("back")
    starts = current_counts(spark, path).select("bucket", "count", back).select(
        (F.col("bucket") - F.make_dt_interval(F.lit(0), F.col("back"))).alias("window_start"), F.col("count").alias("n"))
    return starts.groupBy("window_start").agg(F.sum("n").alias("count"))


def embed_stream(stream: DataFrame, table_path: str, checkpoint: str, dim: int = 384,
                 live_trigger: str | None = None):
    """ST4: two queries over the stream.  One keeps the messages seen as keyed state and passes each on its
    first sighting, to be embedded; the other writes each batch's counts.  Both read a batch's own rows and
    nothing of earlier batches.  ``stored_embeddings`` puts them together.

    A null message is a message.  The state has one key a message, as the table has one row; a replayed
    batch leaves the same rows.  Returns the two queries.
    """
    from logweave.operators.analytics import distinct_messages
    from logweave.operators.embed import encode

    def rows_of(kind: str, make):
        def write(batch: DataFrame, batch_id: int) -> None:
            make(batch).select(*STORED).write.mode("overwrite").parquet(f"{table_path}/kind={kind}/batch_id={batch_id}")

        return write

    counted = rows_of("counts", lambda batch: distinct_messages(batch, ordered=False).withColumn("embedding", F.lit(None).cast("array<float>")))
    encoded = rows_of("vectors", lambda batch: encode(batch, dim=dim).withColumns(
        {"representative_event_id": F.lit(None).cast("string"), "representative_level": F.lit(None).cast("string"), "occurrences": F.lit(None).cast("long")}))
    first = stream.select("normalized_message").dropDuplicates(["normalized_message"])
    return (_run(first.writeStream.foreachBatch(encoded).option("checkpointLocation", f"{checkpoint}/vectors"), live_trigger),
            _run(stream.writeStream.foreachBatch(counted).option("checkpointLocation", f"{checkpoint}/counts"), live_trigger))


STORED = ("normalized_message", "representative_event_id", "representative_level", "occurrences", "embedding")


def stored_embeddings(spark: SparkSession, table_path: str) -> DataFrame:
    """One row per message of an ``embed_stream`` table: least id and level, all occurrences, its vector."""
    return spark.read.parquet(table_path).groupBy("normalized_message").agg(
        F.min("representative_event_id").alias("representative_event_id"),
        F.min("representative_level").alias("representative_level"),
        F.sum("occurrences").alias("occurrences"),
        F.first("embedding", ignorenulls=True).alias("embedding"))


def alerts_stream(stream: DataFrame, model, alerts_path: str, checkpoint: str,
                  key: str = "normalized_message", threshold: str = "high",
                  live_trigger: str | None = None):
    """ST5: score each micro-batch with a trained forest, build alerts, gate them by severity and write
    them to the folder of the batch.  All batches share the model's one set of broadcasts."""
    from logweave.operators import anomaly
    from logweave.operators.alerts import alert_gate, anomaly_alerts

    def write(batch: DataFrame, batch_id: int) -> None:
        scores = anomaly.score(batch, model, key)
        alerts = alert_gate(anomaly_alerts(scores, message_col=key), threshold)
        alerts.write.mode("overwrite").parquet(f"{alerts_path}/batch_id={batch_id}")

    return _run(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), live_trigger)

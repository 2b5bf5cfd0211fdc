"""Streaming state: bounded by the watermark, replays, late rows, first sightings."""

import pytest
from pyspark.sql import functions as F

from logweave.session import scratch_path
from logweave.streaming import jobs as st

LOG = "log_timestamp timestamp_ntz, level string, normalized_message string, event_id string"


def replay(spark, source, batches):
    """Each list of rows as one file, read one file a batch."""
    for k, rows in enumerate(batches):
        made = spark.createDataFrame(rows, "t string, level string, normalized_message string, event_id string")
        made = made.select(F.col("t").cast("timestamp_ntz").alias("log_timestamp"), "level", "normalized_message", "event_id")
        made.coalesce(1).write.mode("append").parquet(f"{source}/part={k:04d}")
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")


def hours(n, start=0):
    """A row in each of ``n`` hours, two of level ERROR in each third."""
    for h in range(start, start + n):
        stamp = f"2024-01-{1 + h // 24:02d} {h % 24:02d}:10:00"
        yield (stamp, "ERROR", f"m {h % 5}", "E1")
        if h % 3 == 0:
            yield (stamp, "ERROR", "again", "E2")
        yield (stamp, "INFO", "fine", "E3")


def state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_trailing_counts_keep_a_flat_state(spark):
    rows = [list(hours(6, 6 * k)) for k in range(24)]  # six days, six hours a batch
    source, out, ckpt = (scratch_path(spark, n) for n in ("src", "errors", "ckpt"))
    q = st.errors_sliding(replay(spark, source, rows), out, ckpt)
    sizes = state_rows(q)
    assert len(sizes) >= 24 and max(sizes[12:]) <= max(sizes[:12]) <= 16
    want = {}
    for t, level, _, _ in (r for batch in rows for r in batch):
        if level == "ERROR":
            h = (int(t[8:10]) - 1) * 24 + int(t[11:13])
            for back in range(24):
                want[h - back] = want.get(h - back, 0) + 1
    got = {r.h: r["count"] for r in st.trailing_counts(spark, out).selectExpr("cast(timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', window_start) AS int) AS h", "count").collect()}
    assert got == want


def test_late_rows_count_within_the_watermark_alone(spark):
    rows = [
        [("2024-01-01 10:10:00", "ERROR", "a", "E")],
        [("2024-01-01 11:20:00", "ERROR", "a", "E")],
        [("2024-01-01 10:40:00", "ERROR", "late, but its hour is open", "E")],
        [("2024-01-01 15:00:00", "ERROR", "a", "E")],
        [("2024-01-01 15:05:00", "ERROR", "a", "E")],
        [("2024-01-01 10:50:00", "ERROR", "too late", "E"), (None, "ERROR", "without a time", "E")],
    ]
    source, out, ckpt = (scratch_path(spark, n) for n in ("src", "errors", "ckpt"))
    st.errors_sliding(replay(spark, source, rows), out, ckpt)
    got = {str(r.bucket): r["count"] for r in st.current_counts(spark, out).collect()}
    assert got == {"2024-01-01 10:00:00": 2, "2024-01-01 11:00:00": 1, "2024-01-01 15:00:00": 2}


@pytest.mark.parametrize("granularity,size", [("hour", 13), ("day", 10)])
def test_timeline_forgets_closed_windows(spark, granularity, size):
    n = 24 if granularity == "hour" else 96
    rows = [list(hours(n, n * k)) for k in range(6)]
    source, out, ckpt = (scratch_path(spark, x) for x in ("src", "timeline", "ckpt"))
    q = st.timeline(replay(spark, source, rows), out, ckpt, granularity=granularity)
    assert max(state_rows(q)) <= n + 2
    unit = 13 if granularity == "hour" else 10
    want = {}
    for t, _, _, _ in (r for batch in rows for r in batch):
        want[t[:unit]] = want.get(t[:unit], 0) + 1
    assert {str(r.bucket)[:unit]: r["count"] for r in st.current_counts(spark, out).collect()} == want and size == unit


def test_first_sightings_read_their_own_batch(spark):
    """Rows that a batch reads don't grow with the batches before; each message has one vector."""
    rows = [[(f"2024-01-01 10:{k:02d}:00", "INFO", f"message {m}", f"E{m}") for m in range(k, k + 5)] + [(None, None, None, None)] for k in range(8)]
    source, table, ckpt = (scratch_path(spark, n) for n in ("src", "table", "ckpt"))
    stream = replay(spark, source, rows)
    for q in st.embed_stream(stream, table, ckpt, dim=16):
        read = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
        assert read == [6] * 8
    again = replay(spark, source, [])
    assert all(not any(p["numInputRows"] for p in q.recentProgress) for q in st.embed_stream(again, table, ckpt, dim=16))
    assert spark.read.parquet(table).filter("kind = 'vectors'").count() == 13
    got = {r.normalized_message: (r.occurrences, len(r.embedding)) for r in st.stored_embeddings(spark, table).collect()}
    want = {f"message {m}": (sum(k <= m < k + 5 for k in range(8)), 16) for m in range(12)} | {None: (8, 16)}
    assert got == want

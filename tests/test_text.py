"""Literal cases for prefix parsing, preparation, normalisation, levels and vector text."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logweave.functions.parse import openssh_prefix
from logweave.functions.text import classify_level, normalize_message, normalize_storage
from logweave.functions.vector import text_to_vector, vector_to_text
from logweave.operators.prepare import prepare_log_entries

LINE = "Jan  9 00:00:59 node3 sudo[8]: session opened for operator"


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_openssh_prefix(spark):
    r = one(spark, openssh_prefix(F.col("v"), 2025), LINE)
    assert (r.month, r.day, r.host, r.service, r.process_id) == ("Jan", 9, "node3", "sudo", 8)
    assert r.log_timestamp == dt.datetime(2025, 1, 9, 0, 0, 59) and r.content == "session opened for operator"


def test_lines_without_prefix_and_impossible_dates(spark):
    r = one(spark, openssh_prefix(F.col("v"), 2024), "kernel panic")
    assert (r.month, r.day, r.log_timestamp, r.content) == (None, None, None, None)
    assert one(spark, openssh_prefix(F.col("v"), 2023), "Feb 29 10:00:00 h d[1]: x").log_timestamp is None
    assert one(spark, openssh_prefix(F.col("v"), 2024), "Feb 29 10:00:00 h d[1]: x").log_timestamp.day == 29


def test_empty_content_is_not_a_missing_match(spark):
    lines = spark.createDataFrame([(1, "Jan 9 00:00:59 node3 sudo[8]: "), (2, "no prefix")], "line_id long, raw_line string")
    got = {r.line_id: r.raw_message for r in prepare_log_entries(lines).collect()}
    assert got == {1: "", 2: "no prefix"}


@pytest.mark.parametrize(("text", "expected"), [("\t Disk\u00a0 FULL \n", "disk full"), ("", ""), (None, ""), ("one\u2003two", "one two"), ("\x1fA", "a")])
def test_normalize_message(spark, text, expected):
    assert one(spark, normalize_message(F.col("v")), text) == expected


def test_normalize_storage_keeps_edges(spark):
    df = spark.createDataFrame([(None, "\tX \n y  "), ("T <*>  Z", "ignored")], "t string, m string")
    assert [r[0] for r in df.select(normalize_storage(F.col("t"), F.col("m"))).collect()] == [" x y ", "t <*> z"]


@pytest.mark.parametrize(("text", "level"), [
    ("too MANY authentication failures for x", "CRITICAL"), ("fatal: no memory", "ERROR"), ("invalid USER guest", "ERROR"),
    ("reverse mapping of h", "WARNING"), ("preauth step", "WARNING"), ("session opened", "INFO"), ("", "INFO"),
    ("fatal after disconnect", "ERROR"), ("possible break-in attempt, error", "CRITICAL"),
])
def test_classify_level(spark, text, level):
    assert one(spark, classify_level(F.col("v")), text) == level


def test_vector_text(spark):
    df = spark.createDataFrame([([0.25, -3.0, 1e-7],)], "v array<double>")
    text = df.select(vector_to_text(F.col("v")).alias("t"))
    assert text.first()[0] == "[0.2500000000,-3.0000000000,0.0000001000]"
    assert list(text.select(text_to_vector(F.col("t"))).first()[0]) == [0.25, -3.0, 1e-7]


def test_bucket_sums_hold_a_batch_once(spark):
    """A batch of hashes gives the encoder's vectors, and needs little more memory than these."""
    import hashlib
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from logweave.functions import vector as ve
    from logweave.operators.embed import encode_query

    texts = [f"session {k} opened" if k % 5 else "" for k in range(4_096)]
    hashes = [[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in x.split()] for x in texts] + [None]
    tracemalloc.start()
    got = ve._bucket_sums(384).func(pa.array(hashes, pa.list_(pa.int64())))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 2 * 4_097 * 384 * 4
    assert [np.asarray(got[k].as_py(), np.float32).tolist() for k in (0, 1, 777, 4_096)] == [encode_query(t) for t in ("", texts[1], texts[777], "")]

"""Streaming forms: bounded-state dedup (T4) and windowed daily usage."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from tracelens.operators.derive import usage_daily
from tracelens.streaming import ingest

D = dt.datetime
MSG = ("uuid string, session_id string, role string, timestamp timestamp, model string, input_tokens int, "
       "output_tokens int, cache_creation_tokens int, cache_read_tokens int, host string")


def _stream_of(spark, rows, schema):
    d = tempfile.mkdtemp(prefix="tl-src-")
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(os.path.join(d, "part"))
    return spark.readStream.schema(schema).parquet(os.path.join(d, "part"))


def _collect(df, name):
    ck = tempfile.mkdtemp(prefix="tl-ck-")
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return df.sparkSession.table(name)


def test_dedup_within_watermark(spark):
    rows = [("e1", D(2026, 1, 1, 10)), ("e1", D(2026, 1, 1, 10)), ("e2", D(2026, 1, 1, 11))]
    s = _stream_of(spark, rows, "uuid string, timestamp timestamp")
    out = _collect(ingest.dedup_stream(s), "dedup_t4")
    assert sorted(r.uuid for r in out.collect()) == ["e1", "e2"]


def test_usage_daily_stream_equals_batch(spark):
    rows = [
        ("m1", "s1", "assistant", D(2026, 1, 1, 10), "a", 10, 1, None, 5, "h1"),
        ("m2", "s1", "assistant", D(2026, 1, 1, 12), "a", 20, 2, 3, 5, "h1"),
        ("m3", "s2", "assistant", D(2026, 1, 2, 9), "b", 1, 1, 1, 1, "h2"),
        ("m4", "s2", "user", D(2026, 1, 2, 9), None, None, None, None, None, "h2"),
        ("m5", "s2", "assistant", D(2026, 1, 5, 9), "b", 7, 7, 7, 7, "h2"),  # moves the watermark on
    ]
    sessions = spark.createDataFrame([("s1", "/p/a"), ("s2", "/p/b")], "session_id string, project_path string")
    stream = _stream_of(spark, rows, MSG)
    got = _collect(ingest.usage_daily_stream(stream, sessions), "ud_stream")
    batch = usage_daily(spark.createDataFrame(rows, MSG), sessions).filter(F.col("day") < D(2026, 1, 5))
    cols = ["day", "host", "project_path", "model", "message_count", "input_tokens", "output_tokens",
            "cache_creation", "cache_read"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))

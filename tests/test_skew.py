"""Skew-safe window operators against their brute-force definitions."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelens.operators.skew import chunked_lead, top_k_per_group


def _skewed(spark, n=3000, seed=3):
    rng = random.Random(seed)
    t0 = dt.datetime(2026, 1, 1)
    rows = []
    for i in range(n):
        # one hot session holds half of the rows; timestamps collide on purpose
        s = "hot" if i % 2 == 0 else f"s{rng.randint(0, 40)}"
        ts = t0 + dt.timedelta(seconds=rng.randint(0, 3 * 3600) // 7 * 7)
        rows.append((s, ts, f"u{i:05d}", rng.choice(["user", "assistant"])))
    return spark.createDataFrame(rows, "session_id string, timestamp timestamp, uuid string, role string")


def test_chunked_lead_equals_window_lead(spark):
    df = _skewed(spark)
    w = Window.partitionBy("session_id").orderBy("timestamp", "uuid")
    want = df.select("uuid", F.lead("timestamp").over(w).alias("nt"), F.lead("role").over(w).alias("nr"))
    for chunk in (1, 60, 3600):
        got = chunked_lead(df, "session_id", "timestamp", "uuid", ["role"], chunk_seconds=chunk).select(
            "uuid", F.col("next_timestamp").alias("nt"), F.col("next_role").alias("nr"))
        assert got.count() == df.count()
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, chunk


def test_top_k_is_limited_map_side(spark):
    df = _skewed(spark)
    top = top_k_per_group(df, "session_id", [F.asc("timestamp"), F.asc("uuid")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    w = Window.partitionBy("session_id").orderBy("timestamp", "uuid")
    want = df.withColumn("rank", F.row_number().over(w)).filter("rank <= 3")
    assert top.exceptAll(want).count() == 0 and want.exceptAll(top).count() == 0

"""Write semantics (K1-K10) and the liveness stream (T5)."""

import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from tracelens.operators import sinks as K
from tracelens.operators.hosts import reset_state
from tracelens.operators.liveness import apply_liveness, session_liveness
from tracelens.sources.pricing import model_pricing, upsert_pricing
from tracelens.sources.sidefiles import dedup_history
from tracelens.streaming import ingest

D = dt.datetime


def test_insert_if_absent_first_wins(spark):
    stored = spark.createDataFrame([("e1", "old")], "uuid string, v string")
    batch = spark.createDataFrame(
        [("e1", "dup", "a", 1), ("e2", "second", "b", 2), ("e2", "first", "a", 9), ("e3", "x", "z", 0)],
        "uuid string, v string, host string, line long")
    new = {r.uuid: r.v for r in K.insert_if_absent(stored, batch, ["uuid"], ["host", "line"]).collect()}
    assert new == {"e2": "first", "e3": "x"}
    again = K.insert_if_absent(stored.unionByName(batch.select("uuid", "v")), batch, ["uuid"], ["host", "line"])
    assert again.count() == 0


def test_session_status_survives(spark):
    recomputed = spark.createDataFrame([("s1", "ended"), ("s2", "ended")], "session_id string, status string")
    old = spark.createDataFrame([("s1", "active"), ("s2", "ended")], "session_id string, status string")
    got = {r.session_id: r.status for r in K.merge_session_status(recomputed, old).collect()}
    assert got == {"s1": "active", "s2": "ended"}


def test_liveness_last_write_wins_and_status_only_rows(spark):
    hooks = spark.createDataFrame(
        [("s1", "SessionStart", D(2026, 1, 1, 1)), ("s1", "Stop", D(2026, 1, 1, 2)),
         ("s2", "SessionStart", D(2026, 1, 1, 1)), ("s2", "PostToolUse", D(2026, 1, 1, 3)),
         ("s9", "SessionStart", D(2026, 1, 1, 1))],
        "session_id string, hook string, timestamp timestamp")
    live = {r.session_id: r.status for r in session_liveness(hooks).collect()}
    assert live == {"s1": "ended", "s2": "active", "s9": "active"}
    sessions = spark.createDataFrame([("s1", D(2026, 1, 1), "ended"), ("s2", D(2026, 1, 1), "ended")],
                                     "session_id string, started_at timestamp, status string")
    got = {r.session_id: (r.status, r.started_at) for r in apply_liveness(sessions, session_liveness(hooks)).collect()}
    assert got["s2"][0] == "active" and got["s1"][0] == "ended"
    assert got["s9"] == ("active", None)  # status-only row, NULL start (N28)


def test_pricing_upsert(spark):
    cur = model_pricing(spark)
    upd = model_pricing(spark, [("claude-opus-4-6", "10", "50", "12.5", "20", "1"), ("new-model", "1", "2", "3", "4", "5")])
    got = {r.model: r.input_c for r in upsert_pricing(cur, upd).collect()}
    assert got["claude-opus-4-6"] == 1000 and got["new-model"] == 100 and len(got) == 10


def test_history_key_null_project_never_conflicts(spark):
    rows = [("/p", "hi", "{}", D(2026, 1, 1), "local", 1), ("/p", "hi", '{"a":1}', D(2026, 1, 1), "local", 2),
            (None, "hi", "{}", D(2026, 1, 1), "local", 3), (None, "hi", "{}", D(2026, 1, 1), "local", 4)]
    h = spark.createDataFrame(rows, "project_path string, display string, pasted_contents string, typed_at timestamp, host string, line_key long")
    out = dedup_history(h).collect()
    assert len(out) == 3
    assert [r.pasted_contents for r in out if r.project_path == "/p"] == ["{}"]


def test_reset_state(spark):
    st = spark.createDataFrame([("a", 1), ("b", 2)], "host string, consecutive_errors int")
    assert [r.host for r in reset_state(st, "a").collect()] == ["b"]


def test_stamp_host(spark):
    df = spark.range(2).select(F.col("id"))
    assert {r.host for r in K.stamp_host(df, "mini").collect()} == {"mini"}


def test_liveness_stream(spark):
    src = tempfile.mkdtemp(prefix="tl-hooks-")
    out = os.path.join(tempfile.mkdtemp(prefix="tl-live-"), "liveness")
    ck = tempfile.mkdtemp(prefix="tl-ck-")
    with open(os.path.join(src, "h1.json"), "w") as f:
        for sid, hook, ts in [("s1", "SessionStart", "2026-01-01T01:00:00Z"), ("s1", "Stop", "2026-01-01T02:00:00Z"),
                              ("s2", "SessionStart", "2026-01-01T01:00:00Z")]:
            f.write(json.dumps({"session_id": sid, "hook": hook, "timestamp": ts}) + "\n")
    q = ingest.start_liveness(spark, src, out, ck, trigger={"availableNow": True})
    q.awaitTermination(300)
    with open(os.path.join(src, "h2.json"), "w") as f:
        f.write(json.dumps({"session_id": "s1", "hook": "SessionStart", "timestamp": "2026-01-01T03:00:00Z"}) + "\n")
    q = ingest.start_liveness(spark, src, out, ck, trigger={"availableNow": True})
    q.awaitTermination(300)
    got = {r.session_id: r.status for r in spark.read.parquet(out).collect()}
    assert got == {"s1": "active", "s2": "active"}

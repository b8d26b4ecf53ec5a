"""T5 / K3: session liveness from hook signals, folded into the sessions table.

Hook rule: SessionStart -> 'active'; SessionEnd or Stop -> 'ended'; any other hook
changes nothing; the last write wins. The rollup writes 'ended' but never overwrites
an existing 'active' (K3), so the final status is the last hook status, else 'ended'.
A hook for a session without events creates a status-only row (N28: NULL start, so
every windowed query skips it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Hook name -> status it sets.
HOOK_STATUS = [("SessionStart", "active"), ("SessionEnd", "ended"), ("Stop", "ended")]


def hook_status(hook: F.Column) -> F.Column:
    out = None
    for name, status in HOOK_STATUS:
        out = F.when(hook == name, status) if out is None else out.when(hook == name, status)
    return out


def session_liveness(hooks: DataFrame) -> DataFrame:
    """(session_id, hook, timestamp) -> (session_id, status, status_at); last write wins.
    A per-session max over a struct: partial aggregation, no window."""
    s = hooks.select("session_id", "timestamp", hook_status(F.col("hook")).alias("status")).filter(
        F.col("status").isNotNull()
    )
    return s.groupBy("session_id").agg(F.max(F.struct("timestamp", "status")).alias("_l")).select(
        "session_id", F.col("_l.status").alias("status"), F.col("_l.timestamp").alias("status_at")
    )


def apply_liveness(sessions: DataFrame, liveness: DataFrame) -> DataFrame:
    live = liveness.select("session_id", F.col("status").alias("_live"))
    kept = sessions.join(live, "session_id", "left").withColumn(
        "status", F.when(F.col("_live") == "active", "active").otherwise(F.col("status"))
    ).drop("_live")
    orphans = live.join(sessions.select("session_id"), "session_id", "left_anti")
    status_only = orphans.select("session_id", F.col("_live").alias("status"))
    return kept.unionByName(status_only, allowMissingColumns=True)

"""H1 / H2: host-sync health as table operators.

The reference folds pull outcomes one at a time into a state row. The fold has a
closed form, so it runs as two partially-aggregated group-bys and one join on a
one-row-per-host table:

* ``ls`` = last non-error pull, ``ln`` = last non-empty pull;
* consecutive errors = errors after ``ls``; consecutive empties = empties after ``ln``
  (errors do not reset them); interval = 3 / 6 / 12 h for 0 / 1 / >=2 empties;
* ``last_error`` = newest error after ``ls`` (a successful pull clears it),
  ``last_error_at`` = newest error ever (never cleared).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pull interval in hours by number of consecutive empty pulls (else 12).
INTERVAL_BY_EMPTY_COUNT = [(0, 3), (1, 6)]
MAX_INTERVAL_HOURS = 12


def interval_for_empty_count(n: F.Column) -> F.Column:
    out = None
    for k, h in INTERVAL_BY_EMPTY_COUNT:
        out = F.when(n == k, h) if out is None else out.when(n == k, h)
    return out.otherwise(MAX_INTERVAL_HOURS)


def host_sync_health(outcomes: DataFrame) -> DataFrame:
    """(host, timestamp, kind, message) -> host_sync_state."""
    o = outcomes.select("host", "timestamp", "kind", "message")
    marks = o.groupBy("host").agg(
        F.max(F.when(F.col("kind") != "error", F.col("timestamp"))).alias("ls"),
        F.max(F.when(F.col("kind") == "non-empty", F.col("timestamp"))).alias("ln"),
        F.max(F.when(F.col("kind") == "error", F.col("timestamp"))).alias("last_error_at"),
    )
    after_ls = F.col("ls").isNull() | (F.col("timestamp") > F.col("ls"))
    after_ln = F.col("ln").isNull() | (F.col("timestamp") > F.col("ln"))
    is_err = F.col("kind") == "error"
    j = o.join(marks, "host")
    agg = j.groupBy("host", "ls", "ln", "last_error_at").agg(
        F.count(F.when(is_err & after_ls, True)).cast("int").alias("consecutive_errors"),
        F.count(F.when((F.col("kind") == "empty") & after_ln, True)).cast("int").alias("consecutive_empty_pulls"),
        F.max(F.when(is_err & after_ls, F.struct("timestamp", "message")))["message"].alias("last_error"),
    )
    return agg.select(
        "host",
        F.col("ls").alias("last_pulled_at"),
        F.col("ln").alias("last_had_data_at"),
        interval_for_empty_count(F.col("consecutive_empty_pulls")).cast("int").alias("current_interval_hours"),
        "consecutive_empty_pulls",
        "last_error",
        "last_error_at",
        "consecutive_errors",
    )


def due_hosts(state: DataFrame, now: dt.datetime) -> DataFrame:
    """H2: never pulled, or last pull + interval <= now."""
    now_c = F.lit(now.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
    due_at = F.timestamp_micros(F.unix_micros("last_pulled_at") + F.col("current_interval_hours").cast("long") * 3600 * 1000000)
    return state.filter(F.col("last_pulled_at").isNull() | (due_at <= now_c))


def reset_state(state: DataFrame, host: str) -> DataFrame:
    """Forget one host's sync state."""
    return state.filter(F.col("host") != host)

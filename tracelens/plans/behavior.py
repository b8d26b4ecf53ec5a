"""Behaviour queries (Q12-Q16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import TimeWindow
from ..operators.quantiles import percentile_cont
from ..operators.skew import chunked_lead
from .catalog import Catalog
from .common import day_str, in_list, in_window, ntz, ratio, where


def tool_error_rate(cat: Catalog, w: TimeWindow, hosts=None) -> DataFrame:
    """Q12: calls, errors and error rate per day; NULL ``is_error`` is not an error."""
    t = where(cat.tool_calls, in_window("timestamp", w), in_list("host", hosts))
    g = t.groupBy(F.to_date("timestamp").alias("d")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count(F.when(F.col("is_error"), True)).alias("errors"),
    )
    return g.select(day_str("d").alias("day"), "calls", "errors", ratio(F.col("errors"), F.col("calls")).alias("error_rate"))


def latency_percentiles(cat: Catalog, w: TimeWindow, hosts=None, max_gap_sec: int = 600, approx: bool = False) -> DataFrame:
    """Q13: user -> next message gaps per day, p50/p95, when the next message is the
    assistant's and the gap is under ``max_gap_sec``. LEAD runs after the window, host
    and sidechain filter (N14), via the skew-safe two-level LEAD."""
    m = where(
        cat.messages.select("uuid", "session_id", "timestamp", "role", "is_sidechain", "host"),
        in_window("timestamp", w), ~F.col("is_sidechain"), in_list("host", hosts),
    )
    x = chunked_lead(m, "session_id", "timestamp", "uuid", ["role"])
    gap = (F.unix_micros("next_timestamp") - F.unix_micros("timestamp")) / F.lit(1e6)
    pairs = x.filter(
        (F.col("role") == "user") & (F.col("next_role") == "assistant") & F.col("next_timestamp").isNotNull()
    ).select(F.to_date("timestamp").alias("d"), gap.alias("gap")).filter(F.col("gap") < max_gap_sec)
    if approx:
        q = pairs.groupBy("d").agg(F.percentile_approx("gap", 0.5, 100000).alias("p50_sec"),
                                   F.percentile_approx("gap", 0.95, 100000).alias("p95_sec"))
    else:
        # exact and size-checked: a day too busy for one task is ranked, never gathered
        q = percentile_cont(pairs, ["d"], "gap", {"p50_sec": 0.5, "p95_sec": 0.95})
    return q.select(day_str("d").alias("day"), F.round("p50_sec", 4).alias("p50_sec"), F.round("p95_sec", 4).alias("p95_sec"))


def subagent_histogram(cat: Catalog, w: TimeWindow, hosts=None, cap: int = 6) -> DataFrame:
    """Q14 (+O7): sessions by sub-agent count, clamped at ``cap``, every bucket present."""
    s = where(cat.sessions, in_window("started_at", w), F.col("subagent_count").isNotNull(), in_list("host", hosts))
    counts = s.groupBy(F.least(F.col("subagent_count"), F.lit(cap)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    grid = cat.spark.range(cap + 1).select(F.col("id").cast("int").alias("bucket"))
    return grid.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def token_velocity(cat: Catalog, w: TimeWindow, hosts=None) -> DataFrame:
    """Q15: (input + output) tokens per second of session duration."""
    s = where(cat.sessions, in_window("started_at", w), F.col("duration_sec").isNotNull(),
              F.col("duration_sec") > 0, in_list("host", hosts))
    return s.select(
        "session_id",
        ntz("started_at").alias("started_at"),
        F.round((F.col("total_input_tokens") + F.col("total_output_tokens")) / F.col("duration_sec"), 6).alias("tokens_per_sec"),
        (F.col("cost_e4") / F.lit(10000.0)).alias("cost"),
    )


def cache_hit_by_model(cat: Catalog, w: TimeWindow, hosts=None) -> DataFrame:
    """Q16: cache-read share of input per model (sorted numerically, N18)."""
    m = where(cat.messages, in_window("timestamp", w), F.col("role") == "assistant",
              F.col("model").isNotNull(), in_list("host", hosts))
    g = m.groupBy("model").agg(
        F.sum("cache_read_tokens").alias("cr"),
        F.sum(F.col("input_tokens") + F.col("cache_read_tokens")).alias("den"),
    )
    return g.select("model", ratio(F.col("cr"), F.col("den")).alias("hit_pct"))

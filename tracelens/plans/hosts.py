"""Per-host queries (Q28-Q31)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import TimeWindow
from ..operators.skew import top_k_per_group
from .catalog import Catalog
from .common import in_window, ntz, ratio, where


def all_hosts(cat: Catalog) -> DataFrame:
    """Q28 (U1, A14): hosts seen in events plus the implicit 'local'."""
    local = cat.spark.range(1).select(F.lit("local").alias("host"))
    return cat.events.select("host").union(local).distinct().filter(F.col("host").isNotNull())


def failing_hosts(cat: Catalog, min_errors: int = 3) -> DataFrame:
    """Q29: hosts with at least ``min_errors`` consecutive failed pulls."""
    s = cat.host_sync_state.filter(F.col("consecutive_errors") >= min_errors)
    return s.select("host", "consecutive_errors", "last_error", ntz("last_error_at").alias("last_error_at"))


def host_stats(cat: Catalog, w: TimeWindow) -> DataFrame:
    """Q30: per host in the window: sessions, tokens, cost, last activity, the model with
    the largest attributed cost (a session's full cost counts for each of its models,
    N17), and sync health (J6, W2, W3, J7)."""
    s = where(cat.sessions, in_window("started_at", w))
    sess = s.groupBy("host").agg(
        F.count(F.lit(1)).alias("session_count"),
        F.coalesce(F.sum("total_input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("total_output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("total_cache_creation"), F.lit(0)).alias("cache_creation"),
        F.coalesce(F.sum("total_cache_read"), F.lit(0)).alias("cache_read"),
        F.coalesce(F.sum("cost_e4"), F.lit(0)).alias("cost_e4"),
        F.max("started_at").alias("last_active_at"),
    )
    per_model = (
        s.select("host", "cost_e4", F.explode(F.coalesce("models_used", F.array().cast("array<string>"))).alias("model"))
        .groupBy("host", "model")
        .agg(F.sum("cost_e4").alias("model_e4"))
    )
    top = top_k_per_group(per_model, "host", [F.desc_nulls_last("model_e4"), F.asc("model")], 1).select(
        "host", F.col("model").alias("top_model"), "model_e4"
    )
    hss = cat.host_sync_state.select("host", "last_pulled_at", "consecutive_errors", "last_error")
    j = sess.join(top, "host", "left").join(hss, "host", "left")
    return j.select(
        "host", "session_count", "input_tokens", "output_tokens", "cache_creation", "cache_read",
        (F.col("cost_e4") / F.lit(10000.0)).alias("cost"),
        "top_model",
        (F.coalesce("model_e4", F.lit(0)) / F.lit(10000.0)).alias("top_model_cost"),
        ntz("last_active_at").alias("last_active_at"),
        ntz("last_pulled_at").alias("last_pulled_at"),
        F.coalesce("consecutive_errors", F.lit(0)).alias("consecutive_errors"),
        "last_error",
    )


def host_token_mix(cat: Catalog, w: TimeWindow) -> DataFrame:
    """Q31: share of each token kind per host."""
    h = host_stats(cat, w)
    tot = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation") + F.col("cache_read")
    return h.select(
        "host",
        ratio(F.col("input_tokens"), tot).alias("input_share"),
        ratio(F.col("output_tokens"), tot).alias("output_share"),
        ratio(F.col("cache_creation"), tot).alias("cache_creation_share"),
        ratio(F.col("cache_read"), tot).alias("cache_read_share"),
    )

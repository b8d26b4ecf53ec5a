"""Cost dashboard queries (Q1-Q11)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cost import cost_units, units_to_e4, units_to_usd
from ..functions.dates import TimeWindow
from ..functions.formatting import delta_pct, delta_pp
from ..operators.quantiles import percentile_cont
from .catalog import Catalog
from .common import day_in, day_str, in_list, in_window, ntz, ratio, ts_lit, where

E4 = 10000.0


def token_totals(cat: Catalog, w: TimeWindow, hosts=None) -> DataFrame:
    """Q1: token sums over sessions started in the window (A2: empty -> 0)."""
    s = where(cat.sessions, in_window("started_at", w), in_list("host", hosts))
    sums = [
        F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(a)
        for c, a in [
            ("total_input_tokens", "input"),
            ("total_output_tokens", "output"),
            ("total_cache_creation", "cache_creation"),
            ("total_cache_read", "cache_read"),
        ]
    ]
    return s.agg(*sums).withColumn(
        "total", F.col("input") + F.col("output") + F.col("cache_creation") + F.col("cache_read")
    )


def cost_kpis(cat: Catalog, w: TimeWindow, today: dt.datetime, hosts=None) -> DataFrame:
    """Q2 (+Q6): spend today / in window / in prior window in one scan (A3)."""
    p = w.prior()
    s = where(cat.sessions, in_list("host", hosts))
    c = F.col("cost_e4")

    def csum(cond):
        return (F.coalesce(F.sum(F.when(cond, c)), F.lit(0)) / F.lit(E4)).cast("double")

    out = s.agg(
        csum(F.col("started_at") >= ts_lit(today)).alias("today_cost"),
        csum(in_window("started_at", w)).alias("window_cost"),
        csum(in_window("started_at", p)).alias("window_cost_prior"),
    )
    return out.withColumn("cost_delta_pct", delta_pct(F.col("window_cost"), F.col("window_cost_prior")))


def cache_kpis(cat: Catalog, w: TimeWindow, hosts=None) -> DataFrame:
    """Q3 (+Q6): cache-hit share of input in window and prior window, from usage_daily."""
    p = w.prior()
    u = where(cat.usage_daily, in_list("host", hosts))
    cur = day_in("day", w.start_day, w.end_day)
    pri = day_in("day", p.start_day, p.end_day)

    def s(col, cond):
        return F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0)).cast("long")

    out = u.agg(
        s("input_tokens", cur).alias("in_tok"),
        s("cache_read", cur).alias("cache"),
        s("input_tokens", pri).alias("in_tok_prior"),
        s("cache_read", pri).alias("cache_prior"),
    )
    hit = F.when(F.col("in_tok") + F.col("cache") > 0, F.col("cache") / (F.col("in_tok") + F.col("cache"))).otherwise(0.0)
    hitp = F.when(F.col("in_tok_prior") + F.col("cache_prior") > 0,
                  F.col("cache_prior") / (F.col("in_tok_prior") + F.col("cache_prior"))).otherwise(0.0)
    return out.select(
        "in_tok", "cache", "in_tok_prior", "cache_prior",
        F.round(hit, 6).alias("cache_hit_pct"),
        F.round(hitp, 6).alias("cache_hit_pct_prior"),
        delta_pp(hit, hitp).alias("cache_delta_pp"),
    )


def _priced_assistant(cat: Catalog, hosts=None) -> DataFrame:
    m = where(cat.messages, F.col("role") == "assistant", in_list("host", hosts))
    return m.join(F.broadcast(cat.pricing), "model", "left").withColumn("units", cost_units())


def top_model_share(cat: Catalog, w: TimeWindow, hosts=None) -> DataFrame:
    """Q4 (+Q6): top model by cost among the top 5 of the window, its share of those 5,
    and its share of *all* models' cost in the prior window (N15). One scan of messages
    with conditional sums; the ranking runs on one row per model."""
    p = w.prior()
    m = _priced_assistant(cat, hosts).filter(in_window("timestamp", w) | in_window("timestamp", p))
    per = m.groupBy("model").agg(
        F.coalesce(F.sum(F.when(in_window("timestamp", w), F.col("units"))), F.lit(0)).alias("u_cur"),
        F.coalesce(F.sum(F.when(in_window("timestamp", p), F.col("units"))), F.lit(0)).alias("u_prior"),
        F.count(F.when(in_window("timestamp", w), True)).alias("n_cur"),
    )
    everything = Window.partitionBy(F.lit(0))
    ranked = per.withColumn(
        "rk",
        F.when(F.col("n_cur") > 0, F.row_number().over(
            Window.partitionBy(F.col("n_cur") > 0).orderBy(F.desc("u_cur"), F.asc_nulls_last("model")))),
    ).withColumn("prior_total", F.sum("u_prior").over(everything)).withColumn(
        "top5_total", F.sum(F.when(F.col("rk") <= 5, F.col("u_cur"))).over(everything)
    )
    top = ranked.filter((F.col("rk") == 1) & F.col("model").isNotNull())
    pct = F.when(F.col("top5_total") > 0, F.col("u_cur") / F.col("top5_total")).otherwise(0.0)
    pct_prior = F.when(F.col("prior_total") > 0, F.col("u_prior") / F.col("prior_total")).otherwise(0.0)
    return top.select(
        F.col("model").alias("top_model"),
        units_to_usd(F.col("u_cur")).alias("top_model_cost"),
        F.round(pct, 6).alias("pct_of_cost"),
        F.round(pct_prior, 6).alias("pct_prior"),
        delta_pp(pct, pct_prior).alias("share_delta_pp"),
    )


def active_sessions(cat: Catalog, hosts=None, sample: int = 3) -> DataFrame:
    """Q5: active sessions, newest first, with the true count beside the sample.
    PostgreSQL's plain DESC puts NULL start times first (N21), so does this. The count
    is a scalar subquery, not a join."""
    s = where(cat.sessions, F.col("status") == "active", in_list("host", hosts))
    n = s.select(F.count(F.lit(1))).scalar()
    top = s.orderBy(F.desc_nulls_first("started_at"), F.asc("session_id")).limit(sample)
    return top.select(
        "session_id", "project_path", ntz("started_at").alias("started_at"), n.alias("active_count")
    )


def _ud_units():
    return (
        F.col("input_tokens") * F.col("input_c")
        + F.col("output_tokens") * F.col("output_c")
        + F.col("cache_creation") * F.col("cache_write_5m_c")
        + F.col("cache_read") * F.col("cache_read_c")
    )


def spend_by_model(cat: Catalog, w: TimeWindow, hosts=None) -> DataFrame:
    """Q7: spend per day and model from the daily aggregate."""
    u = where(cat.usage_daily, day_in("day", w.start_day, w.end_day), in_list("host", hosts))
    j = u.join(F.broadcast(cat.pricing), "model", "left")
    return j.groupBy("day", "model").agg(F.coalesce(F.sum(_ud_units()), F.lit(0)).alias("u")).select(
        day_str("day").alias("day"), "model", units_to_usd(F.col("u")).alias("cost")
    )


def spend_pivot(cat: Catalog, w: TimeWindow, models: list[str], hosts=None) -> DataFrame:
    """Day x model spend matrix, zero-filled, 4 decimals (rounded in integer units,
    half away from zero). The model list is explicit, so the pivot width is bounded and
    no extra job runs to discover the values."""
    u = where(cat.usage_daily, day_in("day", w.start_day, w.end_day), in_list("host", hosts))
    j = u.join(F.broadcast(cat.pricing), "model", "left")
    per = j.groupBy("day", "model").agg(F.coalesce(F.sum(_ud_units()), F.lit(0)).alias("u"))
    per = per.withColumn("e4", units_to_e4(F.col("u")))
    wide = per.groupBy(day_str("day").alias("day")).pivot("model", models).agg(F.sum("e4"))
    return wide.select("day", *[(F.coalesce(F.col(f"`{m}`"), F.lit(0)) / F.lit(E4)).alias(m) for m in models])


def top_cost_sessions(cat: Catalog, w: TimeWindow, limit: int = 5, hosts=None) -> DataFrame:
    """Q8: most expensive sessions started in the window (O1, O2, unique tie-break)."""
    s = where(cat.sessions, in_window("started_at", w), F.col("cost_e4").isNotNull(), in_list("host", hosts))
    top = s.orderBy(F.desc_nulls_last("cost_e4"), F.asc("session_id")).limit(limit)
    return top.select(
        "session_id",
        "project_path",
        ntz("started_at").alias("started_at"),
        "duration_sec",
        "message_count",
        F.array_join("models_used", ",").alias("models_used"),
        (F.col("cost_e4") / F.lit(E4)).alias("cost"),
    )


def cost_distribution(cat: Catalog, w: TimeWindow, hosts=None, approx: bool = False) -> DataFrame:
    """Q9: p50/p95/p99/max/n of session cost. Exact continuous percentiles, size-checked
    (``operators.quantiles.percentile_cont``: a group too large for one task is ranked,
    never gathered); ``approx=True`` uses Spark's bounded-memory ``percentile_approx``."""
    s = where(cat.sessions, in_window("started_at", w), F.col("cost_e4").isNotNull(), in_list("host", hosts))
    c = F.col("cost_e4") / F.lit(E4)
    if approx:
        return s.agg(*[F.round(F.percentile_approx(c, p, 100000), 6).alias(k) for k, p in
                       (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))], F.max(c).alias("max"), F.count(F.lit(1)).alias("n"))
    pc = percentile_cont(s.select(c.alias("c")), [], "c", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    one = pc.select(F.struct("p50", "p95", "p99").alias("q")).scalar()  # a single-row subquery
    return s.agg(F.max(c).alias("max"), F.count(F.lit(1)).alias("n")).select(
        *[F.round(one[k], 6).alias(k) for k in ("p50", "p95", "p99")], "max", "n")


def cache_hit_trend(cat: Catalog, w: TimeWindow, hosts=None) -> DataFrame:
    """Q10: daily cache-hit share."""
    u = where(cat.usage_daily, day_in("day", w.start_day, w.end_day), in_list("host", hosts))
    g = u.groupBy("day").agg(F.sum("cache_read").alias("cr"), F.sum(F.col("input_tokens") + F.col("cache_read")).alias("den"))
    return g.select(day_str("day").alias("day"), ratio(F.col("cr"), F.col("den")).alias("hit_pct"))


def active_hours_heatmap(cat: Catalog, w: TimeWindow, now: dt.datetime, hosts=None, tz: str = "America/New_York") -> DataFrame:
    """Q11: sessions per (weekday, hour) in ``tz`` over at least the last 30 days (N19),
    densified to the full 7 x 24 grid (O6)."""
    start = min(w.start, now - dt.timedelta(days=30))
    s = where(cat.sessions, F.col("started_at").between(ts_lit(start), ts_lit(w.end)), in_list("host", hosts))
    local = F.from_utc_timestamp("started_at", tz)
    counts = s.groupBy(
        (F.dayofweek(local) - 1).alias("dow"), F.hour(local).alias("hour")
    ).agg(F.count(F.lit(1)).alias("n"))
    spark = cat.spark
    grid = spark.range(7 * 24).select(
        (F.col("id") / 24).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour")
    )
    return grid.join(counts, ["dow", "hour"], "left").select(
        "dow", "hour", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )

"""Command-line report queries (Q32-Q36)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cost import cost_units, units_to_e2
from .catalog import Catalog
from .common import ntz, ts_lit


def top_models(cat: Catalog, since: dt.datetime, k: int = 10) -> DataFrame:
    """Q32: tokens and cost per model since ``since``; cost rounded to cents, NULL when
    no message of the model could be priced (sorted last)."""
    m = cat.messages.filter(
        (F.col("role") == "assistant") & (F.col("timestamp") >= ts_lit(since)) & F.col("model").isNotNull()
    ).join(F.broadcast(cat.pricing), "model", "left")
    g = m.groupBy("model").agg(
        F.sum("input_tokens").alias("in_tok"), F.sum("output_tokens").alias("out_tok"), F.sum(cost_units()).alias("u")
    )
    top = g.orderBy(F.desc_nulls_last("u"), F.asc("model")).limit(k)
    return top.select("model", "in_tok", "out_tok", (units_to_e2(F.col("u")) / F.lit(100.0)).alias("cost"))


def top_projects(cat: Catalog, since: dt.datetime, k: int = 10) -> DataFrame:
    """Q33: sessions and cost per project since ``since``."""
    s = cat.sessions.filter(F.col("started_at") >= ts_lit(since))
    g = s.groupBy("project_path").agg(F.count(F.lit(1)).alias("sessions"), F.sum("cost_e4").alias("e4"))
    top = g.orderBy(F.desc_nulls_last("e4"), F.asc_nulls_last("project_path")).limit(k)
    cents = F.expr("(e4 + 50) div 100")
    return top.select("project_path", "sessions", (cents / F.lit(100.0)).alias("cost"))


def top_tools(cat: Catalog, since: dt.datetime, k: int = 10) -> DataFrame:
    """Q34: calls, errors and error percentage per tool since ``since``."""
    t = cat.tool_calls.filter(F.col("timestamp") >= ts_lit(since))
    g = t.groupBy("tool_name").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("is_error"), True)).alias("errors"))
    top = g.orderBy(F.desc("calls"), F.asc("tool_name")).limit(k)
    return top.select("tool_name", "calls", "errors",
                      F.round(F.when(F.col("calls") > 0, F.col("errors") * 100.0 / F.col("calls")).otherwise(0.0), 4).alias("error_pct"))


def store_status(cat: Catalog) -> DataFrame:
    """Q35: event count and last event time, session and active-session counts. Two
    global aggregates combined by scalar subqueries (no join)."""
    s = cat.sessions.agg(
        F.count(F.lit(1)).alias("sessions"), F.count(F.when(F.col("status") == "active", True)).alias("active_sessions")
    )
    e = cat.events.agg(F.count(F.lit(1)).alias("events"), F.max("timestamp").alias("last_event"))
    one = s.select(F.struct("sessions", "active_sessions").alias("x")).scalar()  # one scan of sessions
    return e.select(
        "events", ntz("last_event").alias("last_event"),
        one["sessions"].alias("sessions"),
        one["active_sessions"].alias("active_sessions"),
    )


def host_schedule(cat: Catalog, now: dt.datetime) -> DataFrame:
    """Q36 (J8, O5): events per host with the next pull time and a health class:
    green for 'local' or no errors, yellow for 1-2, red for 3+. Minutes until the next
    pull round half up; 0 means due now; NULL when never pulled."""
    ev = cat.events.groupBy("host").agg(F.count(F.lit(1)).alias("events"))
    hss = cat.host_sync_state.select("host", "last_pulled_at", "current_interval_hours", "consecutive_errors")
    j = ev.join(hss, "host", "left")
    due_ms = (F.unix_micros("last_pulled_at") + F.col("current_interval_hours").cast("long") * 3600 * 1000000
              - F.unix_micros(ts_lit(now))) / 1000
    due_ms = F.floor(due_ms).cast("long")
    minutes = F.when(F.col("last_pulled_at").isNull() | F.col("current_interval_hours").isNull(), F.lit(None)).when(
        due_ms <= 0, F.lit(0)).otherwise(F.expr("0") + F.floor((due_ms + 30000) / 60000)).cast("long")
    errs = F.coalesce("consecutive_errors", F.lit(0))
    health = F.when((F.col("host") == "local") | (errs == 0), "green").when(errs <= 2, "yellow").otherwise("red")
    return j.select(
        "host", "events", ntz("last_pulled_at").alias("last_pulled_at"), "current_interval_hours",
        minutes.alias("next_in_minutes"), health.alias("health"),
        F.when(F.col("host") == "local", 0).otherwise(1).alias("sort_group"),
    ).orderBy("sort_group", "host")  # O5: 'local' first, then alphabetical

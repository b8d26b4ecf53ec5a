"""Session listing and session-detail queries (Q17-Q24).

The detail queries (Q19-Q24) take an optional ``session_id``; without it they run for
every session at once (one grouped plan instead of one query per page view).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cost import cost_units
from ..functions.dates import TimeWindow
from ..functions.formatting import squeeze_ws
from ..operators.skew import top_k_per_group
from .catalog import Catalog
from .common import in_list, in_window, ntz, ratio, where

FILE_TOOLS = ["Read", "Write", "Edit", "MultiEdit", "NotebookEdit"]


def _like_escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def session_filters(project=None, window: TimeWindow | None = None, models=None, hosts=None,
                    literal_project: bool = False) -> list[Column | None]:
    """The optional filters shared by Q17, Q18 (and Q25 for project)."""
    proj = None
    if project:
        p = _like_escape(project) if literal_project else project
        proj = F.col("project_path").ilike(f"%{p}%")
    return [
        proj,
        in_window("started_at", window) if window else None,
        F.arrays_overlap("models_used", F.array(*[F.lit(m) for m in models])) if models else None,
        in_list("host", hosts),
    ]


def list_sessions(cat: Catalog, project=None, window=None, models=None, hosts=None,
                  sort: str = "recent", limit: int = 50, offset: int = 0) -> DataFrame:
    """Q17: filtered, sorted, paged session list (O2, O3; N21 for NULL start times)."""
    s = where(cat.sessions, *session_filters(project, window, models, hosts))
    if sort == "cost":
        order = [F.desc_nulls_last("cost_e4"), F.asc("session_id")]
    else:
        order = [F.desc_nulls_first("started_at"), F.asc("session_id")]
    page = s.orderBy(*order).offset(offset).limit(limit)
    return page.select(
        "session_id", "project_path", ntz("started_at").alias("started_at"), "duration_sec",
        "message_count", "tool_call_count", (F.col("cost_e4") / F.lit(10000.0)).alias("cost"),
        F.col("first_user_prompt").alias("first_prompt"), "status",
        F.array_join("models_used", ",").alias("models_used"), "host",
    )


def count_sessions(cat: Catalog, project=None, window=None, models=None, hosts=None) -> DataFrame:
    """Q18: the matching count for Q17's filters."""
    s = where(cat.sessions, *session_filters(project, window, models, hosts))
    return s.agg(F.count(F.lit(1)).alias("n"))


def session_meta(cat: Catalog, session_id: str | None = None) -> DataFrame:
    """Q19: the session row(s)."""
    s = where(cat.sessions, F.col("session_id") == session_id if session_id else None)
    return s.select(
        "session_id", "project_path", ntz("started_at").alias("started_at"), ntz("ended_at").alias("ended_at"),
        "duration_sec", "message_count", "tool_call_count", "subagent_count", "git_branch", "cc_version",
        F.array_join("models_used", ",").alias("models_used"), "total_input_tokens", "total_output_tokens",
        "total_cache_creation", "total_cache_read", (F.col("cost_e4") / F.lit(10000.0)).alias("cost"),
        "first_user_prompt", "status", "host",
    )


def session_replay(cat: Catalog, session_id: str | None = None, preview_chars: int = 120) -> DataFrame:
    """Q20 (J10): events in time order with their tool call and a whitespace-squeezed
    preview of the message text."""
    cond = (F.col("session_id") == session_id) if session_id else None
    e = where(cat.events.select("uuid", "session_id", "timestamp", "type", "subtype", "is_sidechain"), cond)
    m = where(cat.messages.select("uuid", "session_id", "text_content"), cond).drop("session_id")
    t = where(cat.tool_calls.select("uuid", "session_id", "tool_name", "duration_ms", "is_error"), cond).drop("session_id")
    j = e.join(m, "uuid", "left").join(t, "uuid", "left")
    return j.select(
        "uuid", "session_id", ntz("timestamp").alias("timestamp"), "type", "subtype", "is_sidechain",
        "tool_name", "duration_ms", "is_error",
        F.substring(squeeze_ws(F.col("text_content")), 1, preview_chars).alias("preview"),
    )


def session_stats(cat: Catalog, session_id: str | None = None) -> DataFrame:
    """Q21 (A10, A8): per-session token sums, cache-hit share and cost by model, for all
    sessions at once. ``cost_by_model`` lists ``model=units`` (1e-8 USD), costliest first."""
    m = where(cat.messages, F.col("role") == "assistant", F.col("model").isNotNull(),
              (F.col("session_id") == session_id) if session_id else None)
    m = m.join(F.broadcast(cat.pricing), "model", "left").withColumn("u", cost_units())
    per_model = m.groupBy("session_id", "model").agg(
        F.sum("input_tokens").alias("in_tok"), F.sum("output_tokens").alias("out_tok"),
        F.sum("cache_read_tokens").alias("cache_read"), F.sum("cache_creation_tokens").alias("cache_create"),
        F.coalesce(F.sum("u"), F.lit(0)).alias("units"),
    )
    s = per_model.groupBy("session_id").agg(
        F.coalesce(F.sum("in_tok"), F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce(F.sum("out_tok"), F.lit(0)).cast("long").alias("output_tokens"),
        F.coalesce(F.sum("cache_read"), F.lit(0)).cast("long").alias("cache_read_tokens"),
        F.coalesce(F.sum("cache_create"), F.lit(0)).cast("long").alias("cache_create_tokens"),
        F.sum("units").alias("units"),
        F.sort_array(F.collect_list(F.struct((-F.col("units")).alias("neg"), "model"))).alias("cbm"),
    )
    return s.select(
        "session_id", "input_tokens", "output_tokens", "cache_read_tokens", "cache_create_tokens",
        ratio(F.col("cache_read_tokens"), F.col("input_tokens") + F.col("cache_read_tokens")).alias("cache_hit_pct"),
        (F.col("units") / F.lit(1e8)).alias("cost"),
        F.array_join(F.transform("cbm", lambda x: F.concat(x["model"], F.lit("="), (-x["neg"]).cast("string"))), ";").alias("cost_by_model"),
    )


def session_top_tools(cat: Catalog, session_id: str | None = None, k: int = 5) -> DataFrame:
    """Q22: per session, the k most used tools with their error counts."""
    t = where(cat.tool_calls, (F.col("session_id") == session_id) if session_id else None)
    g = t.groupBy("session_id", "tool_name").agg(
        F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("is_error"), True)).alias("errors")
    )
    return top_k_per_group(g, "session_id", [F.desc("calls"), F.asc("tool_name")], k)


def session_files_touched(cat: Catalog, session_id: str | None = None, k: int = 5) -> DataFrame:
    """Q23 (P9): per session, the k most touched files and the number of distinct files."""
    f = F.get_json_object("input", "$.file_path")
    t = where(cat.tool_calls.select("session_id", "tool_name", f.alias("file")),
              F.col("tool_name").isin(FILE_TOOLS), F.col("file").isNotNull(),
              (F.col("session_id") == session_id) if session_id else None)
    g = t.groupBy("session_id", "file").agg(F.count(F.lit(1)).alias("n"))
    totals = g.groupBy("session_id").agg(F.count(F.lit(1)).alias("total_files"))
    top = top_k_per_group(g, "session_id", [F.desc("n"), F.asc("file")], k)
    return top.join(totals, "session_id")


def session_first_prompts(cat: Catalog, session_id: str | None = None, k: int = 3, chars: int = 140) -> DataFrame:
    """Q24: the first k main-thread user prompts of each session, cut to ``chars``."""
    m = where(cat.messages.select("uuid", "session_id", "role", "timestamp", "text_content", "is_sidechain"),
              F.col("role") == "user", ~F.col("is_sidechain"), F.col("text_content").isNotNull(),
              (F.col("session_id") == session_id) if session_id else None)
    top = top_k_per_group(m, "session_id", [F.asc("timestamp"), F.asc("uuid")], k)
    return top.select("session_id", "rank", ntz("timestamp").alias("ts"),
                      F.substring("text_content", 1, chars).alias("text"))


def session_payloads(cat: Catalog, session_id: str) -> DataFrame:
    """A session's events with their raw payload as JSON."""
    e = cat.events.filter(F.col("session_id") == session_id)
    kind = e.schema["payload"].dataType.simpleString()
    raw = F.col("payload") if kind == "string" else F.to_json("payload")
    return e.select("uuid", ntz("timestamp").alias("timestamp"), "type", "subtype", raw.alias("payload"))


def resolve_session_prefix(cat: Catalog, prefix: str) -> DataFrame:
    """Up to two session ids starting with ``prefix``: none = unknown, one = the
    session, two = ambiguous (the caller asks for more characters)."""
    s = cat.events.select("session_id").filter(F.col("session_id").startswith(prefix)).distinct()
    return s.orderBy("session_id").limit(2)

"""Derivations of the canonical tables (D4 pairing, D5 session rollup, D6 daily usage).

All are single DataFrame plans. Hot keys are handled by partial aggregation: every
per-session aggregate is algebraic (sum/count/min/max over structs), so a session
holding a third of all rows is combined map-side before the shuffle. Joins that fan
out on a session key only happen after a pre-aggregation to one row per session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cost import cost_units, units_to_e4


def first_by_time(value: str | Column, ts: str = "timestamp", tie: str = "uuid", cond: Column | None = None) -> Column:
    """First non-null ``value`` in (ts, tie) order, as a partial-aggregation friendly min."""
    v = F.col(value) if isinstance(value, str) else value
    keep = v.isNotNull() if cond is None else (v.isNotNull() & cond)
    return F.min(F.when(keep, F.struct(F.col(ts).alias("t"), F.col(tie).alias("k"), v.alias("v"))))["v"]


def pair_tool_calls(tool_uses: DataFrame, tool_results: DataFrame) -> DataFrame:
    """D3/D4 (J9): attach each tool_use to its tool_result.

    Pairing key is (source_file, tool_use_id); across the whole file, not one batch
    (N9 improved). If several results carry the same id, the last by (timestamp, uuid)
    wins (N10). Unpaired calls get NULL result, duration and ``is_error``. Only the
    first tool_use block of an assistant event survives (N8: key = event uuid).
    """
    uses = first_uses(tool_uses) if "block_pos" in tool_uses.columns else tool_uses
    return paired(uses, fold_results(last_results(tool_results)))


def first_uses(uses: DataFrame) -> DataFrame:
    """The first block per event uuid (partial-aggregated min over a struct)."""
    cols = [c for c in uses.columns if c not in ("uuid", "block_pos")]
    return uses.groupBy("uuid").agg(F.min(F.struct("block_pos", *cols)).alias("_u")).select(
        "uuid", *[F.col(f"_u.{c}").alias(c) for c in cols])


def last_results(results: DataFrame) -> DataFrame:
    """The last result per call among some of the results, a partial state that
    ``fold_results`` merges."""
    r = F.struct(F.col("timestamp").alias("t"), F.col("uuid").alias("k"), "content", "is_error")
    return results.select("source_file", "tool_use_id", r.alias("r"))


def fold_results(parts: DataFrame) -> DataFrame:
    return parts.groupBy("source_file", "tool_use_id").agg(F.max("r").alias("r"))


def paired(uses: DataFrame, last: DataFrame) -> DataFrame:
    """Calls (one use per event) with the last result of each (source_file, tool_use_id)."""
    j = uses.join(last, ["source_file", "tool_use_id"], "left")
    return j.select(
        "uuid",
        "session_id",
        "timestamp",
        "tool_name",
        "input",
        F.col("r.content").alias("result"),
        F.col("r.k").alias("result_uuid"),
        F.when(
            F.col("r").isNotNull(),
            F.greatest(F.lit(0), F.unix_millis(F.col("r.t")) - F.unix_millis("timestamp")),
        ).cast("int").alias("duration_ms"),
        F.col("r.is_error").alias("is_error"),
        F.col("uuid").alias("parent_message_uuid"),
        "host",
    )


def rollup_sessions(
    events: DataFrame,
    messages: DataFrame,
    tool_calls: DataFrame,
    pricing: DataFrame,
) -> DataFrame:
    """One row per session (J1, J2, J11 decorrelated into pre-aggregates).

    * project_path / git_branch / cc_version: first non-null in (timestamp, uuid) order
      (N7, deterministic form of the reference's unordered ``array_agg[1]``).
    * duration_sec rounds to nearest (N13); message_count counts user/assistant events
      even without a message (N6); token sums cover all messages, cost only assistant
      ones (N5); cost rounds to 1e-4 USD (N12), unknown models cost 0 (N2).
    """
    m = messages.select(
        "uuid",
        F.col("role").alias("m_role"),
        F.col("model").alias("m_model"),
        F.col("text_content").alias("m_text"),
        "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens",
    ).join(F.broadcast(pricing.select("model", "input_c", "output_c", "cache_write_5m_c", "cache_read_c")),
           F.col("m_model") == F.col("model"), "left").drop("model")
    e = events.select(
        "uuid", "session_id", "type", "timestamp", "cwd", "git_branch", "cc_version",
        "is_sidechain", "agent_id", "host",
    )
    j = e.join(m, "uuid", "left")
    units = F.when(F.col("m_role") == "assistant", cost_units())
    agg = j.groupBy("session_id").agg(
        first_by_time("cwd").alias("project_path"),
        F.min("timestamp").alias("started_at"),
        F.max("timestamp").alias("ended_at"),
        F.count(F.when(F.col("type").isin("user", "assistant"), True)).cast("int").alias("message_count"),
        F.size(F.collect_set(F.when(F.col("is_sidechain"), F.col("agent_id")))).cast("int").alias("subagent_count"),
        first_by_time("git_branch").alias("git_branch"),
        first_by_time("cc_version").alias("cc_version"),
        F.array_sort(F.collect_set("m_model")).alias("models_used"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("total_output_tokens"),
        F.coalesce(F.sum("cache_creation_tokens"), F.lit(0)).cast("long").alias("total_cache_creation"),
        F.coalesce(F.sum("cache_read_tokens"), F.lit(0)).cast("long").alias("total_cache_read"),
        F.coalesce(F.sum(units), F.lit(0)).alias("cost_units"),
        first_by_time("m_text", cond=F.col("m_role") == "user").alias("first_user_prompt"),
        F.min("host").alias("host"),
    )
    tc = tool_calls.groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("tool_call_count"))
    cost_e4 = units_to_e4(F.col("cost_units"))
    return agg.join(tc, "session_id", "left").select(
        "session_id",
        "project_path",
        "started_at",
        "ended_at",
        F.expr("(unix_micros(ended_at) - unix_micros(started_at) + 500000) div 1000000").cast("int").alias("duration_sec"),
        "message_count",
        F.coalesce("tool_call_count", F.lit(0)).alias("tool_call_count"),
        "subagent_count",
        "git_branch",
        "cc_version",
        "models_used",
        "total_input_tokens",
        "total_output_tokens",
        "total_cache_creation",
        "total_cache_read",
        cost_e4.alias("cost_e4"),
        (cost_e4.cast("decimal(14,0)") / 10000).cast("decimal(10,4)").alias("estimated_cost_usd"),
        "first_user_prompt",
        F.lit("ended").alias("status"),
        "host",
    )


#: Sums of a session's partial states.
SESSION_SUMS = ["message_count", "tool_call_count", "total_input_tokens", "total_output_tokens", "total_cache_creation", "total_cache_read", "cost_units"]


def _first(value: str, cond: Column | None = None) -> Column:
    keep = F.col(value).isNotNull() if cond is None else F.col(value).isNotNull() & cond
    return F.min(F.when(keep, F.struct(F.col("timestamp").alias("t"), F.col("uuid").alias("k"), F.col(value).alias("v"))))


def session_parts(events: DataFrame, messages: DataFrame, uses: DataFrame, pricing: DataFrame) -> DataFrame:
    """D5 as mergeable partial states, from some of the sessions' events with their messages
    and tool uses (one per event): sums, earliest values with their (timestamp, uuid), sets.
    ``fold_session_parts`` merges them, ``finish_sessions`` makes the rows of ``rollup_sessions``."""
    m = messages.select(
        "uuid", F.col("role").alias("m_role"), F.col("model").alias("m_model"), F.col("text_content").alias("m_text"),
        "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens",
    )
    e = events.select("uuid", "session_id", "type", "timestamp", "cwd", "git_branch", "cc_version", "is_sidechain", "agent_id", "host")
    return session_parts_lines(e.join(m, "uuid", "left").join(uses.select("uuid", F.lit(1).alias("used")), "uuid", "left"), pricing)


def session_parts_lines(lines: DataFrame, pricing: DataFrame) -> DataFrame:
    """``session_parts`` of events that have their messages' columns beside them (m_role, m_model,
    m_text, tokens) and ``used``: not null where they use a tool."""
    prices = F.broadcast(pricing.select("model", "input_c", "output_c", "cache_write_5m_c", "cache_read_c"))
    j = lines.join(prices, F.col("m_model") == F.col("model"), "left").drop("model")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return j.groupBy("session_id").agg(
        _first("cwd").alias("project_path"), _first("git_branch").alias("git_branch"), _first("cc_version").alias("cc_version"),
        _first("m_text", F.col("m_role") == "user").alias("first_user_prompt"),
        F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"), F.min("host").alias("host"),
        F.array_sort(F.collect_set(F.when(F.col("is_sidechain"), F.col("agent_id")))).alias("agents"),
        F.array_sort(F.collect_set("m_model")).alias("models_used"),
        F.count(F.when(F.col("type").isin("user", "assistant"), True)).alias("message_count"), F.count("used").alias("tool_call_count"),
        total("input_tokens").alias("total_input_tokens"), total("output_tokens").alias("total_output_tokens"),
        total("cache_creation_tokens").alias("total_cache_creation"), total("cache_read_tokens").alias("total_cache_read"),
        total(F.when(F.col("m_role") == "assistant", cost_units())).alias("cost_units"),
    )


def fold_session_parts(parts: DataFrame) -> DataFrame:
    """Partial states merged: one per session. A store has at most as many of a session as it
    has segments."""
    firsts = ["project_path", "git_branch", "cc_version", "first_user_prompt"]
    sets = ["agents", "models_used"]
    return parts.groupBy("session_id").agg(
        *(F.min(c).alias(c) for c in firsts), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.min("host").alias("host"),
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets), *(F.sum(c).alias(c) for c in SESSION_SUMS),
    ).select(*parts.columns)


def finish_sessions(folded: DataFrame) -> DataFrame:
    """The session rows of folded partial states."""
    value = {c: F.col(c)["v"] for c in ("project_path", "git_branch", "cc_version", "first_user_prompt")}
    return _finish_sessions(folded.withColumns(value | {
        "subagent_count": F.size("agents").cast("int"), "message_count": F.col("message_count").cast("int"), "tool_call_count": F.col("tool_call_count").cast("int")}))


def rollup_sessions_lines(lines: DataFrame, pricing: DataFrame) -> DataFrame:
    """D5 when events and messages are one table (every line is an event and, for
    user/assistant lines, its message) and each tool-use line yields one tool call:
    the same result as ``rollup_sessions`` in a single aggregation, without the uuid
    self-join and without the pairing join (``tool_call_count`` counts the uses)."""
    m = lines.withColumnRenamed("model", "m_model").join(
        F.broadcast(pricing.select("model", "input_c", "output_c", "cache_write_5m_c", "cache_read_c")),
        F.col("m_model") == F.col("model"), "left").drop("model")
    units = F.when(F.col("role") == "assistant", cost_units())
    agg = m.groupBy("session_id").agg(
        first_by_time("cwd").alias("project_path"),
        F.min("timestamp").alias("started_at"),
        F.max("timestamp").alias("ended_at"),
        F.count(F.when(F.col("type").isin("user", "assistant"), True)).cast("int").alias("message_count"),
        F.count(F.col("tool_name")).cast("int").alias("tool_call_count"),
        F.size(F.collect_set(F.when(F.col("is_sidechain"), F.col("agent_id")))).cast("int").alias("subagent_count"),
        first_by_time("git_branch").alias("git_branch"),
        first_by_time("cc_version").alias("cc_version"),
        F.array_sort(F.collect_set("m_model")).alias("models_used"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("total_output_tokens"),
        F.coalesce(F.sum("cache_creation_tokens"), F.lit(0)).cast("long").alias("total_cache_creation"),
        F.coalesce(F.sum("cache_read_tokens"), F.lit(0)).cast("long").alias("total_cache_read"),
        F.coalesce(F.sum(units), F.lit(0)).alias("cost_units"),
        first_by_time("text_content", cond=F.col("role") == "user").alias("first_user_prompt"),
        F.min("host").alias("host"),
    )
    return _finish_sessions(agg)


def _finish_sessions(agg: DataFrame) -> DataFrame:
    cost_e4 = units_to_e4(F.col("cost_units"))
    return agg.select(
        "session_id", "project_path", "started_at", "ended_at",
        F.expr("(unix_micros(ended_at) - unix_micros(started_at) + 500000) div 1000000").cast("int").alias("duration_sec"),
        "message_count", F.coalesce("tool_call_count", F.lit(0)).alias("tool_call_count"), "subagent_count",
        "git_branch", "cc_version", "models_used", "total_input_tokens", "total_output_tokens",
        "total_cache_creation", "total_cache_read", cost_e4.alias("cost_e4"),
        (cost_e4.cast("decimal(14,0)") / 10000).cast("decimal(10,4)").alias("estimated_cost_usd"),
        "first_user_prompt", F.lit("ended").alias("status"), "host",
    )


def usage_parts(messages: DataFrame) -> DataFrame:
    """D6's partial sums: assistant messages per (day, host, session, model)."""
    return (
        messages.filter(F.col("role") == "assistant")
        .groupBy(F.date_trunc("day", "timestamp").alias("day"), "host", "session_id", "model")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("input_tokens").alias("i"),
            F.sum("output_tokens").alias("o"),
            F.sum("cache_creation_tokens").alias("cc"),
            F.sum("cache_read_tokens").alias("cr"),
        )
    )


def fold_usage_parts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("day", "host", "session_id", "model").agg(*(F.sum(c).alias(c) for c in ("n", "i", "o", "cc", "cr")))


def usage_from_parts(parts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Daily usage per (day, host, project_path, model) from partial sums; a session's project
    is the one it has now."""
    s = sessions.select("session_id", "project_path")
    return (
        parts.join(s, "session_id", "inner")
        .groupBy("day", "host", "project_path", "model")
        .agg(
            F.sum("n").cast("long").alias("message_count"),
            F.coalesce(F.sum("i"), F.lit(0)).cast("long").alias("input_tokens"),
            F.coalesce(F.sum("o"), F.lit(0)).cast("long").alias("output_tokens"),
            F.coalesce(F.sum("cc"), F.lit(0)).cast("long").alias("cache_creation"),
            F.coalesce(F.sum("cr"), F.lit(0)).cast("long").alias("cache_read"),
        )
    )


def usage_daily(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Assistant messages per (day, host, project_path, model).

    Messages are first combined per (day, host, session, model), so the join with
    ``sessions`` sees at most days x models rows per session, whatever the session's
    size; then the final group by project path."""
    return usage_from_parts(usage_parts(messages), sessions)

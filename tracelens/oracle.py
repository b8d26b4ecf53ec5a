"""DuckDB SQL that re-derives the canonical tables from the driver's views.

Used only as the correctness oracle: each registered query has a SQL twin built from
these CTEs (``c_lines``, ``c_messages``, ``c_tool_calls``, ``c_sessions``,
``c_usage_daily``, ``c_pricing``, ``c_host_sync_state``). The rules mirror
``tracelens.sources.driver`` exactly.
"""

from __future__ import annotations

from .sources.driver import CHAT_MODELS, EVENT_MODELS
from .sources.pricing import PRICES


def _lst(vals):
    return "[" + ", ".join(f"'{v}'" for v in vals) + "]"


def _pricing_values():
    rows = []
    for m, i, o, w5, w1, r in PRICES:
        c = [str(int(round(float(x) * 100))) for x in (i, o, w5, w1, r)]
        rows.append(f"('{m}', {', '.join(c)})")
    return ",\n    ".join(rows)


S = "CAST({} AS VARCHAR)"


def v(x):
    return S.format(x)


BASE = f"""
e1 AS (
  SELECT event_id, ts, user_id, event_type, value, k,
    'u' || {v('user_id')} || '-' || strftime(ts, '%Y%m%d') AS session_id,
    CASE WHEN user_id % 4 = 0 THEN 'local' ELSE 'h' || {v('user_id % 4')} END AS host,
    CASE WHEN k % 9 = 0 THEN NULL ELSE '/home/dev/proj' || {v('user_id % 6')} END AS cwd,
    CASE WHEN k % 4 = 0 THEN NULL ELSE 'br' || {v('k % 3')} END AS git_branch,
    '2.1.' || {v('k % 4')} AS cc_version,
    k % 8 = 0 AS is_sidechain,
    CASE WHEN k % 8 = 0 THEN 'a' || {v('event_id % 3')} END AS agent_id,
    CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Edit' WHEN 'purchase' THEN 'Write'
                    WHEN 'signup' THEN 'Bash' WHEN 'error' THEN 'Grep' END AS tool,
    epoch_us(ts) AS ts_us,
    epoch_us(ts) + CAST(floor(value * 100) AS BIGINT) * 1000 AS res_us,
    't' || {v('event_id')} AS use_id,
    'e' || {v('event_id')} || 'a' AS a_uuid
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
),
e2 AS (
  SELECT *,
    '/home/dev/.claude/projects/-home-dev-proj' || {v('user_id % 6')} || '/' ||
      CASE WHEN is_sidechain THEN session_id || '/subagents/agent-' || agent_id || '.jsonl'
           ELSE session_id || '.jsonl' END AS source_file,
    CASE WHEN tool IN ('Read', 'Edit', 'Write') THEN '{{"file_path":"/repo/src/m' || {v('k % 17')} || '.py"}}'
         WHEN tool = 'Bash' THEN '{{"command":"make step' || {v('k % 5')} || '"}}'
         ELSE '{{"pattern":"TODO' || {v('k % 5')} || '"}}' END AS tool_input
  FROM e1
),
c1 AS (
  SELECT conv_id, turn, role, text, length(text) AS L,
    'c' || {v('conv_id')} AS session_id,
    role = 'assistant' AS is_asst, role = 'system' AS sidechain,
    CASE WHEN role = 'system' THEN 's' || {v('turn % 2')} END AS agent
  FROM conversations
),
raw_lines AS (
  SELECT session_id, host, cwd, git_branch, cc_version, 'cli' AS entrypoint, is_sidechain, agent_id, source_file,
    a_uuid AS uuid, 'assistant' AS type, 'assistant_message' AS subtype, ts_us AS t_us,
    CAST(NULL AS VARCHAR) AS parent_uuid, 'assistant' AS role,
    ({_lst(EVENT_MODELS)})[(user_id + k) % 5 + 1] AS model,
    'Running ' || tool || ' step ' || {v('k')} AS text_content,
    CAST(k * 37 + 11 AS INTEGER) AS input_tokens, CAST(floor(value * 13) AS INTEGER) AS output_tokens,
    CASE WHEN k % 10 = 3 THEN NULL ELSE CAST(k * 101 AS INTEGER) END AS cache_creation_tokens,
    CAST(((k * k) % 97) * 250 AS INTEGER) AS cache_read_tokens,
    use_id AS tool_use_id, tool AS tool_name, tool_input,
    CAST(NULL AS VARCHAR) AS result_content, CAST(NULL AS BOOLEAN) AS is_error
  FROM e2
  UNION ALL
  SELECT session_id, host, cwd, git_branch, cc_version, 'cli', is_sidechain, agent_id, source_file,
    'e' || {v('event_id')} || 'r', 'user', 'tool_result', res_us, a_uuid, 'user', CAST(NULL AS VARCHAR),
    tool || ' output for ' || event_type || ' #' || {v('k')},
    NULL, NULL, NULL, NULL, use_id, NULL, NULL,
    tool || ' output for ' || event_type || ' #' || {v('k')},
    CASE WHEN k % 10 = 0 THEN NULL ELSE event_type = 'error' END
  FROM e2 WHERE k % 11 <> 5
  UNION ALL
  SELECT session_id, host, cwd, git_branch, cc_version, 'cli', is_sidechain, agent_id, source_file,
    'e' || {v('event_id')} || 's', 'user', 'tool_result', res_us + 1000000, a_uuid, 'user', CAST(NULL AS VARCHAR),
    tool || ' retry failed #' || {v('k')},
    NULL, NULL, NULL, NULL, use_id, NULL, NULL,
    tool || ' retry failed #' || {v('k')}, TRUE
  FROM e2 WHERE k % 11 <> 5 AND k % 13 = 4
  UNION ALL
  SELECT session_id,
    CASE WHEN conv_id % 3 = 0 THEN 'local' ELSE 'h' || {v('conv_id % 3')} END,
    '/home/dev/chat' || {v('conv_id % 5')}, 'main', '2.0.' || {v('conv_id % 3')}, 'sdk', sidechain, agent,
    '/home/dev/.claude/projects/-home-dev-chat' || {v('conv_id % 5')} || '/' ||
      CASE WHEN sidechain THEN session_id || '/subagents/agent-' || agent || '.jsonl' ELSE session_id || '.jsonl' END,
    'c' || {v('conv_id')} || '-' || {v('turn')},
    CASE WHEN is_asst THEN 'assistant' ELSE 'user' END,
    CASE WHEN is_asst THEN 'assistant_message' ELSE 'user_message' END,
    1704067200000000 + (conv_id * 3600 + turn * 700 + L % 600) * 1000000,
    CASE WHEN turn > 0 THEN 'c' || {v('conv_id')} || '-' || {v('turn - 1')} END,
    CASE WHEN is_asst THEN 'assistant' ELSE 'user' END,
    CASE WHEN is_asst THEN ({_lst(CHAT_MODELS)})[conv_id % 4 + 1] END,
    text,
    CASE WHEN is_asst THEN CAST(L * 2 + 100 AS INTEGER) END,
    CASE WHEN is_asst THEN CAST(L AS INTEGER) END,
    CASE WHEN is_asst AND turn % 3 <> 0 THEN CAST(L * 5 AS INTEGER) END,
    CASE WHEN is_asst THEN CAST(L * 40 AS INTEGER) END,
    NULL, NULL, NULL, NULL, CAST(NULL AS BOOLEAN)
  FROM c1
),
c_lines AS (SELECT *, make_timestamp(t_us) AS timestamp FROM raw_lines),
c_messages AS (
  SELECT uuid, session_id, role, timestamp, model, text_content, input_tokens, output_tokens,
         cache_creation_tokens, cache_read_tokens, is_sidechain, host FROM c_lines
),
c_pricing(model, input_c, output_c, cache_write_5m_c, cache_write_1h_c, cache_read_c) AS (
  VALUES
    {_pricing_values()}
),
c_tool_results AS (
  SELECT *, row_number() OVER (PARTITION BY source_file, tool_use_id ORDER BY timestamp DESC, uuid DESC) AS rn
  FROM c_lines WHERE type = 'user' AND tool_use_id IS NOT NULL
),
c_tool_calls AS (
  SELECT u.uuid, u.session_id, u.timestamp, u.tool_name, u.tool_input AS input,
    r.result_content AS result, r.uuid AS result_uuid,
    CASE WHEN r.uuid IS NOT NULL THEN CAST(greatest(0, epoch_ms(r.timestamp) - epoch_ms(u.timestamp)) AS INTEGER) END AS duration_ms,
    r.is_error, u.uuid AS parent_message_uuid, u.host
  FROM (SELECT * FROM c_lines WHERE tool_name IS NOT NULL) u
  LEFT JOIN (SELECT * FROM c_tool_results WHERE rn = 1) r
    ON r.source_file = u.source_file AND r.tool_use_id = u.tool_use_id
),
c_ej AS (
  SELECT l.*, CASE WHEN l.role = 'assistant' THEN
      CAST(l.input_tokens AS BIGINT) * p.input_c + CAST(l.output_tokens AS BIGINT) * p.output_c
    + CAST(l.cache_creation_tokens AS BIGINT) * p.cache_write_5m_c + CAST(l.cache_read_tokens AS BIGINT) * p.cache_read_c
    END AS units
  FROM c_lines l LEFT JOIN c_pricing p ON p.model = l.model
),
c_sagg AS (
  SELECT session_id,
    first(cwd ORDER BY timestamp, uuid) FILTER (WHERE cwd IS NOT NULL) AS project_path,
    min(timestamp) AS started_at, max(timestamp) AS ended_at,
    CAST(count(*) FILTER (WHERE type IN ('user', 'assistant')) AS INTEGER) AS message_count,
    CAST(count(DISTINCT agent_id) FILTER (WHERE is_sidechain) AS INTEGER) AS subagent_count,
    first(git_branch ORDER BY timestamp, uuid) FILTER (WHERE git_branch IS NOT NULL) AS git_branch,
    first(cc_version ORDER BY timestamp, uuid) FILTER (WHERE cc_version IS NOT NULL) AS cc_version,
    list_sort(list_distinct(list(model))) AS models_used,
    CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS total_input_tokens,
    CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS total_output_tokens,
    CAST(coalesce(sum(cache_creation_tokens), 0) AS BIGINT) AS total_cache_creation,
    CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS total_cache_read,
    CAST(coalesce(sum(units), 0) AS BIGINT) AS cost_units,
    first(text_content ORDER BY timestamp, uuid) FILTER (WHERE role = 'user' AND text_content IS NOT NULL) AS first_user_prompt,
    min(host) AS host
  FROM c_ej GROUP BY session_id
),
c_hooks AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id, ts AS timestamp,
    CASE event_type WHEN 'signup' THEN 'active' WHEN 'purchase' THEN 'ended' WHEN 'error' THEN 'ended' END AS status
  FROM events
),
c_live AS (SELECT session_id, arg_max(status, timestamp) AS status FROM c_hooks WHERE status IS NOT NULL GROUP BY session_id),
c_sessions AS (
  SELECT s.session_id, s.project_path, s.started_at, s.ended_at,
    CAST((epoch_us(s.ended_at) - epoch_us(s.started_at) + 500000) // 1000000 AS INTEGER) AS duration_sec,
    s.message_count, CAST(coalesce(t.n, 0) AS INTEGER) AS tool_call_count, s.subagent_count,
    s.git_branch, s.cc_version, s.models_used,
    s.total_input_tokens, s.total_output_tokens, s.total_cache_creation, s.total_cache_read,
    CAST((s.cost_units + 5000) // 10000 AS BIGINT) AS cost_e4,
    s.first_user_prompt, CASE WHEN lv.status = 'active' THEN 'active' ELSE 'ended' END AS status, s.host
  FROM c_sagg s
  LEFT JOIN (SELECT session_id, count(*) AS n FROM c_tool_calls GROUP BY session_id) t USING (session_id)
  LEFT JOIN c_live lv USING (session_id)
),
c_outcomes AS (
  SELECT CASE WHEN user_id % 4 = 0 THEN 'local' ELSE 'h' || CAST(user_id % 4 AS VARCHAR) END AS host, ts AS timestamp,
    CASE WHEN event_type IN ('error', 'click') THEN 'error' WHEN event_type = 'view' THEN 'empty' ELSE 'non-empty' END AS kind,
    CASE WHEN event_type IN ('error', 'click') THEN 'pull failed: event ' || CAST(event_id AS VARCHAR) END AS message
  FROM events
),
c_marks AS (
  SELECT host, max(timestamp) FILTER (WHERE kind <> 'error') AS ls, max(timestamp) FILTER (WHERE kind = 'non-empty') AS ln,
         max(timestamp) FILTER (WHERE kind = 'error') AS last_error_at
  FROM c_outcomes GROUP BY host
),
c_host_sync_state AS (
  SELECT o.host, m.ls AS last_pulled_at, m.ln AS last_had_data_at,
    CAST(CASE count(*) FILTER (WHERE o.kind = 'empty' AND (m.ln IS NULL OR o.timestamp > m.ln))
         WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 12 END AS INTEGER) AS current_interval_hours,
    CAST(count(*) FILTER (WHERE o.kind = 'empty' AND (m.ln IS NULL OR o.timestamp > m.ln)) AS INTEGER) AS consecutive_empty_pulls,
    arg_max(o.message, o.timestamp) FILTER (WHERE o.kind = 'error' AND (m.ls IS NULL OR o.timestamp > m.ls)) AS last_error,
    m.last_error_at,
    CAST(count(*) FILTER (WHERE o.kind = 'error' AND (m.ls IS NULL OR o.timestamp > m.ls)) AS INTEGER) AS consecutive_errors
  FROM c_outcomes o JOIN c_marks m USING (host)
  GROUP BY o.host, m.ls, m.ln, m.last_error_at
),
c_usage_daily AS (
  SELECT date_trunc('day', m.timestamp) AS day, m.host, s.project_path, m.model,
    CAST(count(*) AS BIGINT) AS message_count,
    CAST(coalesce(sum(m.input_tokens), 0) AS BIGINT) AS input_tokens,
    CAST(coalesce(sum(m.output_tokens), 0) AS BIGINT) AS output_tokens,
    CAST(coalesce(sum(m.cache_creation_tokens), 0) AS BIGINT) AS cache_creation,
    CAST(coalesce(sum(m.cache_read_tokens), 0) AS BIGINT) AS cache_read
  FROM c_messages m JOIN c_sessions s USING (session_id)
  WHERE m.role = 'assistant'
  GROUP BY 1, 2, 3, 4
)"""


def with_base(body: str) -> str:
    """A full statement: the canonical CTEs, then ``body`` (which may add CTEs after a comma
    when it starts with ``,``) and a final SELECT."""
    body = body.strip()
    if body.startswith(","):
        return "WITH " + BASE + body
    return "WITH " + BASE + "\n" + body

"""Registered queries: name -> (Spark callable, DuckDB oracle SQL).

Every query reads the driver tables of ``sf_dir`` through the binding, over whole
tables; windows and host lists are the queries' own parameters (fixed here so the
Spark result and the SQL twin are comparable).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dates import resolve_window
from ..oracle import with_base
from . import cost
from .catalog import Catalog

NOW = dt.datetime(2024, 2, 1)
WINDOW = resolve_window("2024-01-11..2024-01-25", NOW)
PRIOR = WINDOW.prior()
TODAY = dt.datetime(2024, 1, 20)
HOSTS = ["h1", "h2"]


def T(d: dt.datetime) -> str:
    return f"TIMESTAMP '{d.strftime('%Y-%m-%d %H:%M:%S.%f')}'"


def D(d: dt.date) -> str:
    return f"DATE '{d.isoformat()}'"


def between(col: str, w) -> str:
    return f"{col} BETWEEN {T(w.start)} AND {T(w.end)}"


def day_between(col: str, w) -> str:
    return f"CAST({col} AS DATE) BETWEEN {D(w.start_day)} AND {D(w.end_day)}"


def hosts_sql(col: str, hosts) -> str:
    if not hosts:
        return "TRUE"
    return f"{col} IN (" + ", ".join(f"'{h}'" for h in hosts) + ")"


_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        _Q[name] = fn
        if sql is not None:
            _SQL[name] = with_base(sql)
        return fn

    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import registry_more  # noqa: F401  (registers the remaining groups)

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def cat(spark: SparkSession, sf_dir: str) -> Catalog:
    """The driver's tables bound on the fly, or the stored canonical tables if ``sf_dir``
    is a ``StoredTables`` folder."""
    from .materialize import StoredTables, from_root

    if isinstance(sf_dir, StoredTables):
        return from_root(spark, sf_dir)
    return Catalog.from_driver(spark, sf_dir)


W, P = WINDOW, PRIOR

# ---------------------------------------------------------------- Q1 token totals
register("q01_token_totals", f"""
SELECT CAST(coalesce(sum(total_input_tokens), 0) AS BIGINT) AS input,
       CAST(coalesce(sum(total_output_tokens), 0) AS BIGINT) AS output,
       CAST(coalesce(sum(total_cache_creation), 0) AS BIGINT) AS cache_creation,
       CAST(coalesce(sum(total_cache_read), 0) AS BIGINT) AS cache_read,
       CAST(coalesce(sum(total_input_tokens), 0) + coalesce(sum(total_output_tokens), 0)
          + coalesce(sum(total_cache_creation), 0) + coalesce(sum(total_cache_read), 0) AS BIGINT) AS total
FROM c_sessions WHERE {between('started_at', W)}
""")(lambda spark, sf: cost.token_totals(cat(spark, sf), W))

register("q01_token_totals_hosts", f"""
SELECT CAST(coalesce(sum(total_input_tokens), 0) AS BIGINT) AS input,
       CAST(coalesce(sum(total_output_tokens), 0) AS BIGINT) AS output,
       CAST(coalesce(sum(total_cache_creation), 0) AS BIGINT) AS cache_creation,
       CAST(coalesce(sum(total_cache_read), 0) AS BIGINT) AS cache_read,
       CAST(coalesce(sum(total_input_tokens), 0) + coalesce(sum(total_output_tokens), 0)
          + coalesce(sum(total_cache_creation), 0) + coalesce(sum(total_cache_read), 0) AS BIGINT) AS total
FROM c_sessions WHERE {between('started_at', W)} AND {hosts_sql('host', HOSTS)}
""")(lambda spark, sf: cost.token_totals(cat(spark, sf), W, HOSTS))

# ---------------------------------------------------------------- Q2 + Q6 cost KPIs
register("q02_cost_kpis", f"""
, k AS (
  SELECT CAST(coalesce(sum(cost_e4) FILTER (WHERE started_at >= {T(TODAY)}), 0) AS DOUBLE) / 10000.0 AS today_cost,
         CAST(coalesce(sum(cost_e4) FILTER (WHERE {between('started_at', W)}), 0) AS DOUBLE) / 10000.0 AS window_cost,
         CAST(coalesce(sum(cost_e4) FILTER (WHERE {between('started_at', P)}), 0) AS DOUBLE) / 10000.0 AS window_cost_prior
  FROM c_sessions)
SELECT *, round(CASE WHEN window_cost_prior <> 0 THEN (window_cost - window_cost_prior) / window_cost_prior END, 6) AS cost_delta_pct
FROM k
""")(lambda spark, sf: cost.cost_kpis(cat(spark, sf), W, TODAY))

# ---------------------------------------------------------------- Q3 + Q6 cache KPIs
register("q03_cache_kpis", f"""
, k AS (
  SELECT CAST(coalesce(sum(input_tokens) FILTER (WHERE {day_between('day', W)}), 0) AS BIGINT) AS in_tok,
         CAST(coalesce(sum(cache_read) FILTER (WHERE {day_between('day', W)}), 0) AS BIGINT) AS cache,
         CAST(coalesce(sum(input_tokens) FILTER (WHERE {day_between('day', P)}), 0) AS BIGINT) AS in_tok_prior,
         CAST(coalesce(sum(cache_read) FILTER (WHERE {day_between('day', P)}), 0) AS BIGINT) AS cache_prior
  FROM c_usage_daily),
h AS (
  SELECT *, CASE WHEN in_tok + cache > 0 THEN cache / (in_tok + cache) ELSE 0.0 END AS hit,
            CASE WHEN in_tok_prior + cache_prior > 0 THEN cache_prior / (in_tok_prior + cache_prior) ELSE 0.0 END AS hitp
  FROM k)
SELECT in_tok, cache, in_tok_prior, cache_prior, round(hit, 6) AS cache_hit_pct, round(hitp, 6) AS cache_hit_pct_prior,
       CAST(floor((hit - hitp) * 100 + 0.5) AS BIGINT) AS cache_delta_pp
FROM h
""")(lambda spark, sf: cost.cache_kpis(cat(spark, sf), W))

# ---------------------------------------------------------------- Q4 + Q6 top model share
register("q04_top_model_share", f"""
, per AS (
  SELECT model,
    coalesce(sum(units) FILTER (WHERE {between('timestamp', W)}), 0) AS u_cur,
    coalesce(sum(units) FILTER (WHERE {between('timestamp', P)}), 0) AS u_prior,
    count(*) FILTER (WHERE {between('timestamp', W)}) AS n_cur
  FROM c_ej WHERE role = 'assistant' AND ({between('timestamp', W)} OR {between('timestamp', P)})
  GROUP BY model),
rk AS (SELECT *, row_number() OVER (ORDER BY u_cur DESC, model ASC NULLS LAST) AS rk FROM per WHERE n_cur > 0),
tot AS (SELECT (SELECT sum(u_cur) FROM rk WHERE rk <= 5) AS top5, (SELECT sum(u_prior) FROM per) AS prior_total),
x AS (
  SELECT rk.model, rk.u_cur, rk.u_prior,
    CASE WHEN tot.top5 > 0 THEN rk.u_cur / tot.top5 ELSE 0.0 END AS pct,
    CASE WHEN tot.prior_total > 0 THEN rk.u_prior / tot.prior_total ELSE 0.0 END AS pctp
  FROM rk, tot WHERE rk.rk = 1 AND rk.model IS NOT NULL)
SELECT model AS top_model, CAST(u_cur AS DOUBLE) / 100000000.0 AS top_model_cost,
       round(pct, 6) AS pct_of_cost, round(pctp, 6) AS pct_prior,
       CAST(floor((pct - pctp) * 100 + 0.5) AS BIGINT) AS share_delta_pp
FROM x
""")(lambda spark, sf: cost.top_model_share(cat(spark, sf), W))

# ---------------------------------------------------------------- Q7 spend per day and model
_Q7 = f"""
, j AS (
  SELECT u.day, u.model,
    coalesce(sum(u.input_tokens * p.input_c + u.output_tokens * p.output_c
               + u.cache_creation * p.cache_write_5m_c + u.cache_read * p.cache_read_c), 0) AS units
  FROM c_usage_daily u LEFT JOIN c_pricing p ON p.model = u.model
  WHERE {day_between('u.day', W)}
  GROUP BY u.day, u.model)
"""
register("q07_spend_by_model", _Q7 + """
SELECT strftime(day, '%Y-%m-%d') AS day, model, CAST(units AS DOUBLE) / 100000000.0 AS cost FROM j
""")(lambda spark, sf: cost.spend_by_model(cat(spark, sf), W))

# ---------------------------------------------------------------- Q8 top cost sessions
_Q8 = f"""
SELECT session_id, project_path, started_at, duration_sec, message_count,
       array_to_string(models_used, ',') AS models_used, cost_e4 / 10000.0 AS cost
FROM c_sessions
WHERE {between('started_at', W)} AND cost_e4 IS NOT NULL
ORDER BY cost_e4 DESC NULLS LAST, session_id
LIMIT 5
"""
register("q08_top_cost_sessions", _Q8)(lambda spark, sf: cost.top_cost_sessions(cat(spark, sf), W, 5))

# ---------------------------------------------------------------- Q9 cost distribution
register("q09_cost_distribution", f"""
SELECT round(quantile_cont(cost_e4 / 10000.0, 0.5), 6) AS p50,
       round(quantile_cont(cost_e4 / 10000.0, 0.95), 6) AS p95,
       round(quantile_cont(cost_e4 / 10000.0, 0.99), 6) AS p99,
       max(cost_e4 / 10000.0) AS max, count(*) AS n
FROM c_sessions WHERE {between('started_at', W)} AND cost_e4 IS NOT NULL
""")(lambda spark, sf: cost.cost_distribution(cat(spark, sf), W))

# ---------------------------------------------------------------- Q10 cache-hit trend
register("q10_cache_hit_trend", f"""
SELECT strftime(day, '%Y-%m-%d') AS day,
       round(CASE WHEN sum(input_tokens + cache_read) > 0
                  THEN CAST(sum(cache_read) AS DOUBLE) / CAST(sum(input_tokens + cache_read) AS DOUBLE)
                  ELSE 0.0 END, 6) AS hit_pct
FROM c_usage_daily WHERE {day_between('day', W)}
GROUP BY day
""")(lambda spark, sf: cost.cache_hit_trend(cat(spark, sf), W))

# ---------------------------------------------------------------- Q11 heatmap
_HM_START = min(W.start, NOW - dt.timedelta(days=30))
register("q11_active_hours_heatmap", f"""
, loc AS (SELECT timezone('America/New_York', timezone('UTC', started_at)) AS t FROM c_sessions
          WHERE started_at BETWEEN {T(_HM_START)} AND {T(W.end)}),
cnt AS (SELECT CAST(dayofweek(t) AS INTEGER) AS dow, CAST(hour(t) AS INTEGER) AS hour, count(*) AS n FROM loc GROUP BY 1, 2),
grid AS (SELECT CAST(i // 24 AS INTEGER) AS dow, CAST(i % 24 AS INTEGER) AS hour FROM range(168) r(i))
SELECT g.dow, g.hour, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM grid g LEFT JOIN cnt c USING (dow, hour)
""")(lambda spark, sf: cost.active_hours_heatmap(cat(spark, sf), W, NOW))

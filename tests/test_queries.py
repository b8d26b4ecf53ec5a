"""Query plans on hand-made canonical tables, and the registered queries against DuckDB."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tracelens.functions.dates import TimeWindow
from tracelens.plans import behavior, cli, cost, hosts, search, sessions
from tracelens.plans.catalog import Catalog
from tracelens.sources.pricing import model_pricing

D = dt.datetime
W = TimeWindow(D(2099, 1, 1), D(2099, 1, 31, 23, 59, 59))

SESSION_COLS = ("session_id string, project_path string, started_at timestamp, ended_at timestamp, duration_sec int, "
                "message_count int, tool_call_count int, subagent_count int, models_used array<string>, "
                "total_input_tokens long, total_output_tokens long, total_cache_creation long, total_cache_read long, "
                "cost_e4 long, first_user_prompt string, status string, host string")


def _sessions(spark):
    rows = [
        ("s1", "/p/a", D(2099, 1, 5, 10), D(2099, 1, 5, 11), 3600, 4, 2, 0, ["m1", "m2"], 2000, 800, 300, 400, 30000, "hi", "ended", "A"),
        ("s2", "/p/b", D(2099, 1, 6, 10), D(2099, 1, 6, 10, 30), 1800, 2, 1, 3, ["m1"], 1000, 400, 100, 200, 17500, "yo", "active", "A"),
        ("s3", "/p/a", D(2099, 1, 7, 10), D(2099, 1, 7, 10, 1), 60, 2, 3, 8, ["m3"], 500, 250, 50, 75, 9000, "x", "ended", "B"),
        ("s4", "/p/old", D(2098, 1, 7, 10), D(2098, 1, 7, 10, 1), 60, 2, 0, 0, [], 9, 9, 9, 9, 1, "old", "ended", "A"),
    ]
    return spark.createDataFrame(rows, SESSION_COLS)


@pytest.fixture(scope="module")
def cat(spark):
    sync = spark.createDataFrame(
        [("B", D(2099, 1, 7), D(2099, 1, 6), 3, 0, "boom", D(2099, 1, 8), 3),
         ("A", D(2099, 1, 7), D(2099, 1, 7), 3, 0, None, None, 0)],
        "host string, last_pulled_at timestamp, last_had_data_at timestamp, current_interval_hours int, "
        "consecutive_empty_pulls int, last_error string, last_error_at timestamp, consecutive_errors int")
    return Catalog.from_tables(spark, sessions=_sessions(spark), host_sync_state=sync, pricing=model_pricing(spark))


def test_token_totals(cat):
    r = cost.token_totals(cat, W).first()
    assert (r.input, r.output, r.cache_creation, r.cache_read) == (3500, 1450, 450, 675)
    assert r.total == 3500 + 1450 + 450 + 675
    a = cost.token_totals(cat, W, ["A"]).first()
    assert (a.input, a.output, a.cache_creation, a.cache_read) == (3000, 1200, 400, 600)
    b = cost.token_totals(cat, W, ["B"]).first()
    assert (b.input, b.output, b.cache_creation, b.cache_read) == (500, 250, 50, 75)
    assert cost.token_totals(cat, W, []).first().input == 3500  # empty list = no filter


def test_host_stats(cat):
    got = {r.host: r for r in hosts.host_stats(cat, W).collect()}
    assert got["A"].session_count == 2 and got["A"].cost == pytest.approx(4.75)
    assert got["A"].top_model == "m1" and got["A"].top_model_cost == pytest.approx(4.75)
    assert got["B"].cost == pytest.approx(0.9) and got["B"].consecutive_errors == 3 and got["B"].last_error == "boom"


def test_failing_hosts(spark):
    sync = spark.createDataFrame(
        [(f"h{n}", n, D(2099, 1, n + 1)) for n in (0, 2, 3, 5)],
        "host string, consecutive_errors int, last_error_at timestamp").withColumn("last_error", F.lit("e"))
    c = Catalog.from_tables(spark, host_sync_state=sync)
    assert sorted(r.host for r in hosts.failing_hosts(c).collect()) == ["h3", "h5"]


def test_active_and_listing(cat):
    a = cost.active_sessions(cat).collect()
    assert [r.session_id for r in a] == ["s2"] and a[0].active_count == 1
    page = sessions.list_sessions(cat, sort="cost", limit=2).collect()
    assert [r.session_id for r in page] == ["s1", "s2"]
    assert sessions.count_sessions(cat, project="/p/a").first().n == 2
    assert sessions.count_sessions(cat, models=["m3", "zz"]).first().n == 1


def test_histogram_and_distribution(cat):
    h = {r.bucket: r.n for r in behavior.subagent_histogram(cat, W).collect()}
    assert h == {0: 1, 1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 1}
    d = cost.cost_distribution(cat, W).first()
    assert d.n == 3 and d.max == pytest.approx(3.0) and d.p50 == pytest.approx(1.75)


def test_search_hosts_and_filters(spark):
    msgs = spark.createDataFrame(
        [("u1", "s1", "user", D(2099, 1, 1), None, "deploy the keyword service", 0, 0, 0, 0, False, "A"),
         ("u2", "s2", "assistant", D(2099, 1, 2), "m1", "keyword found twice keyword", 0, 0, 0, 0, False, "A"),
         ("u3", "s3", "user", D(2099, 1, 3), None, "the Keyword on host B", 0, 0, 0, 0, False, "B"),
         ("u4", "s3", "user", D(2099, 1, 3), None, "nothing here", 0, 0, 0, 0, False, "B")],
        "uuid string, session_id string, role string, timestamp timestamp, model string, text_content string, "
        "input_tokens int, output_tokens int, cache_creation_tokens int, cache_read_tokens int, is_sidechain boolean, host string")
    c = Catalog.from_tables(spark, messages=msgs, sessions=_sessions(spark))
    assert search.count_results(c, "keyword").first().n == 3
    assert search.count_results(c, "keyword", hosts=["A"]).first().n == 2
    assert search.count_results(c, "keyword", hosts=["B"]).first().n == 1
    top = search.search(c, "keyword").collect()
    assert top[0].uuid == "u2" and "<b>keyword</b>" in top[0].snippet  # tf 2 ranks first
    assert search.count_results(c, "keyword service").first().n == 1  # all terms required


def test_cli_reports(cat):
    p = cli.top_projects(cat, D(2099, 1, 1)).collect()
    assert p[0].project_path == "/p/a" and p[0].sessions == 2 and p[0].cost == pytest.approx(3.9)


# -------------------------------------------------------------- registered queries vs DuckDB
FAST = ["q01_token_totals", "q04_top_model_share", "q08_top_cost_sessions", "q13_latency_percentiles",
        "q22_session_top_tools", "q30_host_stats", "d4_transcript_tool_calls", "q25_search_output_error"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", FAST)
def test_registered_query_matches_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as E

    con = duckdb.connect()
    for t in ("events", "conversations", "documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    idx = [dcols.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    assert sorted(dcols) == cols
    assert got == want


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() >= 0 and "cost" in df.columns


def test_session_rollup_deals_out_its_rows(spark, tmp_path):
    """the rollup sorts a task's lines, so a task's rows are bounded whatever the size of a file's parts."""
    from tracelens.plans import sessions
    from tracelens.plans.registry import cat as driver_cat

    spark.sql("""select id as event_id, timestamp_seconds(1704067200 + id) as ts, id % 300 as user_id, 'view' as event_type,
        cast(id as double) as value, '{"k": 1}' as props from range(60000)""").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.sql("select id as conv_id, 0L as turn, 'user' as role, 'text' as text from range(5)").coalesce(1).write.parquet(
        str(tmp_path / "conversations.parquet"))
    key, old = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set(key, "200k")
        rows = sessions.session_meta(driver_cat(spark, str(tmp_path)))
        got = rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, old)
    assert sum(r.message_count for r in got) == 2 * 60000 + 5
    assert "REBALANCE_PARTITIONS_BY_NONE" in plan.split("== Initial Plan ==")[0]

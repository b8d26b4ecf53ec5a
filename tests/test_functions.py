"""Pure column functions and driver-side helpers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tracelens.functions import dates, formatting, paths, text
from tracelens.functions.cost import token_cost


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_token_cost_input_output(spark):
    c = token_cost(*[F.lit(x) for x in (1_000_000, 500_000, 0, 0, 0, 3.0, 15.0, 3.75, 6.0, 0.3)])
    assert one(spark, c) == pytest.approx(10.5)


def test_token_cost_cache_tiers(spark):
    c = token_cost(*[F.lit(x) for x in (0, 0, 1_000_000, 500_000, 2_000_000, 3.0, 15.0, 3.75, 6.0, 0.3)])
    assert one(spark, c) == pytest.approx(7.35)


@pytest.mark.parametrize("flat,real", [
    ("-home-dev-app", "/home/dev/app"),
    ("-home-dev--work-app", "/home/dev_work/app"),
    ("-tmp", "/tmp"),
    ("home-x", "/home/x"),
    ("-a-b-c", "/a/b/c"),
])
def test_flat_to_real(spark, flat, real):
    assert one(spark, paths.flat_to_real_path(F.lit(flat))) == real


def test_flat_path_lossy_dash(spark):
    # a '-' inside a directory name cannot be told apart from '/'
    assert one(spark, paths.flat_to_real_path(paths.real_to_flat_path(F.lit("/home/my-app")))) == "/home/my/app"


def test_real_to_flat(spark):
    assert one(spark, paths.real_to_flat_path(F.lit("/home/dev/_work"))) == "-home-dev---work"


def test_project_path_from_file(spark):
    f = F.lit("/home/dev/.claude/projects/-home-dev-app/s1.jsonl")
    assert one(spark, paths.project_path_from_file(f)) == "/home/dev/app"
    assert one(spark, paths.project_path_from_file(F.lit("/tmp/x.jsonl"))) is None


def test_sidechain_path(spark):
    f = F.lit("/p/s1/subagents/agent-x7.jsonl")
    assert one(spark, paths.is_sidechain_path(f)) is True
    assert one(spark, paths.agent_id_from_path(f)) == "x7"
    assert one(spark, paths.agent_id_from_path(F.lit("/p/s1.jsonl"))) is None


@pytest.mark.parametrize("src,expected", [
    ("key sk-ant-" + "a" * 24 + " end", "key [REDACTED:anthropic] end"),
    ("id AKIA" + "ABCDEFGHIJKLMNOP" + " ok", "id [REDACTED:aws] ok"),
    ("tok ghp_" + "x" * 36, "tok [REDACTED:github]"),
    ("Authorization: Bearer " + "z" * 30, "Authorization: [REDACTED:bearer]"),
    ("Authorization: Bearer eyJabc.eyJdef.ghi", "Authorization: Bearer [REDACTED:jwt]"),
    ("nothing secret here", "nothing secret here"),
])
def test_redact(spark, src, expected):
    assert one(spark, text.redact(F.lit(src))) == expected
    assert text.redact_py(src) == expected


def test_redact_ascii_word_boundary(spark):
    # JavaScript/RE2 \b: an accented letter is not a word character
    s = "é" + "sk-" + "A" * 40
    assert one(spark, text.redact(F.lit(s))) == "é[REDACTED:openai]"


def test_redact_json_leaves(spark):
    doc = '{"cmd": "curl -H \\"Authorization: Bearer ' + "q" * 25 + '\\"", "n": 1, "list": ["a\\nsk-ant-' + "b" * 22 + '"]}'
    df = spark.createDataFrame([(doc,)], ["j"]).select(text.redact_json("j").alias("r"))
    out = df.first().r
    assert "[REDACTED:bearer]" in out and "[REDACTED:anthropic]" in out and '"n":1' in out


NOW = dt.datetime(2026, 4, 26, 15, 30)


def test_windows():
    w = dates.resolve_window("7d", NOW)
    assert w.start == NOW - dt.timedelta(days=7) and w.end == NOW and w.label == "Last 7d"
    w = dates.resolve_window("2026-04-01..2026-04-03", NOW)
    assert w.start == dt.datetime(2026, 4, 1) and w.end == dt.datetime(2026, 4, 3, 23, 59, 59, 999000)
    assert dates.resolve_window("all", NOW).start == dt.datetime(1970, 1, 1)
    assert dates.resolve_window(None, NOW).label == "Last 7d"
    assert dates.resolve_window("garbage!", NOW).label == "Last 7d"
    assert dates.resolve_window("14d", NOW).label == "Last 14d"
    assert dates.resolve_window("today", NOW).start == dt.datetime(2026, 4, 26)
    p = dates.resolve_window("2026-04-10..2026-04-10", NOW).prior()
    assert p.end == dt.datetime(2026, 4, 10)


def test_strict_since():
    assert dates.parse_since_strict("2h", NOW) == NOW - dt.timedelta(hours=2)
    with pytest.raises(ValueError):
        dates.parse_since_strict("soon", NOW)


def test_deltas(spark):
    assert one(spark, formatting.delta_pct(F.lit(15.0), F.lit(10.0))) == pytest.approx(0.5)
    assert one(spark, formatting.delta_pct(F.lit(15.0), F.lit(0.0))) is None
    assert one(spark, formatting.delta_pp(F.lit(0.505), F.lit(0.5))) == 1  # half up
    assert one(spark, formatting.delta_pp(F.lit(0.25), F.lit(0.28125))) == -3
    assert one(spark, formatting.model_family(F.lit("claude-opus-4-6"))) == "Opus"
    assert one(spark, formatting.humanize_tokens(F.lit(1_234_567))) == "1.2M"


def _fold(outcomes):
    """Reference-style sequential fold of pull outcomes (for comparison only)."""
    st = dict(empties=0, interval=3, errors=0, pulled=None, data=None, err=None, err_at=None)
    for ts, kind, msg in outcomes:
        if kind == "error":
            st.update(errors=st["errors"] + 1, err=msg, err_at=ts)
        elif kind == "empty":
            e = st["empties"] + 1
            st.update(pulled=ts, err=None, errors=0, empties=e, interval={0: 3, 1: 6}.get(e, 12))
        else:
            st.update(pulled=ts, data=ts, err=None, errors=0, empties=0, interval=3)
    return st


def test_host_health_matches_fold(spark):
    from tracelens.operators.hosts import host_sync_health

    rng = random.Random(7)
    rows, expected = [], {}
    for h in range(40):
        t0 = dt.datetime(2026, 1, 1)
        hist = []
        for i in range(rng.randint(1, 12)):
            kind = rng.choice(["error", "empty", "non-empty"])
            hist.append((t0 + dt.timedelta(hours=i), kind, f"m{h}-{i}" if kind == "error" else None))
        expected[f"h{h}"] = _fold(hist)
        rows += [(f"h{h}", ts, k, m) for ts, k, m in hist]
    df = spark.createDataFrame(rows, "host string, timestamp timestamp, kind string, message string")
    got = {r.host: r for r in host_sync_health(df).collect()}
    for h, st in expected.items():
        r = got[h]
        assert (r.consecutive_errors, r.consecutive_empty_pulls, r.current_interval_hours) == (st["errors"], st["empties"], st["interval"]), h
        assert r.last_pulled_at == st["pulled"] and r.last_had_data_at == st["data"]
        assert r.last_error == st["err"] and r.last_error_at == st["err_at"]


def test_due_hosts(spark):
    from tracelens.operators.hosts import due_hosts

    df = spark.createDataFrame(
        [("a", None, 3), ("b", dt.datetime(2026, 1, 1, 0), 3), ("c", dt.datetime(2026, 1, 1, 2), 3)],
        "host string, last_pulled_at timestamp, current_interval_hours int")
    due = {r.host for r in due_hosts(df, dt.datetime(2026, 1, 1, 3)).collect()}
    assert due == {"a", "b"}


def test_redact_df_equals_column_form(spark):
    rows = [(1, "a Bearer eyJa.eyJb.c and sk-ant-" + "q" * 25), (2, "plain"), (3, "AKIA" + "Z" * 16 + " ghp_" + "k" * 31)]
    df = spark.createDataFrame(rows, "id int, t string")
    a = {r.id: r.t for r in text.redact_df(df, "t").collect()}
    b = {r.id: r.x for r in df.select("id", text.redact(F.col("t")).alias("x")).collect()}
    assert a == b and a[1] == "a Bearer [REDACTED:jwt] and [REDACTED:anthropic]"


def test_java_forms_match_ascii_word_boundaries(spark):
    """The Java forms of the rules agree with the original patterns under ASCII \\b."""
    import re

    rng = random.Random(5)
    pieces = ["sk-", "sk-ant-", "AKIA", "ghp_", "gho_", "github_pat_", "Bearer ", "eyJ", ".eyJ", "é", "_", "-",
              " ", "x", "Z", "9", 'token = "', '"', "abc", "ABCDEFGHIJKLMNOP"]
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    texts = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts.append(rng.choice(pieces))
            parts.append("".join(rng.choice(alnum) for _ in range(rng.choice([0, 5, 16, 20, 31, 32, 40]))))
        texts.append("".join(parts))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rules = text.REDACTION_RULES + [text.ASSIGNMENT_RULE]
    for kind, pat in rules:
        got = {r.i: r.x for r in df.select("i", F.regexp_replace("t", text.java_pattern(pat), "#").alias("x")).collect()}
        rx = re.compile(pat, re.ASCII)
        for i, t in enumerate(texts):
            assert got[i] == rx.sub("#", t), (kind, t)


def test_labels_and_paths_of_the_pages(spark):
    assert one(spark, formatting.short_model(F.lit("claude-opus-4-6"))) == "opus-4"
    assert one(spark, formatting.short_model(F.lit("claude-sonnet-4-5-20250929"))) == "sonnet-4-5"
    assert one(spark, formatting.shorten_home(F.lit("/Users/any/x/y"))) == "~/x/y"
    assert one(spark, formatting.shorten_home(F.lit("/home/dev/x"))) == "/home/dev/x"
    assert one(spark, formatting.shorten_home(F.lit(None).cast("string"))) == "(none)"
    assert one(spark, formatting.humanize_tokens(F.lit(-5))) == "0"


def test_tokens_of_any_script(spark):
    from tracelens.functions import text

    assert one(spark, F.array_join(text.simple_terms(F.lit("Größe für_Über, x9")), " ")) == "größe für über x9"
    assert text.query_terms("Größe für_Über") == ["größe", "für", "über"]

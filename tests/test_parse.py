"""Transcript parsing and derivations on a hand-written home directory."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import FIXTURES
from tracelens.operators import derive
from tracelens.sources import transcripts as tr
from tracelens.sources.pricing import model_pricing

HOME = os.path.join(FIXTURES, "home", ".claude", "projects")


@pytest.fixture(scope="module")
def events(spark):
    lines = tr.read_jsonl(spark, HOME)
    return tr.to_events(tr.parse_lines(lines), host="local").cache()


def test_scan_and_quarantine(spark):
    parsed = tr.parse_lines(tr.read_jsonl(spark, HOME))
    bad = tr.quarantine(parsed).collect()
    assert [r.raw for r in bad] == ['{"uuid": "broken", "timestamp": ']
    # blank line skipped; 7 non-empty lines in the main file + 1 in the sub-agent file
    assert parsed.count() == 8


def test_quarantine_report_numbers_lines_like_the_file(spark, tmp_path):
    rows = ['{"a":1}', "", '{"b": ', "\t", '{"c":2} x', "[1,", "nul\x00l", '{"ok":true}', "NaN"]
    for name, n in (("a.jsonl", 1), ("b.jsonl", 400)):
        (tmp_path / name).write_text("\n".join(rows * n) + "\n")
    bad = {2, 3, 4, 5, 8}
    want = sorted((f, r * len(rows) + i + 1, rows[i]) for f, n in (("a.jsonl", 1), ("b.jsonl", 400)) for r in range(n) for i in bad)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")  # several splits a file
        lines = tr.read_jsonl(spark, str(tmp_path))
        assert lines.select("line_key.block").distinct().count() > 2
        got = tr.quarantine_report(lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.source_file.rsplit("/", 1)[1], r.line_no, r.raw) for r in got) == want
    message = {r.raw: r.error for r in got}
    assert message['{"b": '] == "Expecting value: line 1 column 7 (char 6)" and message['{"c":2} x'].startswith("Extra data")
    assert message["NaN"] == "not a JSON value"  # other parsers' extension


def test_events_and_subtypes(events):
    got = {r.uuid: r for r in events.collect()}
    assert set(got) == {"p1", "u1", "a1", "u2", "n1", "sa1"}  # line without uuid dropped
    assert got["p1"].subtype == "hook_progress"
    assert got["u1"].subtype == "user_message"
    assert got["a1"].subtype == "assistant_message"
    assert got["u2"].subtype == "tool_result"
    assert got["a1"].project_path == "/home/dev/app"
    assert got["sa1"].is_sidechain and got["sa1"].agent_id == "x7"
    assert not got["u1"].is_sidechain and got["u1"].agent_id is None


def test_nul_stripping(events, spark):
    m = {r.uuid: r for r in tr.derive_messages(events).collect()}
    assert m["n1"].text_content == "beforeafter"


def test_messages(events):
    m = {r.uuid: r for r in tr.derive_messages(events).collect()}
    assert "p1" not in m
    assert m["a1"].text_content == "Reading the file."  # tool_use block ignored
    assert (m["a1"].input_tokens, m["a1"].output_tokens) == (1_000_000, 500_000)
    assert m["u2"].text_content == "print(1)"  # inner text of an array tool_result
    assert m["u1"].input_tokens is None and m["u1"].role == "user"


def test_tool_pairing(events):
    tc = derive.pair_tool_calls(tr.extract_tool_uses(events), tr.extract_tool_results(events)).collect()
    assert len(tc) == 1
    r = tc[0]
    assert (r.uuid, r.tool_name, r.duration_ms, r.is_error, r.result_uuid) == ("a1", "Read", 500, False, "u2")
    assert '"file_path":"/home/dev/app/main.py"' in r.input


def test_last_result_wins_and_unpaired(spark):
    uses = spark.createDataFrame(
        [("a1", "s", dt.datetime(2026, 1, 1, 0, 0, 0), "t1", "Bash", "{}", "f", "local"),
         ("a2", "s", dt.datetime(2026, 1, 1, 0, 0, 5), "t2", "Read", "{}", "f", "local")],
        "uuid string, session_id string, timestamp timestamp, tool_use_id string, tool_name string, input string, source_file string, host string")
    res = spark.createDataFrame(
        [("r1", dt.datetime(2026, 1, 1, 0, 0, 1), "t1", "first", False, "f"),
         ("r2", dt.datetime(2026, 1, 1, 0, 0, 2), "t1", "second", True, "f")],
        "uuid string, timestamp timestamp, tool_use_id string, content string, is_error boolean, source_file string")
    got = {r.uuid: r for r in derive.pair_tool_calls(uses, res).collect()}
    assert (got["a1"].result, got["a1"].is_error, got["a1"].duration_ms) == ("second", True, 2000)
    assert (got["a2"].result, got["a2"].is_error, got["a2"].duration_ms) == (None, None, None)


def test_session_rollup(events, spark):
    msgs = tr.derive_messages(events)
    tc = derive.pair_tool_calls(tr.extract_tool_uses(events), tr.extract_tool_results(events))
    s = derive.rollup_sessions(events, msgs, tc, model_pricing(spark)).collect()
    assert len(s) == 1
    r = s[0]
    assert r.message_count == 5 and r.tool_call_count == 1 and r.subagent_count == 1
    assert float(r.estimated_cost_usd) == pytest.approx(10.5 + (10 * 1 + 5 * 5) / 1e6, abs=1e-4)
    assert r.first_user_prompt == "fix the build"
    assert r.models_used == ["claude-haiku-4-5", "claude-sonnet-4-5"]
    assert r.project_path == "/home/dev/app" and r.git_branch == "main" and r.duration_sec == 4


def test_a_line_is_cleaned_once(spark):
    """a generator computes an expression wherever its row names it; the cleaned text is named three times."""
    lines = spark.createDataFrame([('{"a":1}', "f"), (' {"a":1}\t', "f"), ('{"a":1} x', "f"), ('{"a":"\\u0000b"}', "f"), ("   ", "f"), ("", "f"), (None, "f")],
                                  "value string, source_file string")
    parsed = tr.parse_lines(lines)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(replace(value") == 1 and plan.count("trim(") == 1
    got = parsed.select("value", F.to_json("v").alias("j")).collect()
    assert [(r.value, r.j) for r in got] == [
        ('{"a":1}', '{"a":1}'), (' {"a":1}\t', '{"a":1}'), ('{"a":1} x', None), ('{"a":"\\u0000b"}', '{"a":"b"}'), ("   ", None)]

"""Backfill idempotence, host stamping and the live (streaming) path."""

import os
import shutil
import tempfile

from conftest import FIXTURES
from tracelens.streaming import ingest

HOME = os.path.join(FIXTURES, "home", ".claude", "projects")


def test_backfill_idempotent(spark):
    root = tempfile.mkdtemp(prefix="tl-store-")
    n1 = ingest.backfill(spark, HOME, root, host="laptop")
    n2 = ingest.backfill(spark, HOME, root, host="laptop")
    assert (n1, n2) == (6, 0)
    ev = spark.read.parquet(f"{root}/events")
    assert ev.count() == 6 and {r.host for r in ev.select("host").distinct().collect()} == {"laptop"}
    s = ingest.open_store(spark, root)["sessions"].collect()
    assert len(s) == 1 and s[0].tool_call_count == 1
    assert ingest.read_usage_daily(spark, root).count() == 2  # two models, one day


def test_live_ingest_matches_batch(spark):
    land = tempfile.mkdtemp(prefix="tl-land-")
    root = tempfile.mkdtemp(prefix="tl-live-")
    ckpt = tempfile.mkdtemp(prefix="tl-ck-")
    shutil.copytree(HOME, os.path.join(land, "projects"))
    q = ingest.start_live_ingest(spark, land, root, ckpt, host="local", trigger={"availableNow": True})
    q.awaitTermination(300)
    assert spark.read.parquet(f"{root}/events").count() == 6
    # a replayed copy of the same file adds nothing (exactly-once by uuid)
    shutil.copy(os.path.join(land, "projects", "-home-dev-app", "s1.jsonl"),
                os.path.join(land, "projects", "-home-dev-app", "s1-copy.jsonl"))
    q = ingest.start_live_ingest(spark, land, root, ckpt, host="local", trigger={"availableNow": True})
    q.awaitTermination(300)
    assert spark.read.parquet(f"{root}/events").count() == 6
    assert spark.read.parquet(f"{root}/changes").count() == 6
    s = ingest.open_store(spark, root)["sessions"].first()
    assert s.message_count == 5


def test_backfill_home_side_files(spark):
    import hashlib

    from tracelens.plans.common import parse_hosts

    home = os.path.join(FIXTURES, "home", ".claude")
    root = tempfile.mkdtemp(prefix="tl-home-")
    first = ingest.backfill_home(spark, home, root, host="local")
    again = ingest.backfill_home(spark, home, root, host="local")
    assert first == {"events": 6, "prompts_history": 2, "todos": 1, "file_snapshots": 2, "shell_snapshots": 1}
    assert again["events"] == 0 and again["todos"] == 0 and again["file_snapshots"] == 0
    # a NULL project never conflicts: the prompt without project is inserted again
    assert again["prompts_history"] == 1
    fs = {r.version: r for r in spark.read.parquet(f"{root}/file_snapshots").collect()}
    assert fs[1].content == "print(1)\n" and fs[1].sha256 == hashlib.sha256(b"print(1)\n").hexdigest()
    assert fs[2].content is None  # NUL byte: binary
    sh = spark.read.parquet(f"{root}/shell_snapshots").first()
    assert sh.id == "snapshot-zsh-1776679200000-ab12" and sh.captured_at.year == 2026
    assert parse_hosts(None, " a, b ,") == ["a", "b"] and parse_hosts(["x,y", "z"]) == ["x", "y"]
    assert parse_hosts("  ", None) is None


def test_rebuild_sessions_matches_incremental(spark):
    root = tempfile.mkdtemp(prefix="tl-rebuild-")
    ingest.backfill(spark, HOME, root, host="local")
    cols = ["session_id", "message_count", "tool_call_count", "subagent_count", "estimated_cost_usd", "first_user_prompt"]
    before = sorted(map(tuple, ingest.open_store(spark, root)["sessions"].select(cols).collect()))
    ingest.rebuild_sessions(spark, root)
    after = sorted(map(tuple, ingest.open_store(spark, root)["sessions"].select(cols).collect()))
    assert before == after and len(after) == 1


COLUMNS = {
    "events": ["uuid", "session_id", "type", "timestamp", "source_file"], "messages": ["uuid", "session_id", "role", "text_content", "input_tokens"],
    "tool_calls": ["uuid", "session_id", "tool_name", "result", "is_error"],
    "sessions": ["session_id", "message_count", "tool_call_count", "total_input_tokens", "estimated_cost_usd", "first_user_prompt"],
    "usage_daily": ["day", "host", "project_path", "model", "message_count", "input_tokens"], "changes": ["uuid", "session_id", "type"],
}


def tables(spark, root):
    store = ingest.open_store(spark, root)
    return {n: sorted(map(repr, map(tuple, store[n].select(c).collect()))) for n, c in COLUMNS.items()}


def event(uuid, session, minute, text="hello", kind="user", tokens=None):
    import json

    message = {"role": kind, "content": text}
    if kind == "assistant":
        message |= {"model": "claude-sonnet-4-5", "usage": {"input_tokens": tokens or 5, "output_tokens": 2}}
    return json.dumps({"uuid": uuid, "sessionId": session, "type": kind, "timestamp": f"2026-04-20T10:{minute:02d}:00Z", "cwd": "/home/dev/app", "message": message})


def lines(spark, rows, file="/home/u/.claude/projects/-home-dev-app/x.jsonl"):
    rows = [(r, file, (0, i)) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "value string, source_file string, line_key struct<block:bigint,pos:bigint>")


def test_first_batch_of_plain_chat(spark):
    root = tempfile.mkdtemp(prefix="tl-chat-")
    assert ingest.ingest_lines(spark, lines(spark, [event("a", "s1", 1), event("b", "s1", 2, kind="assistant")]), root) == 2
    got = tables(spark, root)
    assert got["tool_calls"] == [] and len(got["sessions"]) == 1 and len(got["usage_daily"]) == 1


def test_a_uuid_is_stored_once_whatever_the_batching(spark):
    root = tempfile.mkdtemp(prefix="tl-uuid-")
    ingest.ingest_lines(spark, lines(spark, [event("a", "s1", 1, kind="assistant", tokens=7)]), root)
    # the same uuid under other sessions, in later batches
    for s in ("s2", "s3", "s4"):
        assert ingest.ingest_lines(spark, lines(spark, [event("a", s, 2, kind="assistant", tokens=9)]), root) == 0
    got = tables(spark, root)
    assert len(got["events"]) == len(got["messages"]) == 1 and "'s1'" in got["events"][0] and len(got["sessions"]) == 1


def test_a_failure_after_any_write_heals_on_retry(spark, monkeypatch):
    from tracelens.operators import sinks

    first = [event("a", "s1", 1), event("b", "s2", 2, kind="assistant")]
    second = [event("c", "s1", 3, kind="assistant", tokens=11), event("d", "s3", 4), event("a", "s1", 1)]
    whole = tempfile.mkdtemp(prefix="tl-whole-")
    for batch in (first, second):
        ingest.ingest_lines(spark, lines(spark, batch), whole)
    want = tables(spark, whole)
    writes = {"append": sinks.append, "overwrite_partitions": sinks.overwrite_partitions}
    for fail_after in (1, 2, 3, 4, 6):
        root = tempfile.mkdtemp(prefix="tl-fail-")
        ingest.ingest_lines(spark, lines(spark, first), root)
        done = []

        def failing(name):
            def write(*args, **kwargs):
                writes[name](*args, **kwargs)
                done.append(name)
                if len(done) >= fail_after:  # several tables are written at the same time
                    raise OSError("lost")
            return write

        for name in writes:
            monkeypatch.setattr(sinks, name, failing(name))
        try:
            ingest.ingest_lines(spark, lines(spark, second), root)
            raise AssertionError("the write should have failed")
        except OSError:
            pass
        for name, write in writes.items():
            monkeypatch.setattr(sinks, name, write)
        ingest.ingest_lines(spark, lines(spark, second), root)
        assert tables(spark, root) == want, fail_after


def test_hooks_show_in_the_stored_sessions(spark):
    import json

    from tracelens.__main__ import _catalog
    from tracelens.plans import cli

    root, src = tempfile.mkdtemp(prefix="tl-hook-"), tempfile.mkdtemp(prefix="tl-hooks-")
    ck = tempfile.mkdtemp(prefix="tl-ck-")
    ingest.ingest_lines(spark, lines(spark, [event("a", "s1", 1), event("b", "s2", 2)]), root)

    def hook(n, sid, name):
        with open(os.path.join(src, f"h{n}.json"), "w") as f:
            f.write(json.dumps({"session_id": sid, "hook": name, "timestamp": f"2026-04-20T1{n}:00:00Z"}) + "\n")
        ingest.start_liveness(spark, src, f"{root}/liveness", ck, trigger={"availableNow": True}).awaitTermination(300)
        return cli.store_status(_catalog(spark, root)).first().active_sessions

    assert hook(1, "s1", "SessionStart") == 1
    ingest.ingest_lines(spark, lines(spark, [event("c", "s1", 3)]), root)  # the rollup keeps it active
    assert cli.store_status(_catalog(spark, root)).first().active_sessions == 1
    assert hook(2, "s1", "SessionEnd") == 0


def test_an_unreadable_table_is_an_error(spark):
    import pytest
    from tracelens.operators import sinks

    root = tempfile.mkdtemp(prefix="tl-bad-")
    assert sinks.read_or_none(spark, f"{root}/missing") is None
    os.makedirs(f"{root}/sessions")
    with open(f"{root}/sessions/part-0.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        sinks.read_or_none(spark, f"{root}/sessions")


def test_cli_prints_every_row(spark, capsys):
    from tracelens.__main__ import main

    root = tempfile.mkdtemp(prefix="tl-rows-")
    rows = [event(f"e{i}", "big", i % 60, f"word{i} größe") for i in range(250)] + [event(f"s{i}", f"t{i:02d}", 1, "other") for i in range(34)]
    ingest.ingest_lines(spark, lines(spark, rows), root)
    assert main(["replay", "--root", root, "big"], spark=spark) == 0
    out = capsys.readouterr().out
    assert all(f"word{i} " in out for i in range(250))
    assert main(["replay", "--root", root, "big", "--raw"], spark=spark) == 0
    assert "word249" in capsys.readouterr().out
    assert main(["sessions", "--root", root, "--limit", "30"], spark=spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 31
    assert main(["sessions", "--root", root], spark=spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 26
    assert main(["sessions", "--root", root, "--since", "2026-05-01"], spark=spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 1
    assert main(["search", "--root", root, "größe", "--limit", "40", "--simple"], spark=spark) == 0
    out = capsys.readouterr().out
    assert len(out.splitlines()) == 41 and "<b>größe</b>" in out
    assert main(["search", "--root", root, "other", "--project", "nowhere", "--simple"], spark=spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 1
    assert main(["status", "--root", root], spark=spark) == 0
    assert "284" in capsys.readouterr().out


def test_cli_commands(spark, capsys):
    from tracelens.__main__ import main

    home = os.path.join(FIXTURES, "home", ".claude")
    root = tempfile.mkdtemp(prefix="tl-cli-")
    assert main(["backfill", "--home", home, "--root", root], spark=spark) == 0
    assert main(["stats", "--root", root, "--since", "2026-04-01"], spark=spark) == 0
    assert main(["sessions", "--root", root], spark=spark) == 0
    assert main(["search", "--root", root, "builds"], spark=spark) == 0  # english: stems match
    assert main(["replay", "--root", root, "s"], spark=spark) == 0
    assert main(["status", "--root", root], spark=spark) == 0
    out = capsys.readouterr().out
    assert "claude-sonnet-4-5" in out and "fix the build" in out and "Read" in out

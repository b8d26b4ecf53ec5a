"""Binding of the driver's Parquet tables to the canonical session-log tables.

The driver ships TPC-H-like tables plus ``events`` and ``conversations``. Both become
transcript lines (the event-sourced truth) by fixed, deterministic rules that a SQL
engine can repeat exactly (see ``tracelens.oracle``):

* every ``events`` row is one assistant turn that calls a tool (``e<id>a``), the user
  turn carrying its result (``e<id>r``, missing when k % 11 = 5, i.e. an unpaired call)
  and, when k % 13 = 4, a second result (``e<id>s``, the last one wins). Session =
  user and UTC day, host = user mod 4.
* every ``conversations`` row is one chat turn; ``system`` turns become sub-agent
  (sidechain) user turns. Session = conversation.

NULLs the reference must cope with are produced by modulo rules: missing cwd, branch,
cache-creation tokens, ``is_error``; one unpriced model per source.

Each driver table is scanned once; the 1-3 lines per row come from ``explode`` of a
small array, so the binding is a narrow, map-only stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import project_path_from_file
from ..session import use_utc

# Model names assigned by the binding (the last of each list has no price).
EVENT_MODELS = [
    "claude-opus-4-6",
    "claude-sonnet-4-5",
    "claude-haiku-4-5",
    "claude-sonnet-4-6",
    "local-llama-3",
]
CHAT_MODELS = [
    "claude-opus-4-7",
    "claude-sonnet-4-6",
    "claude-haiku-4-5-20251001",
    "experimental-model",
]
# Driver event type -> tool name.
TOOL_BY_EVENT = [
    ("view", "Read"),
    ("click", "Edit"),
    ("purchase", "Write"),
    ("signup", "Bash"),
    ("error", "Grep"),
]
CHAT_EPOCH_US = 1704067200000000  # 2024-01-01T00:00:00Z


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _tool_name(event_type: Column) -> Column:
    out = None
    for ev, tool in TOOL_BY_EVENT:
        out = (F.when(event_type == ev, tool) if out is None else out.when(event_type == ev, tool))
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str, name: str, spread: bool) -> DataFrame:
    """A table; ``spread``: dealt out evenly, for work that makes much of a row. A file of few row
    groups is read by as few tasks."""
    t = read_table(spark, sf_dir, name)
    return t.hint("rebalance") if spread else t


def _event_lines(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    e = _rows(spark, sf_dir, "events", spread).select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    k, uid, eid = F.col("k"), F.col("user_id"), F.col("event_id")
    day = F.date_format("ts", "yyyyMMdd")
    session_id = F.concat(F.lit("u"), _s(uid), F.lit("-"), day)
    host = F.when(uid % 4 == 0, F.lit("local")).otherwise(F.concat(F.lit("h"), _s(uid % 4)))
    sidechain = (k % 8) == 0
    agent = F.when(sidechain, F.concat(F.lit("a"), _s(eid % 3)))
    proj_flat = F.concat(F.lit("-home-dev-proj"), _s(uid % 6))
    source_file = F.concat(
        F.lit("/home/dev/.claude/projects/"),
        proj_flat,
        F.lit("/"),
        F.when(sidechain, F.concat(session_id, F.lit("/subagents/agent-"), agent, F.lit(".jsonl"))).otherwise(
            F.concat(session_id, F.lit(".jsonl"))
        ),
    )
    tool = _tool_name(F.col("event_type"))
    tool_input = (
        F.when(
            tool.isin("Read", "Edit", "Write"),
            F.concat(F.lit('{"file_path":"/repo/src/m'), _s(k % 17), F.lit('.py"}')),
        )
        .when(tool == "Bash", F.concat(F.lit('{"command":"make step'), _s(k % 5), F.lit('"}')))
        .otherwise(F.concat(F.lit('{"pattern":"TODO'), _s(k % 5), F.lit('"}')))
    )
    ts_us = F.unix_micros("ts")
    res_us = ts_us + F.floor(F.col("value") * 100).cast("long") * 1000
    has_result = (k % 11) != 5
    has_retry = has_result & ((k % 13) == 4)
    use_id = F.concat(F.lit("t"), _s(eid))
    null_i = F.lit(None).cast("int")

    def line(kind, uuid, typ, subtype, t_us, parent, role, model, text, tin, tout, tcc, tcr,
             t_use_id, t_name, t_input, r_content, r_err, present):
        return F.struct(
            F.lit(kind).alias("kind"), uuid.alias("uuid"), F.lit(typ).alias("type"),
            F.lit(subtype).alias("subtype"), t_us.alias("t_us"), parent.alias("parent_uuid"),
            F.lit(role).alias("role"), model.alias("model"), text.alias("text_content"),
            tin.alias("input_tokens"), tout.alias("output_tokens"),
            tcc.alias("cache_creation_tokens"), tcr.alias("cache_read_tokens"),
            t_use_id.alias("tool_use_id"), t_name.alias("tool_name"), t_input.alias("tool_input"),
            r_content.alias("result_content"), r_err.alias("is_error"), present.alias("present"),
        )

    a_uuid = F.concat(F.lit("e"), _s(eid), F.lit("a"))
    a = line(
        "a", a_uuid, "assistant", "assistant_message", ts_us, F.lit(None).cast("string"),
        "assistant", _pick(EVENT_MODELS, (uid + k) % 5),
        F.concat(F.lit("Running "), tool, F.lit(" step "), _s(k)),
        (k * 37 + 11).cast("int"), F.floor(F.col("value") * 13).cast("int"),
        F.when(k % 10 == 3, null_i).otherwise((k * 101).cast("int")),
        (((k * k) % 97) * 250).cast("int"),
        use_id, tool, tool_input, F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(True),
    )
    r = line(
        "r", F.concat(F.lit("e"), _s(eid), F.lit("r")), "user", "tool_result", res_us, a_uuid,
        "user", F.lit(None).cast("string"),
        F.concat(tool, F.lit(" output for "), F.col("event_type"), F.lit(" #"), _s(k)),
        null_i, null_i, null_i, null_i,
        use_id, F.lit(None).cast("string"), F.lit(None).cast("string"),
        F.concat(tool, F.lit(" output for "), F.col("event_type"), F.lit(" #"), _s(k)),
        F.when(k % 10 == 0, F.lit(None).cast("boolean")).otherwise(F.col("event_type") == "error"),
        has_result,
    )
    s = line(
        "s", F.concat(F.lit("e"), _s(eid), F.lit("s")), "user", "tool_result", res_us + 1000000, a_uuid,
        "user", F.lit(None).cast("string"),
        F.concat(tool, F.lit(" retry failed #"), _s(k)),
        null_i, null_i, null_i, null_i,
        use_id, F.lit(None).cast("string"), F.lit(None).cast("string"),
        F.concat(tool, F.lit(" retry failed #"), _s(k)), F.lit(True),
        has_retry,
    )
    return (
        e.select(
            session_id.alias("session_id"), host.alias("host"),
            F.when(k % 9 == 0, F.lit(None).cast("string")).otherwise(
                F.concat(F.lit("/home/dev/proj"), _s(uid % 6))).alias("cwd"),
            F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(
                F.concat(F.lit("br"), _s(k % 3))).alias("git_branch"),
            F.concat(F.lit("2.1."), _s(k % 4)).alias("cc_version"),
            F.lit("cli").alias("entrypoint"),
            sidechain.alias("is_sidechain"), agent.alias("agent_id"),
            source_file.alias("source_file"),
            F.explode(F.array(a, r, s)).alias("l"),
        )
        .filter(F.col("l.present"))
        .select("*", "l.*")
        .drop("l", "present")
    )


def _chat_lines(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    c = _rows(spark, sf_dir, "conversations", spread).select("conv_id", "turn", "role", "text")
    cid, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    L = F.length("text")
    is_asst = role == "assistant"
    sidechain = role == "system"
    session_id = F.concat(F.lit("c"), _s(cid))
    agent = F.when(sidechain, F.concat(F.lit("s"), _s(turn % 2)))
    proj_flat = F.concat(F.lit("-home-dev-chat"), _s(cid % 5))
    null_i = F.lit(None).cast("int")
    return c.select(
        F.lit("c").alias("kind"),
        session_id.alias("session_id"),
        F.when(cid % 3 == 0, F.lit("local")).otherwise(F.concat(F.lit("h"), _s(cid % 3))).alias("host"),
        F.concat(F.lit("/home/dev/chat"), _s(cid % 5)).alias("cwd"),
        F.lit("main").alias("git_branch"),
        F.concat(F.lit("2.0."), _s(cid % 3)).alias("cc_version"),
        F.lit("sdk").alias("entrypoint"),
        sidechain.alias("is_sidechain"),
        agent.alias("agent_id"),
        F.concat(
            F.lit("/home/dev/.claude/projects/"), proj_flat, F.lit("/"),
            F.when(sidechain, F.concat(session_id, F.lit("/subagents/agent-"), agent, F.lit(".jsonl"))).otherwise(
                F.concat(session_id, F.lit(".jsonl")))
        ).alias("source_file"),
        F.concat(F.lit("c"), _s(cid), F.lit("-"), _s(turn)).alias("uuid"),
        F.when(is_asst, "assistant").otherwise("user").alias("type"),
        F.when(is_asst, "assistant_message").otherwise("user_message").alias("subtype"),
        (F.lit(CHAT_EPOCH_US) + (cid * 3600 + turn * 700 + L % 600) * 1000000).alias("t_us"),
        F.when(turn > 0, F.concat(F.lit("c"), _s(cid), F.lit("-"), _s(turn - 1))).alias("parent_uuid"),
        F.when(is_asst, "assistant").otherwise("user").alias("role"),
        F.when(is_asst, _pick(CHAT_MODELS, cid % 4)).alias("model"),
        F.col("text").alias("text_content"),
        F.when(is_asst, (L * 2 + 100).cast("int")).alias("input_tokens"),
        F.when(is_asst, L.cast("int")).alias("output_tokens"),
        F.when(is_asst & (turn % 3 != 0), (L * 5).cast("int")).alias("cache_creation_tokens"),
        F.when(is_asst, (L * 40).cast("int")).alias("cache_read_tokens"),
        F.lit(None).cast("string").alias("tool_use_id"),
        F.lit(None).cast("string").alias("tool_name"),
        F.lit(None).cast("string").alias("tool_input"),
        F.lit(None).cast("string").alias("result_content"),
        F.lit(None).cast("boolean").alias("is_error"),
    )


@dataclass
class Bound:
    """Canonical typed tables bound from the driver data."""

    lines: DataFrame  # one row per transcript line, all typed fields

    @property
    def events(self) -> DataFrame:
        return self.lines.select(
            "uuid", "session_id", "parent_uuid", "type", "subtype", "timestamp", "cwd",
            project_path_from_file(F.col("source_file")).alias("project_path"),
            "git_branch", "cc_version", "entrypoint", "host", "is_sidechain", "agent_id",
            F.when(F.col("type") == "assistant", F.concat(F.lit("req-"), "uuid")).alias("request_id"),
            "source_file",
        )

    @property
    def messages(self) -> DataFrame:
        return self.lines.select(
            "uuid", "session_id", "role", "timestamp", "model", "text_content",
            "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens",
            "is_sidechain", "host",
        )

    @property
    def tool_uses(self) -> DataFrame:
        return self.lines.filter(F.col("tool_name").isNotNull()).select(
            "uuid", "session_id", "timestamp", "tool_use_id", "tool_name",
            F.col("tool_input").alias("input"), "source_file", "host",
        )

    @property
    def tool_results(self) -> DataFrame:
        return self.lines.filter(
            (F.col("type") == "user") & F.col("tool_use_id").isNotNull()
        ).select(
            "uuid", "timestamp", "tool_use_id", F.col("result_content").alias("content"),
            "is_error", "source_file",
        )


# Driver event type -> session hook it stands for.
HOOK_BY_EVENT = [("signup", "SessionStart"), ("purchase", "Stop"), ("error", "SessionEnd")]
# Driver event type -> pull outcome of the host-sync log.
OUTCOME_BY_EVENT = [("error", "error"), ("click", "error"), ("view", "empty")]


def hook_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session hook signals (T5 input): one per driver event, same session mapping."""
    use_utc(spark)
    e = read_table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"), "user_id", "event_type")
    hook = None
    for ev, h in HOOK_BY_EVENT:
        hook = F.when(F.col("event_type") == ev, h) if hook is None else hook.when(F.col("event_type") == ev, h)
    return e.select(
        F.concat(F.lit("u"), _s("user_id"), F.lit("-"), F.date_format("timestamp", "yyyyMMdd")).alias("session_id"),
        hook.otherwise("PostToolUse").alias("hook"),
        "timestamp",
    )


def pull_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host-sync pull log (H1 input): (host, timestamp, kind, message)."""
    use_utc(spark)
    e = read_table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("timestamp"), "user_id", "event_type")
    kind = None
    for ev, k in OUTCOME_BY_EVENT:
        kind = F.when(F.col("event_type") == ev, k) if kind is None else kind.when(F.col("event_type") == ev, k)
    kind = kind.otherwise("non-empty")
    uid = F.col("user_id")
    return e.select(
        F.when(uid % 4 == 0, F.lit("local")).otherwise(F.concat(F.lit("h"), _s(uid % 4))).alias("host"),
        "timestamp",
        kind.alias("kind"),
        F.when(kind == "error", F.concat(F.lit("pull failed: event "), _s("event_id"))).alias("message"),
    )


def bind(spark: SparkSession, sf_dir: str, spread: bool = False) -> Bound:
    use_utc(spark)
    lines = _event_lines(spark, sf_dir, spread).unionByName(_chat_lines(spark, sf_dir, spread))
    lines = lines.withColumn("timestamp", F.timestamp_micros("t_us")).drop("t_us", "kind")
    return Bound(lines)


def transcript_lines(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """The bound data rendered as JSONL transcript lines ``(value, source_file, line_key, host)``.

    Adds the dirt real transcripts carry: a truncated JSON line per driver event with
    k % 17 = 0 (-> quarantine), a blank line when k % 19 = 0 (skipped), a line without
    uuid when k % 23 = 0 (dropped), and a ``\\u0000`` escape inside the type of result
    lines with k % 7 = 1 (stripped before parsing). ``spread``: rendered in tasks of like size.
    """
    b = bind(spark, sf_dir, spread).lines
    # JSON text is assembled from plain to_json pieces (no VARIANT round trip): the tool
    # input is a map, a string content is the escaped text itself
    block = lambda **kw: F.struct(
        *[
            (kw.get(n, F.lit(None).cast(t))).alias(n)
            for n, t in [("type", "string"), ("text", "string"), ("id", "string"), ("name", "string"),
                         ("input", "map<string,string>"), ("tool_use_id", "string"), ("content", "string"),
                         ("is_error", "boolean")]
        ]
    )
    is_use = F.col("tool_name").isNotNull()
    is_res = (F.col("type") == "user") & F.col("tool_use_id").isNotNull()
    asst_blocks = F.when(
        is_use,
        F.array(
            block(type=F.lit("text"), text=F.col("text_content")),
            block(type=F.lit("tool_use"), id=F.col("tool_use_id"), name=F.col("tool_name"),
                  input=F.from_json(F.col("tool_input"), "map<string,string>")),
        ),
    ).otherwise(F.array(block(type=F.lit("text"), text=F.col("text_content"))))
    res_blocks = F.array(block(type=F.lit("tool_result"), tool_use_id=F.col("tool_use_id"),
                               content=F.col("result_content"), is_error=F.col("is_error")))
    usage = F.when(
        F.col("role") == "assistant",
        F.struct(
            F.col("input_tokens").alias("input_tokens"), F.col("output_tokens").alias("output_tokens"),
            F.col("cache_creation_tokens").alias("cache_creation_input_tokens"),
            F.col("cache_read_tokens").alias("cache_read_input_tokens"),
        ),
    )
    head = F.to_json(F.struct(
        F.col("uuid").alias("uuid"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        F.col("type").alias("type"),
        F.col("session_id").alias("sessionId"),
        F.col("parent_uuid").alias("parentUuid"),
        F.col("cwd").alias("cwd"),
        F.col("git_branch").alias("gitBranch"),
        F.col("cc_version").alias("version"),
        F.col("entrypoint").alias("entrypoint"),
        F.col("is_sidechain").alias("isSidechain"),
        F.col("agent_id").alias("agentId"),
        F.when(F.col("type") == "assistant", F.concat(F.lit("req-"), F.col("uuid"))).alias("requestId"),
    ))
    msg = F.to_json(F.struct(F.col("role").alias("role"), F.col("model").alias("model"), usage.alias("usage")))
    text_json = F.to_json(F.struct(F.col("text_content").alias("c")))
    content = (
        F.when(F.col("type") == "assistant", F.to_json(asst_blocks))
        .when(is_res, F.to_json(res_blocks))
        .otherwise(F.expr("substring(_tj, 6, length(_tj) - 6)"))
    )
    b = b.withColumn("_tj", text_json).withColumn("_head", head).withColumn("_msg", msg)
    js = F.concat(
        F.expr("substring(_head, 1, length(_head) - 1)"), F.lit(',"message":'),
        F.expr("substring(_msg, 1, length(_msg) - 1)"), F.lit(',"content":'), content, F.lit("}}"),
    )
    nul = is_res & (F.regexp_extract("uuid", r"^e\d+r$", 0) != "") & (F.expr("try_cast(regexp_extract(text_content, '#(\\\\d+)$', 1) as int)") % 7 == 1)
    good = b.select(
        F.when(nul, F.replace(js, F.lit('"type":"user"'), F.lit('"type":"us\\u0000er"'))).otherwise(js).alias("value"),
        "source_file",
        F.struct(F.col("timestamp").alias("t"), F.col("uuid").alias("k")).alias("line_key"),
        "host",
    )
    e = read_table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    uid, k = F.col("user_id"), F.col("k")
    session_id = F.concat(F.lit("u"), _s(uid), F.lit("-"), F.date_format("ts", "yyyyMMdd"))
    main_file = F.concat(F.lit("/home/dev/.claude/projects/-home-dev-proj"), _s(uid % 6), F.lit("/"), session_id, F.lit(".jsonl"))
    host = F.when(uid % 4 == 0, F.lit("local")).otherwise(F.concat(F.lit("h"), _s(uid % 4)))
    junk = e.select(
        main_file.alias("source_file"), host.alias("host"), "ts",
        F.explode(F.array(
            F.struct(F.lit("bad").alias("k"), F.when(k % 17 == 0, F.concat(F.lit('{"uuid": "bad'), _s("event_id"))).alias("value")),
            F.struct(F.lit("blank").alias("k"), F.when(k % 19 == 0, F.lit("")).alias("value")),
            F.struct(F.lit("nouuid").alias("k"), F.when(k % 23 == 0, F.concat(
                F.lit('{"type":"progress","timestamp":"'),
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.lit('","data":{"type":"hook_progress"}}'))).alias("value")),
        )).alias("j"),
    ).filter(F.col("j.value").isNotNull()).select(
        F.col("j.value").alias("value"), "source_file",
        F.struct(F.col("ts").alias("t"), F.col("j.k").alias("k")).alias("line_key"), "host",
    )
    return good.unionByName(junk)


# Secret shapes injected into documents by doc_id % 8 (one per redaction
# rule, plus a JWT inside a bearer header to check the rule order).
def documents_with_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with one synthetic secret appended per document (the corpus has
    none of the rule shapes on its own)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    i = _s("doc_id")

    def h(p):
        return F.md5(F.concat(F.lit(p), i))

    jwt = F.concat(F.lit("eyJ"), h("a"), F.lit(".eyJ"), h("b"), F.lit("."), h("c"))
    kind = F.col("doc_id") % 8
    secret = (
        F.when(kind == 0, jwt)
        .when(kind == 1, F.concat(F.lit("key sk-ant-"), h("k")))
        .when(kind == 2, F.concat(F.lit("sk-"), h("k")))
        .when(kind == 3, F.concat(F.lit("AKIA"), F.upper(F.substring(h("k"), 1, 16))))
        .when(kind == 4, F.concat(F.lit("ghp_"), h("k")))
        .when(kind == 5, F.concat(F.lit("github_pat_"), h("k")))
        .when(kind == 6, F.concat(F.lit("Authorization: Bearer "), h("k")))
        .otherwise(F.concat(F.lit("Authorization: Bearer "), jwt))
    )
    return d.select("doc_id", F.concat(F.col("text"), F.lit(" "), secret).alias("text"))


def _chat_ts_us(L: Column) -> Column:
    return F.lit(CHAT_EPOCH_US) + (F.col("conv_id") * 3600 + F.col("turn") * 700 + L % 600) * 1000000


def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt-history lines rendered from the user/system turns of ``conversations``:
    project absent when conv_id % 6 = 1; ``pastedContents`` only on odd turns; every
    turn-0 line is written twice (the dedup key must remove the copy)."""
    c = read_table(spark, sf_dir, "conversations").filter(F.col("role") != "assistant")
    L = F.length("text")
    ms = (_chat_ts_us(L) / 1000).cast("long")
    line = F.struct(
        F.col("text").alias("display"),
        F.when(F.col("turn") % 2 == 1, F.struct(F.col("turn").alias("n"))).alias("pastedContents"),
        ms.alias("timestamp"),
        F.when(F.col("conv_id") % 6 != 1, F.concat(F.lit("/home/dev/chat"), _s(F.col("conv_id") % 5))).alias("project"),
    )
    copies = F.when(F.col("turn") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    c = c.select("*", F.explode(copies).alias("copy"))
    return c.select(
        F.to_json(line).alias("value"),
        F.lit("/home/dev/.claude/history.jsonl").alias("source_file"),
        F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("copy")).alias("line_key"),
        F.when(F.col("conv_id") % 3 == 0, F.lit("local")).otherwise(F.concat(F.lit("h"), _s(F.col("conv_id") % 3))).alias("host"),
    )


def todo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Todo files rendered from ``conversations``: one per turn, agent = turn; the body is
    malformed for turn 3."""
    c = read_table(spark, sf_dir, "conversations")
    sid = F.concat(F.lit("c"), _s("conv_id"))
    body = F.when(F.col("turn") == 3, F.lit("[{")).otherwise(F.concat(
        F.lit('[{"content":"'), F.md5("text"), F.lit('","id":"'), _s("turn"), F.lit('","status":"'),
        F.when(F.col("role") == "assistant", F.lit("completed")).otherwise(F.lit("pending")), F.lit('"}]')))
    return c.select(
        F.concat(F.lit("/home/dev/.claude/todos/"), sid, F.lit("-agent-a"), _s("turn"), F.lit(".json")).alias("path"),
        F.timestamp_micros(_chat_ts_us(F.length("text"))).alias("modificationTime"),
        F.encode(body, "UTF-8").alias("content"),
    )


FILE_HISTORY_ROOT = "/home/dev/.claude/file-history"


def file_history_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File-history snapshots rendered from ``pages``: session dir = page_id % 7, key =
    md5(url), version = page_id % 3 + 1; a NUL byte is appended when page_id % 11 = 0."""
    p = read_table(spark, sf_dir, "pages")
    body = F.concat(F.col("html"), F.when(F.col("page_id") % 11 == 0, F.lit("\u0000")).otherwise(F.lit("")))
    return p.select(
        F.concat(F.lit(FILE_HISTORY_ROOT + "/s"), _s(F.col("page_id") % 7), F.lit("/"), F.md5("url"),
                 F.lit("@v"), _s(F.col("page_id") % 3 + 1)).alias("path"),
        F.timestamp_micros(F.lit(CHAT_EPOCH_US) + F.col("page_id") * 60000000).alias("modificationTime"),
        F.encode(body, "UTF-8").alias("content"),
    )


def shell_snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shell snapshots rendered from ``benchmark``; every 9th name does not match."""
    b = read_table(spark, sf_dir, "benchmark")
    ms = F.lit(1704067200000) + F.col("item_id") * 60000
    ext = F.when(F.col("item_id") % 9 == 0, F.lit(".txt")).otherwise(F.lit(".sh"))
    return b.select(
        F.concat(F.lit("/home/dev/.claude/shell-snapshots/snapshot-zsh-"), _s(ms), F.lit("-"),
                 F.substring(F.md5(_s("item_id")), 1, 8), ext).alias("path"),
        F.timestamp_millis(ms).alias("modificationTime"),
        F.encode(F.col("text"), "UTF-8").alias("content"),
    )

"""Line-delimited JSON transcripts -> typed tables.

Reading is thin (``read_jsonl``); everything after it works on a DataFrame of
``(value, source_file, line_key)`` rows, so files, a stream, or lines built from other
tables go through the same plan. Parsing uses VARIANT (``try_parse_json``: NULL on a
bad line instead of a failed job). Polymorphic message content (a string or an array
of typed blocks) is handled with higher-order array functions inside one projection:
no explode + re-group, hence no shuffle for text flattening.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import agent_id_from_path, is_sidechain_path, project_path_from_file


def read_jsonl(spark: SparkSession, path: str, recursive: bool = True, glob: str = "*.jsonl") -> DataFrame:
    """Every ``*.jsonl`` under ``path`` (sub-agent files included) as lines.

    ``line_key`` orders the lines of one file (block start, then position), which is
    all later steps need ("first"/"last" line); exact numbers are ``with_line_numbers``.
    """
    df = (
        spark.read.option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", glob)
        .text(path)
    )
    return df.select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
        ).alias("line_key"),
    )


def with_line_numbers(lines: DataFrame, split: Column | None = None) -> DataFrame:
    """``line_no``: 1-based number of a line in its file, blank lines counted. Lines are numbered
    inside their split (``line_key.block``, a bounded part of a file), and the splits' prefix
    sums of line counts are added, so no task holds a whole file. ``split``: another column that
    cuts files in the order of their lines."""
    from pyspark.sql import Window

    cut = lines.withColumn("_split", F.col("line_key")["block"] if split is None else split)
    inside = cut.withColumn("_in", F.row_number().over(Window.partitionBy("source_file", "_split").orderBy("line_key")))
    counts = cut.groupBy("source_file", "_split").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("source_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("source_file", "_split", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return inside.join(before, ["source_file", "_split"]).select(*lines.columns, (F.col("_before") + F.col("_in")).alias("line_no"))


def sanitize(value: Column) -> Column:
    """Remove literal NUL characters and the ``\\u0000`` escape before parsing."""
    return F.replace(F.replace(value, F.lit("\u0000"), F.lit("")), F.lit("\\u0000"), F.lit(""))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Skip empty lines; ``v`` is the parsed VARIANT, NULL when the line is not JSON.

    The parsed row leaves through a generator (``inline`` of a one-element array).
    Predicates of later steps cannot be pushed below a generator, so they read ``v``
    instead of having ``try_parse_json`` substituted into each of them: each line is
    parsed exactly once. The parser ignores what follows a value, so an object with text
    after its end is told by its last character (two objects on one line count as the
    first)."""
    cols = [F.col(c) for c in lines.columns]
    # the text is a column of its own, as a generator computes it anew wherever its row names it
    texts = lines.filter(F.length("value") > 0).withColumn("_text", sanitize(F.col("value")))
    whole = F.col("_text").startswith("{") & F.col("_text").endswith("}")
    texts = texts.withColumn("_text", F.when(whole, F.col("_text")).otherwise(F.btrim("_text", F.lit(" \t\r\n"))))
    torn = F.col("_text").startswith("{") & ~F.col("_text").endswith("}")
    row = F.struct(*cols, F.when(~torn, F.try_parse_json("_text")).alias("v"))
    return texts.select(F.inline(F.array(row)))


def quarantine(parsed: DataFrame) -> DataFrame:
    """The malformed-line channel (raw text kept, nothing fails)."""
    return parsed.filter(F.col("v").isNull()).select("source_file", "line_key", F.col("value").alias("raw"))


def quarantine_report(lines: DataFrame, split: Column | None = None) -> DataFrame:
    """S2 with the line's number in its file and the parser's message: (source_file, line_no, raw,
    error). Only line keys are numbered, and only malformed lines go to the Python parser that
    words the message (Spark's own gives none)."""
    from ..functions.text import json_error
    from ..session import ship_package

    ship_package(lines.sparkSession)
    bad = quarantine(parse_lines(lines.select("value", "source_file", "line_key")))
    numbers = with_line_numbers(lines.select("source_file", "line_key"), split)
    return bad.join(numbers, ["source_file", "line_key"]).select("source_file", "line_no", "raw", json_error(sanitize(F.col("raw"))).alias("error"))


def _get(v: Column | str, path: str, typ: str = "string") -> Column:
    c = F.col(v) if isinstance(v, str) else v
    return F.try_variant_get(c, path, typ)


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _if_string(v: Column) -> Column:
    return F.when(_is_string(v), _get(v, "$"))


def content_blocks(payload: Column, fields: str = "type string") -> Column:
    """``message.content`` as an array of structs of the blocks' ``fields``; NULL when it is a string
    or absent. A block that is no object is NULL. (A part that is cast to VARIANT is built
    anew, so only the fields that need one are.)"""
    return _get(payload, "$.message.content", f"array<struct<{fields}>>")


def flatten_content(payload: Column) -> Column:
    """A string content as is; else the ``\\n`` join of text blocks, string
    tool_result contents and the inner ``text`` of array tool_result contents; other
    blocks are ignored; no content gives ''.

    The array test comes first (a cheap cast); only non-arrays get the type probe, so
    large block arrays are never walked just to learn they are not strings."""
    blocks = content_blocks(payload, "type string, text variant, content variant")
    content = F.try_variant_get(payload, "$.message.content", "variant")
    as_str = _if_string(content)

    def block_parts(b: Column) -> Column:
        btype = b["type"]
        inner = _get(b["content"], "$", "array<struct<text variant>>")
        inner_texts = F.filter(F.transform(inner, lambda i: _if_string(i["text"])), lambda z: z.isNotNull())
        return (
            F.when((btype == "text") & _is_string(b["text"]), F.array(_get(b["text"], "$")))
            .when((btype == "tool_result") & _is_string(b["content"]), F.array(_get(b["content"], "$")))
            .when((btype == "tool_result") & inner.isNotNull(), inner_texts)
            .otherwise(F.array().cast("array<string>"))
        )

    from_blocks = F.array_join(F.flatten(F.transform(blocks, block_parts)), "\n")
    return F.when(blocks.isNotNull(), from_blocks).otherwise(F.coalesce(as_str, F.lit("")))


def event_subtype(payload: Column, typ: Column) -> Column:
    """Progress -> data.type; assistant -> assistant_message; user -> tool_result if
    any block is one, else user_message; file-history-snapshot -> file_snapshot."""
    has_result = F.exists(content_blocks(payload), lambda b: b["type"] == "tool_result")
    return (
        F.when(typ == "progress", _get(payload, "$.data.type"))
        .when(typ == "assistant", F.lit("assistant_message"))
        .when(typ == "user", F.when(F.coalesce(has_result, F.lit(False)), "tool_result").otherwise("user_message"))
        .when(typ == "file-history-snapshot", F.lit("file_snapshot"))
    )


def _truthy(x: Column) -> Column:
    """JavaScript ``Boolean(x)`` for a JSON leaf."""
    t = F.schema_of_variant(x)
    return (
        F.when(t == "BOOLEAN", _get(x, "$", "boolean"))
        .when(t == "STRING", F.length(_get(x, "$")) > 0)
        .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL"),
              _get(x, "$", "double") != 0)
        .when(t.startswith("OBJECT") | t.startswith("ARRAY"), F.lit(True))
        .otherwise(F.lit(False))
    )


def to_events(parsed: DataFrame, host: str | Column | None = None) -> DataFrame:
    """S3 + D9: typed events. Lines without uuid, timestamp or type are dropped;
    session defaults to 'unknown'; the path decides sidechain / agent id first."""
    return typed_events(event_lines(parsed, host))


def event_lines(parsed: DataFrame, host: str | Column | None = None) -> DataFrame:
    """The lines that are events, with what tells it: (uuid, type, timestamp, host, source_file,
    line_key, payload). These leave through a generator, as the conditions on them would compute
    them once more."""
    host_c = host if isinstance(host, Column) else (F.lit(host) if host else F.col("host") if "host" in parsed.columns else F.lit("local"))
    top = _get("v", "$", "struct<uuid string, type string, timestamp string>").alias("top")
    found = parsed.filter(F.col("v").isNotNull()).select(F.inline(F.array(F.struct(top, host_c.alias("host"), "source_file", "line_key", F.col("v").alias("payload")))))
    found = found.filter((F.length("top.uuid") > 0) & (F.length("top.type") > 0)).select(
        F.inline(F.array(F.struct("top.uuid", "top.type", F.col("top.timestamp").try_cast("timestamp").alias("timestamp"), "host", "source_file", "line_key", "payload"))))
    return found.filter(F.col("timestamp").isNotNull())


def typed_events(lines: DataFrame, *more: str) -> DataFrame:
    """S3's columns of ``event_lines``, and ``more`` of its columns. A line's own fields are looked up in
    one pass over it."""
    v, f = F.col("payload"), F.col("source_file")
    names = {"sessionId": "session_id", "parentUuid": "parent_uuid", "cwd": "cwd", "gitBranch": "git_branch", "version": "cc_version",
             "entrypoint": "entrypoint", "agentId": "agent_id", "requestId": "request_id"}
    top = _get(v, "$", f"struct<{', '.join(f'{n} string' for n in names)}, isSidechain variant>")
    e = lines.withColumn("top", top)
    of = {column: F.col("top")[n] for n, column in names.items()}
    return e.select(
        "uuid",
        F.coalesce(of["session_id"], F.lit("unknown")).alias("session_id"),
        of["parent_uuid"].alias("parent_uuid"),
        "type",
        event_subtype(v, F.col("type")).alias("subtype"),
        "timestamp",
        of["cwd"].alias("cwd"),
        project_path_from_file(f).alias("project_path"),
        of["git_branch"].alias("git_branch"),
        of["cc_version"].alias("cc_version"),
        of["entrypoint"].alias("entrypoint"),
        "host",
        (is_sidechain_path(f) | _truthy(F.col("top")["isSidechain"])).alias("is_sidechain"),
        F.coalesce(agent_id_from_path(f), of["agent_id"]).alias("agent_id"),
        of["request_id"].alias("request_id"),
        "payload",
        "source_file",
        "line_key",
        *more,
    )


#: Token counts of a message and the columns they become.
_USAGE = {"input_tokens": "input_tokens", "output_tokens": "output_tokens",
          "cache_creation_input_tokens": "cache_creation_tokens", "cache_read_input_tokens": "cache_read_tokens"}


def _message_rows(events: DataFrame, *columns: str) -> DataFrame:
    """Columns of events, the payload and ``m``: the fields of its message, looked up once."""
    fields = _get("payload", "$.message", f"struct<role string, model string, usage struct<{', '.join(f'{n} int' for n in _USAGE)}>>")
    return events.select(F.inline(F.array(F.struct(*columns, "payload", fields.alias("m")))))


def _has_message() -> Column:
    msg = F.try_variant_get("payload", "$.message", "variant")
    return F.col("m").isNotNull() | (msg.isNotNull() & ~F.is_variant_null(msg))


def derive_messages(events: DataFrame) -> DataFrame:
    """user/assistant events that carry a message."""
    rows = _message_rows(events.filter(F.col("type").isin("user", "assistant")), "uuid", "session_id", "timestamp", "is_sidechain", "host")
    return rows.filter(_has_message()).select(
        "uuid",
        "session_id",
        F.when(F.col("m.role") == "assistant", "assistant").otherwise("user").alias("role"),
        "timestamp",
        F.col("m.model").alias("model"),
        flatten_content(F.col("payload")).alias("text_content"),
        *(F.col(f"m.usage.{n}").alias(column) for n, column in _USAGE.items()),
        "is_sidechain",
        "host",
    )


def session_lines(events: DataFrame) -> DataFrame:
    """Events with what D5 asks of their messages (D1; the text of users only) and whether they use a
    tool (D3), as ``derive.session_parts_lines`` takes them: found in the row, without a join."""
    columns = ["uuid", "session_id", "type", "timestamp", "cwd", "git_branch", "cc_version", "is_sidechain", "agent_id", "host"]
    has = F.col("type").isin("user", "assistant") & _has_message()
    role = F.when(has & (F.col("m.role") == "assistant"), "assistant").when(has, "user")
    used = (F.col("type") == "assistant") & F.exists(content_blocks(F.col("payload")), lambda b: b["type"] == "tool_use")
    rows = _message_rows(events, *columns)
    rows = rows.select(F.inline(F.array(F.struct(*columns, "payload", "m", role.alias("m_role"), F.when(used, 1).alias("used")))))
    of_message = lambda c: F.when(F.col("m_role").isNotNull(), F.col(c))
    return rows.select(
        *columns, "m_role", of_message("m.model").alias("m_model"),
        F.when(F.col("m_role") == "user", flatten_content(F.col("payload"))).alias("m_text"),
        *(of_message(f"m.usage.{n}").alias(column) for n, column in _USAGE.items()), "used",
    )


def _json_text(v: Column) -> Column:
    """A JSON leaf as text: strings as themselves, anything else as JSON."""
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string")).otherwise(F.to_json(v))


#: Fields of a tool_use block.
_USE = "type string, id string, name string, input variant"


def _use_columns() -> list[Column]:
    return [F.col("b.id").alias("tool_use_id"), F.col("b.name").alias("tool_name"), F.to_json("b.input").alias("input")]


def extract_tool_uses(events: DataFrame) -> DataFrame:
    """D3: tool_use blocks of assistant events (``block_pos`` keeps N8 deterministic)."""
    a = events.filter(F.col("type") == "assistant").select(
        "uuid", "session_id", "timestamp", "source_file", "host",
        F.posexplode(content_blocks(F.col("payload"), _USE)).alias("block_pos", "b"),
    )
    a = a.filter(F.col("b.type") == "tool_use")
    return a.select("uuid", "session_id", "timestamp", *_use_columns(), "source_file", "host", "block_pos")


def extract_first_uses(events: DataFrame) -> DataFrame:
    """N8 where an event is one row: its first tool_use block, found in the row."""
    blocks = F.filter(content_blocks(F.col("payload"), _USE), lambda b: b["type"] == "tool_use")
    a = events.filter(F.col("type") == "assistant").select(
        "uuid", "session_id", "timestamp", "source_file", "host", F.explode(F.slice(blocks, 1, 1)).alias("b"))
    return a.select("uuid", "session_id", "timestamp", *_use_columns(), "source_file", "host")


def extract_tool_results(events: DataFrame) -> DataFrame:
    """D4 input: tool_result blocks of user events, in line order."""
    u = events.filter(F.col("type") == "user").select(
        "uuid", "timestamp", "source_file",
        F.explode(content_blocks(F.col("payload"), "type string, tool_use_id string, content variant, is_error boolean")).alias("b"),
    )
    u = u.filter(F.col("b.type") == "tool_result")
    return u.select(
        "uuid", "timestamp", F.col("b.tool_use_id").alias("tool_use_id"), _json_text(F.col("b.content")).alias("content"),
        F.col("b.is_error").alias("is_error"), "source_file",
    )


def enumerate_sources(home: str) -> dict:
    """The transcript tree and the optional side files of one home directory
    (driver-side existence checks of five fixed names; the files are read by Spark)."""
    import os

    def opt(name):
        p = os.path.join(home, name)
        return p if os.path.exists(p) else None

    return {
        "transcripts": opt("projects"),
        "history": opt("history.jsonl"),
        "todos": opt("todos"),
        "file_history": opt("file-history"),
        "shell_snapshots": opt("shell-snapshots"),
    }

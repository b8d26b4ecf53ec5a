"""Side files next to the transcripts, and the K6 natural-key dedup.

Readers are thin (``spark.read.text`` / ``binaryFile``); the transforms take the
reader's DataFrame shape, so the same plan runs on files or on rows built elsewhere:

* lines:  ``(value, source_file, line_key)``              -> prompt history
* files:  ``(path, modificationTime, content: binary)``    -> todos, file snapshots,
                                                             shell snapshots
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .transcripts import sanitize

_NUMERIC = ["BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT"]


def _host(df: DataFrame, host) -> Column:
    if isinstance(host, Column):
        return host
    if host:
        return F.lit(host)
    return F.col("host") if "host" in df.columns else F.lit("local")


def read_history_lines(spark: SparkSession, file: str) -> DataFrame:
    df = spark.read.text(file)
    return df.select("value", F.col("_metadata.file_path").alias("source_file"),
                     F.monotonically_increasing_id().alias("line_key"))


def parse_history(lines: DataFrame, host=None) -> DataFrame:
    """A numeric ``timestamp`` (epoch ms) and a string ``display`` are required;
    ``pastedContents`` defaults to ``{}``."""
    v = F.try_parse_json(sanitize(F.col("value")))
    p = lines.filter(F.length("value") > 0).select("*", v.alias("v"))
    ts_t = F.schema_of_variant(F.try_variant_get("v", "$.timestamp", "variant"))
    disp_t = F.schema_of_variant(F.try_variant_get("v", "$.display", "variant"))
    ok = (ts_t.isin(_NUMERIC) | ts_t.startswith("DECIMAL")) & (disp_t == "STRING")
    pasted = F.try_variant_get("v", "$.pastedContents", "variant")
    pasted_ok = pasted.isNotNull() & (F.schema_of_variant(pasted) != "NULL")
    return p.filter(ok).select(
        F.try_variant_get("v", "$.project", "string").alias("project_path"),
        F.try_variant_get("v", "$.display", "string").alias("display"),
        F.when(pasted_ok, F.to_json(pasted)).otherwise(F.lit("{}")).alias("pasted_contents"),
        F.timestamp_millis(F.floor(F.try_variant_get("v", "$.timestamp", "double")).cast("long")).alias("typed_at"),
        _host(lines, host).alias("host"),
        "line_key",
    )


def dedup_history(history: DataFrame) -> DataFrame:
    """K6 key for prompts: (typed_at, md5(display), project_path); the first line wins.
    A NULL project never conflicts (as a NULL in a unique index), so those rows all stay."""
    keyed = history.filter(F.col("project_path").isNotNull())
    cols = [c for c in history.columns if c not in ("typed_at", "project_path", "line_key")]
    first = keyed.groupBy("typed_at", F.md5("display").alias("_dh"), "project_path").agg(
        F.min(F.struct("line_key", *cols)).alias("_r")
    ).select("typed_at", "project_path", *[F.col(f"_r.{c}").alias(c) for c in cols])
    nulls = history.filter(F.col("project_path").isNull()).drop("line_key")
    return first.unionByName(nulls)


def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select("path", "modificationTime", "content")


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


# Fixed value: the name pattern of these files.
TODO_NAME = r"^([a-zA-Z0-9\-]+)-agent-([^.]+)\.json$"


def parse_todos(files: DataFrame, host=None) -> DataFrame:
    """``<session>-agent-<agent>.json``; mtime is the snapshot time; bodies that are
    not JSON are skipped."""
    n = _name(F.col("path"))
    body = F.try_parse_json(F.col("content").cast("string"))
    f = files.select("*", n.alias("_n"), body.alias("_b")).filter(F.col("_n").rlike(TODO_NAME) & F.col("_b").isNotNull())
    return f.select(
        F.regexp_extract("_n", TODO_NAME, 1).alias("session_id"),
        F.regexp_extract("_n", TODO_NAME, 2).alias("agent_id"),
        F.col("modificationTime").alias("snapshot_at"),
        F.to_json("_b").alias("todos"),
        _host(files, host).alias("host"),
    )


def parse_file_history(files: DataFrame, root: str, host=None) -> DataFrame:
    """``<root>/<session>/<hash>@v<N>``; sha256 of the bytes; a NUL byte marks the
    file as binary and its content is not kept."""
    rx = "^" + root.rstrip("/").replace(".", r"\.") + r"/([^/]+)/(.+)@v(\d+)$"
    p = F.regexp_replace(F.col("path"), r"^file:", "")
    f = files.select("*", p.alias("_p")).filter(F.col("_p").rlike(rx) & ~F.regexp_extract("_p", rx, 2).contains("/"))
    text = F.col("content").cast("string")
    return f.select(
        F.regexp_extract("_p", rx, 1).alias("session_id"),
        F.regexp_extract("_p", rx, 2).alias("file_path"),
        F.regexp_extract("_p", rx, 3).cast("int").alias("version"),
        F.col("modificationTime").alias("snapshot_at"),
        F.when(F.instr(text, "\u0000") > 0, F.lit(None).cast("string")).otherwise(text).alias("content"),
        F.sha2(F.col("content"), 256).alias("sha256"),
        _host(files, host).alias("host"),
    )


# Fixed value: the name pattern of these files.
SHELL_NAME = r"^(snapshot-zsh-(\d+)-[^.]+)\.sh$"


def parse_shell_snapshots(files: DataFrame, host=None) -> DataFrame:
    """Id and capture time (epoch ms) come from the file name."""
    n = _name(F.col("path"))
    f = files.select("*", n.alias("_n")).filter(F.col("_n").rlike(SHELL_NAME))
    return f.select(
        F.regexp_extract("_n", SHELL_NAME, 1).alias("id"),
        F.timestamp_millis(F.regexp_extract("_n", SHELL_NAME, 2).cast("long")).alias("captured_at"),
        F.col("content").cast("string").alias("content"),
        _host(files, host).alias("host"),
    )

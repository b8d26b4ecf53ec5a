"""Batch backfill and live ingest (T1-T7) over one table layout.

Tables of a store (segments of files; ``store.py`` tells how they become visible):
  events         by ``day``          K1: insert if absent
  messages       by ``day``          K2
  tool_uses      by ``day``          D3: first tool_use block of an event
  tool_results                       D4: last result per call so far; calls are paired on read
  session_parts                      D5 as mergeable partial states, folded on read (K3)
  usage_parts                        D6 partial sums per (day, host, session, model) (K5)
  changes                            T7: change feed
  text_postings, text_postings_english, term_counts, text_totals     D7: text index, maintained
  event_keys, key_blooms by ``key_bucket``     uuids of all events (linear hashing, ``operators/keys.py``)
  liveness/      latest hook status per session, written by ``start_liveness`` (T5)

A store may keep some of the derived tables only (``ingest_lines(tables=...)``); it records
which, and every step keeps to that. Events and their keys are always kept.

``ingest_lines`` is the single incremental step; the backfill runs it once over a
directory, the live path runs it inside ``foreachBatch`` of a stream that tails files (T1,
T2). A step reads nothing that is stored but Bloom filter blocks and the key buckets that
may hold uuids of the batch; all it writes is derived from the batch's new events, so its
work follows the batch. Its segments become visible together. A step that failed anywhere
left nothing behind, so running it again, replays and overlapping files all end in the
tables of a single run (T3, T4). Late events (T6) add one more partial state of their
session; no watermark is needed for correctness.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.dates import TimeWindow
from ..operators import derive, keys, search
from ..operators import sinks as K
from ..operators.liveness import apply_liveness, session_liveness
from ..session import ensure_checkpoint_dir, plain_variants, use_utc
from ..sources import transcripts as tr
from ..sources.pricing import model_pricing
from ..sources.tail import tail_lines
from .store import Snapshot, Step, compact, snapshot

EVENT_COLS = ["uuid", "session_id", "parent_uuid", "type", "subtype", "timestamp", "cwd", "project_path",
              "git_branch", "cc_version", "entrypoint", "host", "is_sidechain", "agent_id", "request_id",
              "payload", "source_file", "line_key"]
CHANGE_COLS = ["uuid", "session_id", "type", "subtype", "timestamp", "host"]
#: Key buckets of a new store at least; more come as keys do.
FIRST_BUCKETS = 16
#: Parsed lines of a step under way, before stored and repeated uuids are left out: what is
#: needed for that, and the payload. The other columns are made of the lines that stay.
BATCH = "batch"
BATCH_COLS = ["uuid", "type", "timestamp", "host", "source_file", "line_key", "payload", "day"]
#: Repeated uuids of a batch up to which they are broadcast.
FEW = 100_000

_SCHEMAS: dict[str, dict[str, StructType]] = {}


def _p(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date("timestamp"))


#: Every table's rows as they follow from the batch's tables of earlier waves (``t``). What is
#: in one wave is written at the same time, and read back by the next.
WAVES: list[dict[str, Callable[[SparkSession, dict[str, DataFrame]], DataFrame]]] = [
    {
        "messages": lambda spark, t: _day(tr.derive_messages(t["events"])),
        "tool_uses": lambda spark, t: _day(tr.extract_first_uses(t["events"])),
        "tool_results": lambda spark, t: derive.fold_results(derive.last_results(tr.extract_tool_results(t["events"]))),
        "changes": lambda spark, t: t["events"].select(*CHANGE_COLS),
        "session_parts": lambda spark, t: derive.session_parts_lines(tr.session_lines(t["events"]), model_pricing(spark)),
        "event_keys": lambda spark, t: t["keyed"].select("uuid", "key_bucket"),
        "key_blooms": lambda spark, t: keys.blooms(t["keyed"]),
    },
    {
        "text_postings": lambda spark, t: search.build_index(t["messages"], ranged=True),
        "text_totals": lambda spark, t: search.text_totals(t["messages"]),
        "usage_parts": lambda spark, t: derive.usage_parts(t["messages"]),
    },
    {"text_postings_english": lambda spark, t: search.stem_postings(t["text_postings"], ranged=True)},
    {
        "term_counts": lambda spark, t: search.term_counts(t["text_postings"], "simple").unionByName(
            search.term_counts(t["text_postings_english"], "english")),
    },
]

#: What a store keeps with a table: what it is made of, beside the events, or made anew from (K8).
NEEDS = {"text_postings": ["messages"], "text_totals": ["messages"], "usage_parts": ["messages"], "session_parts": ["messages", "tool_uses"],
         "text_postings_english": ["text_postings"], "term_counts": ["text_postings", "text_postings_english"]}
#: Tables of every store.
ALWAYS = {"events", "event_keys", "key_blooms"}


def kept_tables(tables: Iterable[str] | None) -> set[str] | None:
    """The tables that a store of these derived tables keeps: with what they are made of. None: all."""
    if tables is None:
        return None
    known = {name for wave in WAVES for name in wave}
    if unknown := set(tables) - known:
        raise ValueError(f"unknown tables {sorted(unknown)}")
    out, todo = set(ALWAYS), list(tables)
    while todo:
        name = todo.pop()
        if name not in out:
            out.add(name)
            todo += NEEDS.get(name, [])
    return out


#: Order of the rows in a segment's files (after the partition column): what reads filter on.
SORTED = {"events": ["session_id", "timestamp"], "messages": ["timestamp"], "tool_uses": ["timestamp"], "text_postings": ["term", "uuid"],
          "text_postings_english": ["term", "uuid"], "term_counts": ["term"], "event_keys": ["uuid"], "key_blooms": ["block"], "session_parts": ["session_id"]}
#: Rows of these tables are dealt to files by ranges of their order, so that a lookup opens few files. A
#: frequent word's postings fall into several ranges, as the uuid belongs to the order.
RANGED = {"text_postings", "text_postings_english", "term_counts"}
#: Tables that follow row by row from a step's own segments: their rows stay in the files' parts
#: that they are read from, which are of a good size and hold a day's rows together already.
ROW_BY_ROW = {"messages", "tool_uses", "changes"}
#: Tables whose rows a step deals by ranges before it groups them.
GROUPED_IN_RANGES = {"text_postings", "text_postings_english"}


def table_schemas(spark: SparkSession) -> dict[str, StructType]:
    """Schema of every table of a store, as the step's own plan makes it."""
    app = spark.sparkContext.applicationId
    if app not in _SCHEMAS:
        lines = spark.createDataFrame([], "value string, source_file string, line_key struct<block:bigint,pos:bigint>")
        ev = _day(tr.to_events(tr.parse_lines(lines), host="").select(*EVENT_COLS))
        t = {"events": ev, "keyed": keys.with_key_columns(ev.select("uuid"), "uuid", 1, 0, 0)}
        for wave in WAVES:
            t |= {name: make(spark, t) for name, make in wave.items()}
        _SCHEMAS.clear()
        _SCHEMAS[app] = {name: df.schema for name, df in t.items() if name != "keyed"}
    return _SCHEMAS[app]


def _dealt(table: str, df: DataFrame, stay: bool = False) -> DataFrame:
    """Rows of a segment as they go to its files: files of a good size whatever came before
    (rebalanced, split where a day or bucket is large), sorted. ``stay``: as they are dealt."""
    from .store import PARTITIONS

    parts, order = [PARTITIONS[table]] if table in PARTITIONS else [], SORTED.get(table, [])
    if not stay:
        df = df.repartitionByRange(*order) if table in RANGED else df.hint("rebalance", *parts)
    return df.sortWithinPartitions(*parts, *order) if parts or order else df


FOLDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "tool_results": derive.fold_results,
    "session_parts": derive.fold_session_parts,
    "usage_parts": derive.fold_usage_parts,
    "term_counts": lambda df: df.groupBy("analyzer", "term").agg(F.sum("n_t").alias("n_t")),
    "text_totals": lambda df: df.agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len")),
    "key_blooms": keys.merged_blooms,
}


def open_snapshot(now: Snapshot, window: TimeWindow | None = None) -> dict[str, DataFrame]:
    """Every table of a snapshot, partial states folded; tables without segments are empty, those
    that the store doesn't keep are left out.
    ``window``: of events, messages and tool calls only the days of a time window are opened."""
    spark = now.spark
    schemas = table_schemas(spark)
    days = None
    if window is not None:
        first, last = window.start.date().isoformat(), window.end.date().isoformat()
        days = lambda d: first <= d <= last
    kept = set(now.keys.get("tables") or schemas)
    out = {n: now.read(n, s, days if n in ("events", "messages", "tool_uses") else None) for n, s in schemas.items() if n in kept}
    if "session_parts" in kept:
        sessions = derive.finish_sessions(derive.fold_session_parts(out.pop("session_parts")))
        if "usage_parts" in kept:
            out["usage_daily"] = derive.usage_from_parts(out.pop("usage_parts"), sessions)
        live = K.read_or_none(spark, _p(now.root, "liveness"))
        out["sessions"] = sessions if live is None else apply_liveness(sessions, live)
    if {"tool_uses", "tool_results"} <= kept:
        out["tool_calls"] = derive.paired(out.pop("tool_uses").drop("day"), derive.fold_results(out.pop("tool_results")))
    for served, stored in (("text_index", "text_postings"), ("text_index_english", "text_postings_english")):
        if stored in kept:
            out[served] = out.pop(stored)
    if "text_totals" in kept:
        out["corpus_stats"] = search.stats_from_totals(out.pop("text_totals"))
    return out | {n: out[n].drop("day") for n in ("events", "messages") if n in out}


def open_store(spark: SparkSession, root: str, window: TimeWindow | None = None) -> dict[str, DataFrame]:
    """The tables of a store's latest step. Sessions have the status of the store's liveness
    table (T5), where hooks have told one."""
    use_utc(spark)
    return open_snapshot(snapshot(spark, root), window)


def read_usage_daily(spark: SparkSession, root: str) -> DataFrame:
    return open_store(spark, root)["usage_daily"]


def known_uuids(now: Snapshot, keyed: DataFrame, schemas: dict[str, StructType]) -> DataFrame | None:
    """K1: the uuids of a batch (with key columns) that are stored, None if there are none. The
    filter blocks of the batch's buckets are read, and of the keys only buckets that the
    filter doesn't rule out."""
    if not now.segments.get("event_keys"):
        return None
    held = lambda df: {str(r[0]) for r in df.select("key_bucket").distinct().collect()}  # noqa: E731  (a number per bucket at most)
    filters = now.read("key_blooms", schemas["key_blooms"], held(keyed).__contains__)
    maybe = K.staged(keys.maybe_known(keyed, filters).select("uuid", "key_bucket"))
    buckets = held(maybe)
    if not buckets:
        return None
    stored = now.read("event_keys", schemas["event_keys"], buckets.__contains__)
    known = K.staged(maybe.select("uuid").join(stored.select("uuid"), "uuid", "left_semi"))
    return None if known.isEmpty() else known


def grow_keys(step: Step, schemas: dict[str, StructType], added: int) -> None:
    """Give the store another bucket for every BUCKET_KEYS keys beyond the buckets it has: the
    next buckets' keys and filters are written anew, each into two buckets, all of a round at
    once. A batch causes as many splits as its keys fill buckets, and one more to catch up."""
    k = step.keys
    k["n"] += added
    before = step.before
    splits = added // keys.BUCKET_KEYS + 1
    while splits:
        m = k["first"] << k["level"]
        lack = -(-k["n"] // keys.BUCKET_KEYS) - keys.count_of(k["first"], k["level"], k["split"])
        n = min(splits, lack, m - k["split"])
        if n <= 0:
            break
        splits -= n
        old = {str(b) for b in range(k["split"], k["split"] + n)}
        now = Snapshot(before.spark, before.root, before.step, step.segments, k)
        held = now.read("event_keys", schemas["event_keys"], old.__contains__)
        both = K.staged(keys.with_key_columns(held.select("uuid"), "uuid", k["first"], k["level"], k["split"] + n))
        for table, rows in (("event_keys", both.select("uuid", "key_bucket")), ("key_blooms", keys.blooms(both))):
            left = [type(s)(s.name, s.level, tuple(p for p in s.parts if p not in old)) for s in step.segments.get(table, [])]
            step.segments[table] = [s for s in left if s.parts]
            step.add(table, _dealt(table, rows))
        k["split"] += n
        if k["split"] == m:
            k["level"], k["split"] = k["level"] + 1, 0


def repeated_uuids(batch: DataFrame) -> DataFrame | None:
    """Uuids that a batch holds more than once, None if there are none."""
    again = K.staged(batch.groupBy("uuid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("uuid"))
    n = again.count()
    return (F.broadcast(again) if n <= FEW else again) if n else None


def ingest_lines(spark: SparkSession, lines: DataFrame, root: str, host: str | None = None, buckets: int = FIRST_BUCKETS,
                 tables: Iterable[str] | None = None) -> int:
    """One incremental step: parse, leave out events that are stored, derive, write, commit.
    Returns the number of new events. ``buckets``: key buckets a new store starts with at least (a
    store knows its own number). ``tables``: derived tables a new store keeps (all by default; a
    store knows its own)."""
    use_utc(spark)
    plain_variants(spark)
    ensure_checkpoint_dir(spark)
    schemas = table_schemas(spark)
    now = snapshot(spark, root)
    step = Step(now)
    kept = kept_tables(tables)
    if now.keys:
        held = set(now.keys.get("tables") or schemas)
        if tables is not None and not kept <= held:
            raise ValueError(f"the store doesn't keep {sorted(kept - held)}")
        kept = held
    # the lines are parsed once, into files; which of them are new is told from the uuids alone
    found = _day(tr.event_lines(tr.parse_lines(lines), host=host)).select(*BATCH_COLS)
    parsed = step.write(BATCH, found)
    if parsed is None:
        return 0
    batch = now.read(BATCH, found.schema, only=[parsed])
    k = step.keys = now.keys or {"first": max(buckets, -(-batch.count() // keys.BUCKET_KEYS)), "level": 0, "split": 0, "n": 0} | (
        {} if kept is None else {"tables": sorted(kept)})
    keyed = lambda df: keys.with_key_columns(df.select("uuid"), "uuid", k["first"], k["level"], k["split"])
    known = known_uuids(now, keyed(batch), schemas)
    rows = batch
    if known is not None:
        if batch.select("uuid").join(known, "uuid", "left_anti").isEmpty():
            step.discard(BATCH, parsed)
            return 0
        rows = rows.join(known, "uuid", "left_anti")
    again = repeated_uuids(batch)
    if again is not None:
        # The same uuid from two hosts/files keeps the smallest (host, file, line)
        first = K.first_per_key(rows.join(again, "uuid", "left_semi"), ["uuid"], ["host", "source_file", "line_key"])
        rows = rows.join(again, "uuid", "left_anti").unionByName(first)
    # dealt to files before the payloads' fields become columns, which are then not moved
    typed = tr.typed_events(rows.hint("rebalance", "day"), "day")
    events = step.write("events", _dealt("events", typed.select(*schemas["events"].names), stay=True))
    step.discard(BATCH, parsed)
    if events is None:
        return 0
    batch = now.read("events", schemas["events"], only=[events])
    step.segments.setdefault("events", []).append(events)
    t = {"events": batch, "keyed": keyed(batch)}
    for wave in WAVES:
        rows = {name: _dealt(name, make(spark, t).select(*schemas[name].names), stay=name in ROW_BY_ROW | GROUPED_IN_RANGES) for name, make in wave.items()
                if kept is None or name in kept}
        if rows:
            t |= {name: now.read(name, schemas[name], only=[s] if s else []) for name, s in step.add_all(rows).items()}
    n = batch.count()
    grow_keys(step, schemas, n)
    compact(step.commit(), schemas, {t: lambda df, t=t: _dealt(t, FOLDS.get(t, lambda x: x)(df).select(*schemas[t].names)) for t in schemas})
    return n


def backfill(spark: SparkSession, source_root: str, root: str, host: str = "local", buckets: int = FIRST_BUCKETS) -> int:
    """3.1: every transcript under ``source_root`` (sub-agents included), one step."""
    return ingest_lines(spark, tr.read_jsonl(spark, source_root), root, host=host, buckets=buckets)


def rebuild_sessions(spark: SparkSession, root: str) -> None:
    """K8: recompute every session's state from the stored events (no chunking: one shuffle)."""
    use_utc(spark)
    schemas = table_schemas(spark)
    now = snapshot(spark, root)
    events, msgs, uses = (now.read(t, schemas[t]) for t in ("events", "messages", "tool_uses"))
    step = Step(now)
    parts = derive.session_parts(events, msgs, uses, model_pricing(spark))
    level = max((s.level for s in now.segments.get("session_parts", [])), default=0)
    step.replace("session_parts", now.segments.get("session_parts", []), _dealt("session_parts", parts), level)
    step.commit()


def start_live_ingest(spark: SparkSession, landing_dir: str, root: str, checkpoint: str,
                      host: str | None = None, trigger: dict | None = None, tail: bool = True, buckets: int = FIRST_BUCKETS):
    """A stream over the transcripts below a folder; each micro-batch runs
    ``ingest_lines``. With ``tail`` files may grow: the stream's offsets are a byte per file
    (T3, K7; ``sources/tail.py``). Without it the file source reads each new file once, which
    suits folders where whole files are landed by many hosts. Seeing a line again is harmless
    (T4). ``trigger`` defaults to every second; pass ``{"availableNow": True}`` for a catch-up
    run."""
    if tail:
        lines = tail_lines(spark, landing_dir)
    else:
        lines = (
            spark.readStream.format("text")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.jsonl")
            .load(landing_dir)
            .select("value", F.col("_metadata.file_path").alias("source_file"),
                    F.col("_metadata.file_block_start").alias("offset"))
        )

    def step(batch: DataFrame, batch_id: int) -> None:
        # tailed lines are ordered by their byte; of landed files the batch is a static
        # DataFrame, whose rows can be numbered here
        pos = F.lit(0).cast("long") if tail else F.monotonically_increasing_id()
        b = batch.select("value", "source_file", F.struct(F.col("offset").alias("block"), pos.alias("pos")).alias("line_key"))
        ingest_lines(batch.sparkSession, b, root, host=host, buckets=buckets)

    w = lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"processingTime": "1 second"}))
    return w.start()


def start_liveness(spark: SparkSession, hooks_dir: str, out_path: str, checkpoint: str, trigger: dict | None = None):
    """T5: hook signals (JSON lines ``{session_id, hook, timestamp}``) -> latest status per
    session. With ``out_path`` the ``liveness`` folder of a store, its sessions show the
    status (``open_store``). A streaming aggregation in update mode; each batch upserts the changed
    sessions into a table partitioned by session bucket."""
    schema = "session_id string, hook string, timestamp timestamp"
    hooks = spark.readStream.schema(schema).json(hooks_dir)
    live = session_liveness_stream(hooks)

    def step(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        changed = K.with_bucket(batch, "session_id")
        old = K.read_or_none(s, out_path)
        if old is not None:
            tb = changed.select("bucket").distinct()
            keep = old.join(F.broadcast(tb), "bucket", "left_semi").join(changed.select("session_id"), "session_id", "left_anti")
            changed = K.staged(keep.unionByName(changed))
        K.overwrite_partitions(changed, out_path, ["bucket"])

    w = live.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "1 second"})).start()


def session_liveness_stream(hooks: DataFrame) -> DataFrame:
    """Streaming form of T5 (last write wins over statuses; other hooks ignored)."""
    return session_liveness(hooks)


def dedup_stream(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """T4, bounded-state variant: drop replayed uuids seen within the watermark."""
    return events.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["uuid"])


def ingest_side_files(spark: SparkSession, home: str, root: str, host: str = "local") -> dict[str, int]:
    """K6: prompt history, todos, file snapshots and shell snapshots, each inserted if
    absent on its natural key. Prompt history keys on (typed_at, md5(display),
    project_path), and a NULL project never conflicts."""
    from ..sources import sidefiles as sfl

    src = tr.enumerate_sources(home)
    added: dict[str, int] = {}

    def put(name, df, keys):
        stored = K.read_or_none(spark, _p(root, name))
        new = K.staged(K.insert_if_absent(stored, df, keys) if stored is not None else df)
        added[name] = new.count()
        if added[name]:
            K.append(new, _p(root, name))

    if src["history"]:
        h = sfl.dedup_history(sfl.parse_history(sfl.read_history_lines(spark, src["history"]), host=host))
        h = h.withColumn("display_md5", F.md5("display"))
        stored = K.read_or_none(spark, _p(root, "prompts_history"))
        keyed, nulls = h.filter(F.col("project_path").isNotNull()), h.filter(F.col("project_path").isNull())
        if stored is not None:
            keyed = keyed.join(stored.select("typed_at", "display_md5", "project_path"),
                               ["typed_at", "display_md5", "project_path"], "left_anti")
        new = K.staged(keyed.unionByName(nulls))
        added["prompts_history"] = new.count()
        if added["prompts_history"]:
            K.append(new, _p(root, "prompts_history"))
    if src["todos"]:
        put("todos", sfl.parse_todos(sfl.read_files(spark, src["todos"], "*.json"), host=host),
            ["session_id", "agent_id", "snapshot_at"])
    if src["file_history"]:
        put("file_snapshots", sfl.parse_file_history(sfl.read_files(spark, src["file_history"], recursive=True),
                                                     src["file_history"], host=host),
            ["session_id", "file_path", "version"])
    if src["shell_snapshots"]:
        put("shell_snapshots", sfl.parse_shell_snapshots(sfl.read_files(spark, src["shell_snapshots"], "*.sh"), host=host),
            ["id"])
    return added


def backfill_home(spark: SparkSession, home: str, root: str, host: str = "local", buckets: int = FIRST_BUCKETS) -> dict[str, int]:
    """3.1 end to end for one home directory (K9: one host per source root)."""
    src = tr.enumerate_sources(home)
    out = {"events": backfill(spark, src["transcripts"], root, host=host, buckets=buckets) if src["transcripts"] else 0}
    out.update(ingest_side_files(spark, home, root, host=host))
    return out


def usage_daily_stream(messages: DataFrame, sessions: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """D6 as a streaming aggregate: assistant messages (a stream) joined with a sessions
    snapshot (stream-static join), tumbling one-day event-time windows; the watermark
    bounds the state and finalises a day once late data can no longer arrive (append
    mode). Rows equal the batch D6 for days closed by the watermark."""
    m = messages.filter(F.col("role") == "assistant").withWatermark("timestamp", watermark)
    j = m.join(sessions.select("session_id", "project_path"), "session_id")
    g = j.groupBy(F.window("timestamp", "1 day").alias("w"), "host", "project_path", "model").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("output_tokens"),
        F.coalesce(F.sum("cache_creation_tokens"), F.lit(0)).cast("long").alias("cache_creation"),
        F.coalesce(F.sum("cache_read_tokens"), F.lit(0)).cast("long").alias("cache_read"),
    )
    return g.select(F.col("w.start").alias("day"), "host", "project_path", "model", "message_count",
                    "input_tokens", "output_tokens", "cache_creation", "cache_read")

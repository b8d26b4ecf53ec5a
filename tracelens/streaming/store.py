"""Segments and steps: what a table store holds at one moment.

Every table of a store is a set of *segments*, folders of Parquet files that are written
once (``<table>/seg=<name>``, inside it ``day=`` or ``key_bucket=`` folders where the table
has such a partition). A step writes segments and then one small file under ``_steps`` that
names all segments of all tables. That file is the commit: readers take the latest one, so
they see all of a step's writes or none, and what a failed step wrote is never looked at
(``vacuum`` deletes it). The file also lists the days or key buckets each segment holds; a
read of a time window or of some buckets opens these folders only.

Segments that many small steps left are merged (``compact``): as soon as FAN segments of a
table have one level, they become one of the next level. So a table of n steps has at most
FAN * log(n) segments, and a row is rewritten log(n) times. One writer at a time; any
number of readers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators import sinks as K

#: Segments of one level that are merged into one of the next.
FAN = 8
#: Partition columns of the tables that have one.
PARTITIONS = {"events": "day", "messages": "day", "tool_uses": "day", "event_keys": "key_bucket", "key_blooms": "key_bucket"}


@dataclass(frozen=True)
class Segment:
    name: str
    level: int = 0
    #: Values of the partition column whose rows count; empty for tables without one.
    parts: tuple[str, ...] = ()


@dataclass
class Snapshot:
    """The segments that one step left, read like tables."""

    spark: SparkSession
    root: str
    step: int = 0
    segments: dict[str, list[Segment]] = field(default_factory=dict)
    #: Linear hashing of the event keys: first bucket count, doublings, next bucket to split, keys;
    #: and ``tables``, the tables a store keeps where it doesn't keep all.
    keys: dict = field(default_factory=dict)

    def folders(self, table: str, parts: Callable[[str], bool] | None = None, only: list[Segment] | None = None) -> list[str]:
        column, out = PARTITIONS.get(table), []
        for s in self.segments.get(table, []) if only is None else only:
            base = f"{self.root}/{table}/seg={s.name}"
            out += [f"{base}/{column}={p}" for p in s.parts if parts is None or parts(p)] if column else [base]
        return out

    def read(self, table: str, schema: StructType, parts: Callable[[str], bool] | None = None, only: list[Segment] | None = None) -> DataFrame:
        """The table, or the folders of its partition values that ``parts`` accepts."""
        paths = self.folders(table, parts, only)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths).select(*schema.names)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _fs(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def _read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def snapshot(spark: SparkSession, root: str, step: int | None = None) -> Snapshot:
    """The latest step of a store (or an earlier one that is still there); empty without any."""
    root = root.rstrip("/")
    found = [n for n in _names(spark, f"{root}/_steps") if n.endswith(".json")]
    if step is not None:
        found = [n for n in found if int(n[:-5]) <= step]
    if not found:
        return Snapshot(spark, root)
    state = json.loads(_read_text(spark, f"{root}/_steps/{found[-1]}"))
    segments = {t: [Segment(s["name"], s["level"], tuple(s["parts"])) for s in found] for t, found in state["segments"].items()}
    return Snapshot(spark, root, state["step"], segments, state["keys"])


class Step:
    """Segments that become visible together, by ``commit``."""

    def __init__(self, before: Snapshot):
        self.before = before
        self.segments = {t: list(s) for t, s in before.segments.items()}
        self.keys = dict(before.keys)

    def write(self, table: str, df: DataFrame, level: int = 0) -> Segment | None:
        """A new segment of ``df``; None (and nothing kept) if it has no rows."""
        column = PARTITIONS.get(table)
        s = Segment(f"s{self.before.step + 1:09d}-{uuid.uuid4().hex[:8]}", level)
        path = f"{self.before.root}/{table}/seg={s.name}"
        K.append(df, path, [column] if column else None)
        spark = self.before.spark
        if column:
            parts = tuple(n.split("=", 1)[1] for n in _names(spark, path) if n.startswith(f"{column}="))
            return Segment(s.name, level, parts) if parts else None
        return s if any(n.startswith("part-") for n in _names(spark, path)) and not spark.read.schema(df.schema).parquet(path).isEmpty() else None

    def add_all(self, rows: dict[str, DataFrame]) -> dict[str, Segment | None]:
        """A new segment of each of these tables, written at the same time."""
        with ThreadPoolExecutor(len(rows)) as pool:
            jobs = {table: pool.submit(self.write, table, df) for table, df in rows.items()}
            out = {table: job.result() for table, job in jobs.items()}
        for table, s in out.items():
            if s is not None:
                self.segments.setdefault(table, []).append(s)
        return out

    def add(self, table: str, df: DataFrame) -> None:
        self.add_all({table: df})

    def discard(self, table: str, s: Segment) -> None:
        """Delete a segment that this step wrote and doesn't use."""
        p, fs = _fs(self.before.spark, f"{self.before.root}/{table}/seg={s.name}")
        fs.delete(p, True)

    def replace(self, table: str, old: list[Segment], df: DataFrame, level: int = 0) -> None:
        """One segment of ``df`` in place of others."""
        s = self.write(table, df, level)
        names = {o.name for o in old}
        kept = [x for x in self.segments.get(table, []) if x.name not in names]
        self.segments[table] = kept + ([s] if s is not None else [])

    def commit(self) -> Snapshot:
        b = self.before
        after = Snapshot(b.spark, b.root, b.step + 1, self.segments, self.keys)
        state = {"step": after.step, "segments": {t: [asdict(s) for s in found] for t, found in self.segments.items()}, "keys": self.keys}
        path, fs = _fs(b.spark, f"{b.root}/_steps/{after.step:012d}.json")
        if fs.exists(path):
            raise RuntimeError(f"another writer has committed step {after.step} of {b.root}")
        draft, _ = _fs(b.spark, f"{b.root}/_steps/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps(state).encode())
        out.close()
        if not fs.rename(draft, path):
            raise RuntimeError(f"step {after.step} of {b.root} could not be committed")
        return after


def compact(now: Snapshot, schemas: dict[str, StructType], fold: dict[str, Callable[[DataFrame], DataFrame]], fan: int | None = None) -> Snapshot:
    """Merge every FAN segments of one table and level. ``fold``: what merges rows of a table
    that holds partial results; rows of other tables stay as they are."""
    step, changed = Step(now), False
    for table, segments in now.segments.items():
        for level in sorted({s.level for s in segments}):
            group = [s for s in segments if s.level == level]
            if len(group) >= (fan or FAN) and table in schemas:
                rows = now.read(table, schemas[table], only=group)
                step.replace(table, group, fold.get(table, lambda df: df)(rows), level + 1)
                changed = True
    return step.commit() if changed else now


def vacuum(spark: SparkSession, root: str, keep: int = 8) -> int:
    """Delete the segments that none of the last ``keep`` steps names, and the older steps'
    files. For times when no step is being written. Returns the number of segments deleted."""
    root = root.rstrip("/")
    steps = [n for n in _names(spark, f"{root}/_steps") if n.endswith(".json")]
    if not steps:
        return 0
    live, tables = set(), {"batch"}  # lines that a failed step had parsed
    for n in steps[-keep:]:
        for table, found in json.loads(_read_text(spark, f"{root}/_steps/{n}"))["segments"].items():
            tables.add(table)
            live |= {(table, s["name"]) for s in found}
    gone = 0
    for table in sorted(tables):
        for n in _names(spark, f"{root}/{table}"):
            if n.startswith("seg=") and (table, n[4:]) not in live:
                p, fs = _fs(spark, f"{root}/{table}/{n}")
                gone += bool(fs.delete(p, True))
    for n in steps[:-keep]:
        p, fs = _fs(spark, f"{root}/_steps/{n}")
        fs.delete(p, False)
    return gone

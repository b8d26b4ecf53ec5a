"""Materialise the canonical tables once; serve queries from them.

This is the production shape (the reference's dashboards also read derived tables,
not raw transcripts): an ingest job writes the tables, every query reads them with
column pruning and pushed filters. Files are written sorted by the column the queries
filter on (``started_at``, ``timestamp``, ``day``), so Parquet min/max statistics let
the scan skip row groups outside a time window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import Catalog

TABLES = {
    # name: (sort columns, partition columns); written in this order, each later table
    # reads the stored earlier ones instead of recomputing them
    "sessions": (["started_at"], []),
    "events": (["session_id", "timestamp"], []),
    "messages": (["timestamp"], []),
    "tool_calls": (["timestamp"], []),
    "usage_daily": (["day"], []),
    "host_sync_state": ([], []),
    "text_index": (["term"], []),
    "text_index_english": (["term"], []),
    "corpus_stats": ([], []),
}


def materialize(cat: Catalog, root: str, files_per_table: int | None = None) -> dict[str, int]:
    """Write every canonical table of ``cat`` under ``root``; returns row counts.

    ``files_per_table``: output files per table (range-partitioned on the sort column,
    so each file covers one time range). Default: leave the partitioning to AQE."""
    counts = {}
    for name, (sort_cols, part_cols) in TABLES.items():
        df: DataFrame = getattr(cat, name)
        if sort_cols:
            if files_per_table:
                df = df.repartitionByRange(files_per_table, *sort_cols)
            elif sort_cols == ["term"]:  # a file holds a range of terms: a lookup opens one
                df = df.repartitionByRange("term")
            df = df.sortWithinPartitions(*sort_cols)
        w = df.write.mode("overwrite")
        if part_cols:
            w = w.partitionBy(*part_cols)
        w.parquet(f"{root.rstrip('/')}/{name}")
        stored = cat.spark.read.parquet(f"{root.rstrip('/')}/{name}")
        counts[name] = stored.count()
        if name in ("sessions", "messages"):
            cat._given[name] = stored
    return counts


class StoredTables(str):
    """A folder of tables that ``materialize`` wrote. Queries that get one in place of the
    driver tables' folder read the stored tables."""


def from_root(spark: SparkSession, root: str) -> Catalog:
    def opener(name):
        return lambda: spark.read.parquet(f"{root.rstrip('/')}/{name}")

    return Catalog.from_loaders(spark, **{name: opener(name) for name in TABLES})

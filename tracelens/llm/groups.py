"""Helpers of the training-data operators for groups of any size: running sums over a whole
table in a given order, and totals of groups brought back to the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import python_tasks, stored

#: A group with more than this part of all rows is hot; there are less than HOT of them.
HOT = 1000


def running_sums(df: DataFrame, order: list[Column], values: list[str]) -> DataFrame:
    """``df`` with ``before_<value>`` for each value column (long, not null): its sum over all
    rows that come earlier in ``order``. One range shuffle sorts the rows, every task adds up
    its own, and the tasks' totals (one row a task) are broadcast. Stored, so that ranges
    that were dealt once stay as they are."""
    python_tasks(df.sparkSession)
    inside = [f"_in_{v}" for v in values]
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    names, places = [*df.columns, "_part", *inside], [df.columns.index(v) for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), [0] * len(places)
        for batch in batches:
            sums = []
            for i, place in enumerate(places):
                x = batch.column(place).to_numpy(zero_copy_only=False)
                sums.append(pa.array(at[i] + np.cumsum(x) - x))
                at[i] += int(x.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, "int32")), *sums], names=names)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    placed = sorted_rows.mapInArrow(run, ", ".join([*kinds, "_part int", *(f"`{i}` long" for i in inside)]))
    placed = stored(df.sparkSession, placed, "running_sums")
    totals = placed.groupBy("_part").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    bases = totals.select("_part", *((F.sum(f"_t_{v}").over(Window.orderBy("_part")) - F.col(f"_t_{v}")).alias(f"_base_{v}") for v in values))
    out = placed.join(F.broadcast(bases), "_part")
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(f"_in_{v}") + F.col(f"_base_{v}")).alias(f"before_{v}") for v in values))


def with_totals(rows: DataFrame, totals: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the other columns of ``totals`` (one row per key, nulls a key of their
    own; ``count`` is the key's number of rows). The totals of hot keys, less than HOT rows,
    are broadcast, so that their rows stay where they are; the others meet in a shuffle."""
    n = totals.agg(F.sum(count)).scalar()
    named = totals.withColumnRenamed(key, "_key")
    hot = F.broadcast(named.where(F.col(count) * HOT > n))
    cold = named.where(F.col(count) * HOT <= n)
    same = F.col(key).eqNullSafe(F.col("_key"))
    near = rows.join(hot, same, "inner")
    far = rows.join(hot.select("_key"), same, "left_anti").join(cold, same, "inner")
    return near.unionByName(far).drop("_key")

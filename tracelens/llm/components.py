"""Connected components by alternating large-star and small-star steps (Kiveris et al.,
2014): every step joins each node's edges with the least of its neighbours, and ends when
all edges of a component point at its least node. A component of n nodes takes about
log(n) steps whatever its shape; no step gathers a component.

``joined_components`` lets tasks of up to PART edges join theirs first, by union-find; the
steps then only connect what several tasks found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Edges that a task joins by union-find (about 50 MB of Python objects).
PART = 200_000


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """edges (a, b) of comparable ids -> (id, component), component the least id reachable.
    Nodes without an edge to another node do not occur. Repeated and looping edges are fine."""
    spark = edges.sparkSession
    now = stored(spark, edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(limit):
        # large star: neighbours above a node move to its least neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(spark, both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stored(spark, large, "large")
        # small star: a node and its neighbours below it move to the least of them
        least = stored(spark, large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        small = stored(spark, small, "small")
        # done when every node points once, and nothing points on from where it points
        ends = small.select(F.col("u").alias("id"), F.lit(1).alias("out")).unionByName(small.select(F.col("v").alias("id"), F.lit(0).alias("out")))
        ends = ends.groupBy("id").agg(F.sum("out").alias("out"), F.min("out").alias("target"))
        now = small
        if ends.where("out > 1 or (out > 0 and target = 0)").isEmpty():
            break
    else:
        raise RuntimeError(f"no convergence in {limit} steps")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of one task -> every node with the least node its edges join it to."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.setdefault(i, i)) != i:
            root[i] = root[up]
            i = up
        return i

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(u), find(v)
            root[max(x, y)] = min(x, y)
    ids = np.fromiter(root, "int64", len(root))
    for i in range(0, len(ids), 1 << 16):
        some = ids[i : i + (1 << 16)].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], names=["id", "component"])


def joined_components(edges: DataFrame) -> DataFrame:
    """``components`` of edges (a, b) of 64-bit ids, stored."""
    spark = edges.sparkSession
    now = stored(spark, edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    tasks = -(-now.count() // PART)
    if tasks <= 1:
        return stored(spark, now.coalesce(1).mapInArrow(stars, "id long, component long"), "components")
    found = now.repartition(tasks, "u").mapInArrow(stars, "id long, component long")
    return stored(spark, components(found.select(F.col("id").alias("a"), F.col("component").alias("b"))), "components")

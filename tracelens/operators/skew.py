"""Window operators that stay distributed when one group is huge.

A plain ``lead().over(partitionBy(session))`` sends a whole session to one task. The
reference's data model allows a single session to hold a large share of all rows,
so LEAD is computed in two levels:

1. rows are cut into (group, time chunk) partitions and LEAD runs inside each chunk;
2. the last row of a chunk takes the first row of the group's next non-empty chunk,
   found by a LEAD over the per-chunk heads (one row per chunk, built by a
   partially-aggregated ``min``).

The result is exactly the global LEAD over (group, order, tie). Top-k per group needs
nothing special: ``row_number() <= k`` is planned by Spark as a WindowGroupLimit with a
partial (map-side) limit before the shuffle, so at most k rows per group and map task
cross the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunked_lead(
    df: DataFrame,
    group: str,
    ts: str,
    tie: str,
    cols: list[str],
    chunk_seconds: int = 60,
    prefix: str = "next_",
) -> DataFrame:
    """Add ``next_<c>`` for ``c`` in ``[ts, *cols]``: the value on the following row of
    the same ``group`` in (ts, tie) order, NULL on the group's last row.

    One window pass over (group, chunk); the chunk's successor head is joined on the
    same key (the window's partitioning), so the rows are not shuffled again."""
    chunk_us = int(chunk_seconds) * 1_000_000
    carry = [ts, *cols]
    d = df.withColumn("_chunk", F.expr(f"unix_micros(`{ts}`) div {chunk_us}"))
    w = Window.partitionBy(group, "_chunk").orderBy(ts, tie)
    x = d.select(
        "*",
        *[F.lead(c).over(w).alias(f"_in_{c}") for c in carry],
        F.lead(tie).over(w).isNull().alias("_last"),
    )
    heads = d.groupBy(group, "_chunk").agg(
        F.min(F.struct(F.col(ts).alias("_t"), F.col(tie).alias("_k"), *[F.col(c).alias(f"_v_{c}") for c in cols])).alias("_h")
    )
    nh = heads.select(
        group, "_chunk", F.lead("_h").over(Window.partitionBy(group).orderBy("_chunk")).alias("_nh")
    )
    j = x.join(nh, [group, "_chunk"], "left")
    nxt = {ts: F.col("_nh._t"), **{c: F.col(f"_nh._v_{c}") for c in cols}}
    return j.select(
        *[F.col(c) for c in df.columns],
        *[F.when(F.col("_last"), nxt[c]).otherwise(F.col(f"_in_{c}")).alias(prefix + c) for c in carry],
    )


def top_k_per_group(df: DataFrame, group: list[str] | str, order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Top-k rows per group (map-side limited by Spark's WindowGroupLimit)."""
    g = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*g).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)

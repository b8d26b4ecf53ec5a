"""Exact continuous percentiles (``percentile_cont``) without gathering a group.

Spark's exact ``percentile`` merges a value->count map of the whole group into one
buffer, which cannot hold a group the size of a third of the data. This operator counts
equal values first and ranks the distinct ones, the same way at every size and with
deterministic keys only (so recomputation after an executor loss gives the same answer):

1. rows per (group, value): combined map-side, so ties cost nothing after it;
2. per group, ``pieces - 1`` split points over its distinct values from
   ``percentile_approx`` (a bounded sketch; the split points only balance the work,
   exactness does not depend on them); a value's piece = number of split points below it;
3. rows per (group, piece): at most groups x pieces rows, kept as an array per group, whose
   running sums tell the pieces that hold a wanted rank: two per percentile at most;
4. selection: only those pieces' values are ranked (a window bounded by a piece); all other
   values are dropped before any sort;
5. the two ranks each percentile needs fall on a value's run of ranks; interpolate:
   v_lo + (v_hi - v_lo) * (pos - floor(pos)), pos = p * (n - 1).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile_cont(df: DataFrame, group: list[str], value: str, probs: dict[str, float],
                    pieces: int = 64, accuracy: int = 10000) -> DataFrame:
    """One row per group with a column per named probability (NULL values ignored)."""
    g = list(group)
    v = df.select(*g, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    counted = v.groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_c"))
    splits = [i / pieces for i in range(1, pieces)]
    stats = counted.groupBy(*g).agg(
        F.sum("_c").alias("_n"), F.array_distinct(F.percentile_approx("_v", splits, accuracy)).alias("_bounds"))
    if g:
        both = counted.join(stats, g)
    else:  # one global group: a scalar subquery, not a join
        one = stats.select(F.struct("_n", "_bounds").alias("s")).scalar()
        both = counted.select("_v", "_c", one["_n"].alias("_n"), one["_bounds"].alias("_bounds"))
    both = both.withColumn("_piece", F.size(F.filter("_bounds", lambda b: b < F.col("_v")))).drop("_bounds")

    # rows before each piece of a group, as a map of the pieces that hold a wanted rank
    sizes = both.groupBy(*g, "_piece").agg(F.sum("_c").alias("_s"), F.max("_n").alias("_n"))
    before = Window.partitionBy(*g).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    ranks = [f(F.lit(float(p)) * (F.col("_n") - 1)) for p in probs.values() for f in (F.floor, F.ceil)]
    wanted = offsets.filter(reduce(or_, [(F.col("_off") <= r) & (r < F.col("_off") + F.col("_s")) for r in ranks]))
    if g:
        # at most 2 * len(probs) rows a group; AQE broadcasts them where they are few
        chosen = both.join(wanted.select(*g, "_piece", "_off"), [*g, "_piece"])
    else:
        held = wanted.agg(F.map_from_entries(F.collect_list(F.struct("_piece", "_off")))).scalar()
        chosen = both.withColumn("_off", F.element_at(held, F.col("_piece"))).filter(F.col("_off").isNotNull())
    inside = Window.partitionBy(*g, "_piece").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = chosen.withColumn("_first", F.col("_off") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_first") + F.col("_c")), F.col("_v")))

    ends, out = [], []
    for i, (name, p) in enumerate(probs.items()):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        ends += [at(F.floor(pos)).alias(f"_lo{i}"), at(F.ceil(pos)).alias(f"_hi{i}")]
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (pos - F.floor(pos))).alias(name))
    return ranked.groupBy(*g).agg(F.max("_n").alias("_n"), *ends).select(*g, *out)

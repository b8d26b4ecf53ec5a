"""Which uuids of a batch a store already has, at a cost that follows the batch.

The uuids lie in hash buckets whose number grows by linear hashing: with ``m = first << level``
buckets of which the first ``split`` are split already, a key's bucket is ``h mod m``, or
``h mod 2m`` where that bucket is split. Growing by one bucket rewrites one bucket and leaves
all others as they are.

Beside the keys every segment has a blocked Bloom filter as a table: a key belongs to one 64-bit
block and sets BITS bits of it. A batch is joined with the blocks of its buckets first; only
keys that the filter does not rule out are looked up, in their buckets alone. The filter
takes an eighth of the keys' size or less, and passes about one new key in 250.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys per bucket from which on the store gets another bucket.
BUCKET_KEYS = 1_000_000
#: Filter blocks of a bucket: 16 bits per key of a full bucket.
BLOCKS = BUCKET_KEYS // 4
BITS = 4


def bucket_sql(h: str, first: int, level: int, split: int) -> str:
    m = first << level
    return f"cast(case when pmod({h}, {m}L) < {split} then pmod({h}, {2 * m}L) else pmod({h}, {m}L) end as int)"


def count_of(first: int, level: int, split: int) -> int:
    return (first << level) + split


def with_key_columns(df: DataFrame, key: str, first: int, level: int, split: int) -> DataFrame:
    """``key_bucket``, and the key's filter ``block`` with the bits it sets there (``mask``), which
    come from a second hash."""
    g = "xxhash64(_h, 1)"
    mask = " | ".join(f"shiftleft(1L, cast(pmod(shiftrightunsigned({g}, {6 * i}), 64) as int))" for i in range(BITS))
    return df.withColumn("_h", F.xxhash64(key)).selectExpr(
        *(f"`{c}`" for c in df.columns), f"{bucket_sql('_h', first, level, split)} as key_bucket",
        f"cast(pmod(shiftrightunsigned({g}, 24), {BLOCKS}) as int) as block", f"{mask} as mask")


def blooms(keys: DataFrame) -> DataFrame:
    """Filter rows (key_bucket, block, bits) of keys with their key columns."""
    return keys.groupBy("key_bucket", "block").agg(F.bit_or("mask").alias("bits"))


def merged_blooms(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key_bucket", "block").agg(F.bit_or("bits").alias("bits"))


def maybe_known(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """Rows of ``batch`` that the filters don't rule out."""
    f = filters.select(F.col("key_bucket").alias("_b"), F.col("block").alias("_k"), "bits")
    hit = (F.col("key_bucket") == F.col("_b")) & (F.col("block") == F.col("_k")) & (F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return batch.join(f, hit, "left_semi")

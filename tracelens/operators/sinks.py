"""K1-K9: write semantics of the canonical tables, on plain Parquet.

Plain Parquet has no MERGE, so "insert if absent" is a ``left_anti`` join against the
stored keys followed by an append, and "upsert" is a recompute of the touched keys
written with dynamic partition overwrite. Derived tables are partitioned by a stable
hash bucket of their key (``bucket``) or by day, so a touched key rewrites one
partition, not the table. A table is never overwritten by a plan that still reads it:
such results are materialised first with ``checkpoint()`` (in the session's shared
checkpoint folder).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir

DEFAULT_BUCKETS = 64


def bucket_of(key: str | Column, buckets: int = DEFAULT_BUCKETS) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(k), F.lit(buckets)).cast("int")


def first_per_key(batch: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key, the first in ``order`` (deterministic ``dropDuplicates``).
    A partially aggregated ``min_by``, so a hot key combines map-side."""
    cols = [c for c in batch.columns if c not in keys]
    ordered = [F.col(o) if isinstance(o, str) else o for o in order]
    key = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(ordered)])
    # min_by orders on the key only, so the carried row may hold VARIANT columns
    return batch.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), key).alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def insert_if_absent(existing: DataFrame | None, batch: DataFrame, keys: list[str],
                     order: list[str | Column] | None = None) -> DataFrame:
    """Rows of ``batch`` whose key is not stored yet, deduplicated inside
    the batch (first by ``order``). The caller appends the result; its count is the
    number of inserted rows."""
    b = first_per_key(batch, keys, order) if order else batch.dropDuplicates(keys)
    if existing is None:
        return b
    return b.join(existing.select(*keys), keys, "left_anti")


def stamp_host(df: DataFrame, host: str = "local") -> DataFrame:
    """K9: provenance column, set once per source root."""
    return df.withColumn("host", F.lit(host))


def merge_session_status(recomputed: DataFrame, existing: DataFrame | None) -> DataFrame:
    """K3: every column of a touched session is replaced except an existing 'active'."""
    if existing is None:
        return recomputed
    old = existing.select("session_id", F.col("status").alias("_old"))
    return recomputed.join(old, "session_id", "left").withColumn(
        "status", F.when(F.col("_old") == "active", "active").otherwise(F.col("status"))
    ).drop("_old")


def with_bucket(df: DataFrame, key: str, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    return df.withColumn("bucket", bucket_of(key, buckets))


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions present in ``df`` (dynamic partition overwrite)."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store Spark reads it from."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None where none was ever written. A table that is there but
    can't be read is an error, not a missing one."""
    return spark.read.parquet(path) if path_exists(spark, path) else None


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stored table by its known schema: empty if it was never written or has no rows."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def staged(df: DataFrame) -> DataFrame:
    """Materialise ``df`` (reliable checkpoint) so its inputs may be overwritten."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

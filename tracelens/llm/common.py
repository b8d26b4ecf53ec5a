"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Arrow batches that go to Python hold at most this many bytes, whatever the row count:
#: very long texts then come a few at a time.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_tasks(spark: SparkSession) -> None:
    """Bound what a Python task holds at once (batches by bytes, not only by rows), and let
    executors import this package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


_kept: tuple[dict, ...] = ()


def keep_only(*tables: dict) -> None:
    """Called by a Python task that fills ``tables``: those that an earlier stage's operator
    filled in this worker are emptied, so a worker holds one operator's at a time."""
    global _kept
    left = [t for t in _kept if not any(t is u for u in tables)]
    _kept = tables
    if any(left):
        for t in left:
            t.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where it is unset, as
    in tests on one machine, a scratch folder is made; a cluster without it is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage is cut
    there, and a lost executor costs only its own tasks."""
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(spark: SparkSession, df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``stored``, in buckets of ``key``: joins on it later read the table in place
    instead of shuffling it."""
    name = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/llm/{name}").bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, of: int, per_class: int,
                    text: str = "text", key: str = "doc_id") -> DataFrame:
    """Training rows (key, t, y): outside the held-out fold, at most ``per_class`` of each
    class, the ones with the smallest key hash. A key labelled twice counts with its
    largest label; null keys, labels and unknown documents are left out."""
    known = (
        labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
        .where(f"k is not null and y in (0, 1) and crc32(cast(k as string)) % {of} != {fold}")
        .groupBy("k").agg(F.max("y").alias("y"))
    )
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * per_class rows at most
    return docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(sample, "k")


def held_out(key: str, fold: int, of: int):
    """Whether a row belongs to the held-out fold; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % of == fold


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

"""Spark session helpers.

Library code never creates a session on its own; callers pass one in. ``build_session``
is for tests, the bench and local use. ``use_utc`` pins the session zone, which every
plan relies on for day buckets and epoch arithmetic.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(
    app: str = "tracelens",
    master: str | None = None,
    shuffle_partitions: int = 8,
) -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    spark = (
        SparkSession.builder.appName(app)
        .master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def use_utc(spark: SparkSession) -> None:
    """Day buckets, ``date_format`` and epoch maths are defined in UTC."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def plain_variants(spark: SparkSession) -> None:
    """VARIANT columns are written to Parquet as they are. By default Spark infers columns for
    the fields of each file's values, which takes more time than parsing the lines did, and
    puts the values together again wherever they are read."""
    if spark.conf.get("spark.sql.variant.inferShreddingSchema", None) != "false":
        spark.conf.set("spark.sql.variant.inferShreddingSchema", "false")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster that setting names shared storage and is used as is; without it there is
    no folder all executors see, which is an error. Only a local session gets a scratch
    folder of its own."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tracelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tracelens`` importable on executors (``--py-files`` at runtime).

    Needed only by the Python UDFs (stemming, deep redaction); done once per context."""
    import shutil

    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    import tracelens

    pkg = os.path.dirname(os.path.abspath(tracelens.__file__))
    base = tempfile.mkdtemp(prefix="tracelens-pyfiles-")
    archive = shutil.make_archive(os.path.join(base, "tracelens"), "zip", root_dir=os.path.dirname(pkg),
                                  base_dir="tracelens")
    sc.addPyFile(archive)
    _SHIPPED.add(id(sc))

"""The model price dimension.

Nine rows, five price tiers, one effective date. It is a literal, bounded table, so
joins against it are broadcast by hint (its size is fixed, not data dependent).
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EFFECTIVE_FROM = _dt.datetime(2026, 1, 1)

# USD per million tokens, as published for the reference's seed data.
# (model, input, output, cache write 5 min, cache write 1 h, cache read)
PRICES = [
    ("claude-opus-4-7", "15", "75", "18.75", "30", "1.5"),
    ("claude-opus-4-7[1m]", "15", "75", "18.75", "30", "1.5"),
    ("claude-opus-4-6", "15", "75", "18.75", "30", "1.5"),
    ("claude-opus-4-5", "15", "75", "18.75", "30", "1.5"),
    ("claude-sonnet-4-6", "3", "15", "3.75", "6", "0.3"),
    ("claude-sonnet-4-5", "3", "15", "3.75", "6", "0.3"),
    ("claude-sonnet-4-0", "3", "15", "3.75", "6", "0.3"),
    ("claude-haiku-4-5", "1", "5", "1.25", "2", "0.1"),
    ("claude-haiku-4-5-20251001", "1", "5", "1.25", "2", "0.1"),
]

PRICE_COLS = [
    "input_per_mtok",
    "output_per_mtok",
    "cache_write_5m_per_mtok",
    "cache_write_1h_per_mtok",
    "cache_read_per_mtok",
]

PRICING_SCHEMA = T.StructType(
    [T.StructField("model", T.StringType(), False)]
    + [T.StructField(c, T.DecimalType(10, 4), True) for c in PRICE_COLS]
    + [T.StructField("effective_from", T.TimestampNTZType(), True)]
)


def model_pricing(spark: SparkSession, rows=PRICES) -> DataFrame:
    """The price table, with integer cent columns (``*_c``: US cents per Mtok).

    Cost maths multiplies integer token counts by integer cents, so sums are exact
    and order independent (1 unit = 1e-8 USD).
    """
    data = [
        (r[0], *[Decimal(v) for v in r[1:]], EFFECTIVE_FROM)
        for r in rows
    ]
    df = spark.createDataFrame(data, PRICING_SCHEMA)
    for c in PRICE_COLS:
        df = df.withColumn(c[: -len("_per_mtok")] + "_c", (F.col(c) * 100).cast("long"))
    return df


def upsert_pricing(current: DataFrame, updates: DataFrame) -> DataFrame:
    """K4: upsert by model; the update row wins over the current one."""
    both = current.withColumn("_rank", F.lit(1)).unionByName(updates.withColumn("_rank", F.lit(0)))
    w = Window.partitionBy("model").orderBy("_rank")
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_rank")

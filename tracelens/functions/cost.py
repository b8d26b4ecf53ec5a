"""Token cost as Column expressions.

Prices are integer US cents per million tokens, tokens are integers, so one cost
"unit" is 1e-8 USD and every sum is an exact BIGINT. A NULL token count makes the
message's cost NULL (SUM then skips the whole message), and a model without a price
gives NULL, i.e. cost 0 after ``coalesce`` -- both as in the reference's SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS_PER_USD = 100_000_000  # 1 unit = 1e-8 USD


def cost_units(
    input_tokens="input_tokens",
    output_tokens="output_tokens",
    cache_creation="cache_creation_tokens",
    cache_read="cache_read_tokens",
) -> Column:
    """Cost of one row in 1e-8 USD; cache writes priced at the 5-minute tier."""

    def c(x):
        return F.col(x) if isinstance(x, str) else x

    return (
        c(input_tokens).cast("long") * F.col("input_c")
        + c(output_tokens).cast("long") * F.col("output_c")
        + c(cache_creation).cast("long") * F.col("cache_write_5m_c")
        + c(cache_read).cast("long") * F.col("cache_read_c")
    )


def units_to_usd(units: Column) -> Column:
    """Exact units -> USD as DOUBLE (one correctly rounded division)."""
    return units.cast("double") / F.lit(float(UNITS_PER_USD))


def units_to_e4(units: Column) -> Column:
    """Round to 1e-4 USD, half away from zero, like ``numeric(10,4)``; BIGINT result."""
    x = units + F.lit(5000)
    return ((x - F.pmod(x, F.lit(10000))) / F.lit(10000)).cast("long")


def units_to_e2(units: Column) -> Column:
    """Round to cents, like ``numeric(10,2)``; BIGINT result."""
    x = units + F.lit(500000)
    return ((x - F.pmod(x, F.lit(1000000))) / F.lit(1000000)).cast("long")


def token_cost(
    input_tokens: Column,
    output_tokens: Column,
    cache_write_5m: Column,
    cache_write_1h: Column,
    cache_read: Column,
    input_per_mtok: Column,
    output_per_mtok: Column,
    write_5m_per_mtok: Column,
    write_1h_per_mtok: Column,
    read_per_mtok: Column,
) -> Column:
    """Five-tier cost in USD (1-hour cache writes priced separately)."""
    m = F.lit(1_000_000.0)
    return (
        input_tokens / m * input_per_mtok
        + output_tokens / m * output_per_mtok
        + cache_write_5m / m * write_5m_per_mtok
        + cache_write_1h / m * write_1h_per_mtok
        + cache_read / m * read_per_mtok
    )

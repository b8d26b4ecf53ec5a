"""Q6 and display helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def delta_pct(curr: Column, prior: Column, digits: int = 6) -> Column:
    """Relative change; NULL (undefined) when the prior value is 0 or NULL."""
    return F.round(F.when(prior != 0, (curr - prior) / prior), digits)


def delta_pp(curr: Column, prior: Column) -> Column:
    """Change in percentage points, rounded half towards +inf."""
    return F.floor((curr - prior) * 100 + F.lit(0.5)).cast("long")


def model_family(model: Column) -> Column:
    return (
        F.when(model.contains("opus"), "Opus")
        .when(model.contains("sonnet"), "Sonnet")
        .when(model.contains("haiku"), "Haiku")
        .otherwise(model)
    )


def short_model(model: Column) -> Column:
    """Short label: without the vendor prefix and the last number (a date or minor version)."""
    return F.regexp_replace(F.regexp_replace(model, r"^claude-", ""), r"-\d+$", "")


def humanize_tokens(n: Column) -> Column:
    """Negative numbers read as 0; 1234 -> '1.2K', 5600000 -> '5.6M', 7e9 -> '7.0B'."""
    x = n.cast("double")
    return (
        F.when(x >= 1e9, F.format_string("%.1fB", x / 1e9))
        .when(x >= 1e6, F.format_string("%.1fM", x / 1e6))
        .when(x >= 1e3, F.format_string("%.1fK", x / 1e3))
        .when(x < 0, F.lit("0"))
        .otherwise(n.cast("string"))
    )


def shorten_home(path: Column) -> Column:
    """``/Users/<anyone>/x`` -> ``~/x``; NULL -> ``(none)``."""
    return F.coalesce(F.regexp_replace(path, r"^/Users/[^/]+/", "~/"), F.lit("(none)"))


def squeeze_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))

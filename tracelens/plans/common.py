"""Shared predicate builders (P1-P7, P11, P12) and output conventions."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import TimeWindow


def ts_lit(d: dt.datetime) -> Column:
    return F.lit(d.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def day_lit(d: dt.date) -> Column:
    return F.lit(d.isoformat()).cast("date")


def in_window(col: str, w: TimeWindow) -> Column:
    """Inclusive ``start <= col <= end``."""
    return F.col(col).between(ts_lit(w.start), ts_lit(w.end))


def day_in(col: str, start: dt.date, end: dt.date) -> Column:
    """Day-granular inclusive window."""
    return F.to_date(F.col(col)).between(day_lit(start), day_lit(end))


def in_list(col: str, values) -> Column | None:
    """Membership; no filter at all when the list is None or empty."""
    if not values:
        return None
    return F.col(col).isin(list(values))


def all_of(*conds: Column | None) -> Column:
    """AND of the predicates that are present."""
    present = [c for c in conds if c is not None]
    return reduce(lambda a, b: a & b, present, F.lit(True))


def where(df: DataFrame, *conds: Column | None) -> DataFrame:
    present = [c for c in conds if c is not None]
    return df.filter(reduce(lambda a, b: a & b, present)) if present else df


def ntz(col: str | Column) -> Column:
    """Timestamps leave the engine as naive UTC (TIMESTAMP_NTZ), independent of the
    client's zone."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("timestamp_ntz")


def ratio(num: Column, den: Column, digits: int = 6) -> Column:
    """Ratio with zero guard, rounded."""
    return F.round(F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0)), digits)


def day_str(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "yyyy-MM-dd")


def parse_hosts(param: str | list[str] | None, cookie: str | None = None) -> list[str] | None:
    """Host filter from a request parameter (first value wins) or a cookie;
    comma separated; empty means no filter (None)."""
    if isinstance(param, list):
        param = param[0] if param else None
    raw = (param if param is not None else (cookie or "")).strip()
    if not raw:
        return None
    return [h.strip() for h in raw.split(",") if h.strip()] or None

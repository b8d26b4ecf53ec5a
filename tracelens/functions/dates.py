"""Time-window expressions, resolved on the driver into two bounds.

These are parameters, not data: the result is a pair of datetimes that plans turn
into ``between`` predicates (pushed into the Parquet scan).
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

# Labels of the named windows and the default window expression.
RELATIVE_LABELS = {
    "today": "Today",
    "1d": "Last 24h",
    "7d": "Last 7d",
    "30d": "Last 30d",
    "90d": "Last 90d",
    "all": "All time",
}
DEFAULT_EXPR = "7d"


@dataclass(frozen=True)
class TimeWindow:
    start: dt.datetime
    end: dt.datetime
    label: str = ""

    def prior(self) -> "TimeWindow":
        """The period of equal length that ends where this one starts."""
        length = self.end - self.start
        return TimeWindow(self.start - length, self.start, "prior")

    @property
    def start_day(self) -> dt.date:
        return self.start.date()

    @property
    def end_day(self) -> dt.date:
        return self.end.date()


EPOCH = dt.datetime(1970, 1, 1)
_SPAN = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def _ago(now: dt.datetime, n: int, unit: str) -> dt.datetime:
    if unit in _SPAN:
        return now - dt.timedelta(**{_SPAN[unit]: n})
    leap_day = (now.month, now.day) == (2, 29)  # calendar years; Feb 29 falls back to Feb 28
    return now.replace(year=now.year - n, day=28 if leap_day else now.day)


def _moment(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)


def _days(first: str, last: str) -> TimeWindow:
    end = _moment(last) + dt.timedelta(days=1, milliseconds=-1)
    return TimeWindow(_moment(first), end, f"{first} → {last}")


def _label(expr: str, otherwise: str) -> str:
    return RELATIVE_LABELS.get(expr, otherwise)


# Every form of a window: its pattern, and the window it means at a moment. The first
# pattern that matches the whole expression decides.
FORMS: dict[str, tuple[str, Callable[[re.Match, dt.datetime], TimeWindow]]] = {
    "everything": (r"all", lambda m, now: TimeWindow(EPOCH, now, _label("all", ""))),
    "today": (r"today", lambda m, now: TimeWindow(now.replace(hour=0, minute=0, second=0, microsecond=0), now, _label("today", ""))),
    "ago": (r"(\d+)([mhdwy])", lambda m, now: TimeWindow(_ago(now, int(m[1]), m[2]), now, _label(m[0], f"Last {m[0]}"))),
    "days": (r"(\d{4}-\d\d-\d\d)\.\.(\d{4}-\d\d-\d\d)", lambda m, now: _days(m[1], m[2])),
    "moment": (r"\d{4}-\d\d.*", lambda m, now: TimeWindow(_moment(m[0]), now, _label(DEFAULT_EXPR, ""))),
}


def window_of(expr: str, now: dt.datetime, forms: Iterable[str] = tuple(FORMS)) -> TimeWindow | None:
    """The window an expression means, read by ``forms`` only; None if it has none of them."""
    for pattern, meaning in (FORMS[f] for f in forms):
        if m := re.fullmatch(pattern, expr):
            try:
                return meaning(m, now)
            except ValueError:  # the shape of a date, but no date
                return None
    return None


def resolve_window(expr: str | None, now: dt.datetime) -> TimeWindow:
    """Window expression -> (start, end, label); no or bad input means the default."""
    return window_of(DEFAULT_EXPR if expr is None else expr, now) or window_of(DEFAULT_EXPR, now)


def parse_since_strict(expr: str, now: dt.datetime) -> dt.datetime:
    """CLI form: relative or ISO, anything else is an error (N27: the window is required)."""
    w = window_of(expr or "", now, ("ago", "moment"))
    if w is None:
        raise ValueError(f"invalid --since value: {expr}")
    return w.start

"""Table schemas and options of the usage engine."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, timedelta
from zoneinfo import ZoneInfo

COUNTERS = ("input", "cached_input", "output", "reasoning_output", "total")
USAGE = "struct<" + ",".join(f"{c}:bigint" for c in COUNTERS) + ">"
#: One row for each log record that can matter, in file order within a session.
RECORDS = f"session_id string, seq bigint, ts timestamp, kind string, model string, last {USAGE}, cumulative {USAGE}, message {USAGE}, is_spawned boolean, is_boundary boolean, fork_ts timestamp"
EVENTS = "session_id string, seq bigint, ts timestamp, model string, is_fallback boolean, " + ", ".join(f"{c} bigint" for c in COUNTERS)
PRICING = "model string, input_cost_per_mtoken double, cached_input_cost_per_mtoken double, output_cost_per_mtoken double"
DEFAULT_MODEL = "gpt-5"


def filter_date(text: str) -> date:
    """A date argument, YYYYMMDD or YYYY-MM-DD."""
    digits = text.strip().replace("-", "")
    if not re.fullmatch(r"\d{8}", digits):
        raise ValueError(f"invalid date {text!r}")
    return date(int(digits[:4]), int(digits[4:6]), int(digits[6:]))


@dataclass(frozen=True)
class ReportOptions:
    """What a report covers and how it shows cached input.

    exclude_cached takes cached input out of input and total tokens, and implies that cached input is free.
    """

    since: str | None = None
    until: str | None = None
    last_days: int | None = None
    timezone: str = "UTC"
    free_cached: bool = False
    exclude_cached: bool = False
    roots: tuple[str, ...] = field(default_factory=tuple)
    project: str | None = None
    strict: bool = False

    def __post_init__(self):
        ZoneInfo(self.timezone)
        if self.last_days is not None and (self.since or self.until):
            raise ValueError("last_days excludes since and until")
        if self.last_days is not None and self.last_days < 1:
            raise ValueError("last_days must be positive")
        since, until = (filter_date(x) if x else None for x in (self.since, self.until))
        if since and until and since > until:
            raise ValueError("since is after until")

    @property
    def cached_is_free(self) -> bool:
        return self.free_cached or self.exclude_cached

    def bounds(self, today: date | None = None) -> tuple[date | None, date | None]:
        """First and last local day, both included."""
        if self.last_days is not None:
            if today is None:
                raise ValueError("last_days needs today")
            return today - timedelta(days=self.last_days - 1), today
        return tuple(filter_date(x) if x else None for x in (self.since, self.until))

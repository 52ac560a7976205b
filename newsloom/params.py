"""Run parameters and their driver-side parsing (a handful of scalars per run)."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone

from newsloom.errors import UsageError
from newsloom.schemas import CONTENT_FORMATS

# Defaults of the bounded single-feed report.
DEFAULT_ITEM_CAP = 25
DEFAULT_TOKEN_BUDGET = 10_000

# Duration units in seconds.
DURATION_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}

POLICIES = ("revalidate", "max_age", "cache_first", "no_cache")


def parse_duration(text: str) -> timedelta:
    """``30s``, ``15m``, ``2h``, ``7d`` or ``1w``; anything else is a usage error."""
    match = re.fullmatch(r"([0-9]+)([smhdw])", text.strip())
    if match is None:
        raise UsageError(f"invalid duration '{text.strip()}'")
    try:
        return timedelta(seconds=int(match[1]) * DURATION_UNITS[match[2]])
    except OverflowError as err:
        raise UsageError(f"duration too large: '{text.strip()}'") from err


def parse_since(text: str, as_of: datetime) -> datetime:
    """A duration back from ``as_of``, an RFC 3339 instant, or a bare date (midnight UTC)."""
    value = text.strip()
    try:
        return as_of - parse_duration(value)
    except UsageError:
        pass
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        value_iso = value + "T00:00:00+00:00"
    elif re.fullmatch(r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})", value):
        value_iso = value.upper().replace("Z", "+00:00")
    else:
        raise UsageError(f"invalid since value '{value}' (use e.g. '2h', '7d', or '2026-06-01')")
    try:
        return datetime.fromisoformat(value_iso).astimezone(timezone.utc)
    except ValueError as err:
        raise UsageError(f"invalid since value '{value}'") from err


@dataclass(frozen=True)
class FeedParams:
    """What to keep of each feed and how to render its bodies."""

    content_format: str = "markdown"
    limit: int | None = None
    max_content_chars: int | None = None
    since: datetime | None = None

    def __post_init__(self) -> None:
        if self.content_format not in CONTENT_FORMATS:
            raise UsageError(
                f"invalid content_format '{self.content_format}' (expected {'|'.join(CONTENT_FORMATS)})"
            )
        for name in ("limit", "max_content_chars"):
            value = getattr(self, name)
            if value is not None and value < 0:
                raise UsageError(f"{name} must not be negative")

    def with_(self, **changes) -> "FeedParams":
        return replace(self, **changes)

"""Dates, durations and header times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom.functions.base import ColumnOrName, bind, col, replace_all, trim_space
from newsloom.params import DURATION_UNITS

# Month abbreviations in order, and the named zones of mail dates with their offsets.
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
ZONE_OFFSETS = {
    "GMT": "+00:00",
    "UT": "+00:00",
    "UTC": "+00:00",
    "Z": "+00:00",
    "EST": "-05:00",
    "EDT": "-04:00",
    "CST": "-06:00",
    "CDT": "-05:00",
    "MST": "-07:00",
    "MDT": "-06:00",
    "PST": "-08:00",
    "PDT": "-07:00",
}

_MAIL_DATE = (
    r"(?i)^(?:[a-z]+\.?,?\s+|[a-z]+,)?(\d{1,2})\s+([a-z]{3})[a-z]*\.?\s+(\d{4}|\d{2})\s+"
    r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([+-]\d{2}:?\d{2}|[a-z]+)?\s*(?:\([^()]*\))?\s*\z"
)
_ISO_DATE = r"^\d{4}-\d{2}-\d{2}(?:[Tt ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:[Zz]|[+-]\d{2}:?\d{2})?)?\z"


def _mail_date(trimmed: Column) -> Column:
    def build(p: Column, place: Column) -> Column:
        year = F.when(F.length(p[2]) == 4, p[2]).otherwise(
            F.concat(F.when(p[2] < "50", F.lit("20")).otherwise(F.lit("19")), p[2])
        )
        zones = F.create_map(*[F.lit(x) for kv in ZONE_OFFSETS.items() for x in kv])
        offset = (
            F.when(p[6].rlike("^[+-]"), replace_all(p[6], r"^([+-]\d{2}):?(\d{2})", "$1:$2"))
            .when(p[6] == "", F.lit("+00:00"))
            .otherwise(zones[F.upper(p[6])])
        )
        iso = F.concat(
            year,
            F.lit("-"),
            F.lpad(((place + 2) / 3).cast("int").cast("string"), 2, "0"),
            F.lit("-"),
            F.lpad(p[0], 2, "0"),
            F.lit("T"),
            F.lpad(p[3], 2, "0"),
            F.lit(":"),
            p[4],
            F.lit(":"),
            F.when(p[5] == "", F.lit("00")).otherwise(p[5]),
            offset,
        )
        return F.when(place % 3 == 1, iso).try_cast("timestamp")

    def dated(p: Column) -> Column:
        return bind(F.instr(F.lit(_MONTHS), F.lower(p[1])), lambda place: build(p, place))

    # Text that is no such date is left as it is; the fields of one are cut by bars, which dates have none of.
    fields = "|".join(f"${i}" for i in range(1, 8))
    return bind(
        replace_all(trimmed, _MAIL_DATE, fields),
        lambda found: F.when(found != trimmed, bind(F.split(found, r"\|"), dated)),
    )


def _iso_date(trimmed: Column) -> Column:
    return F.when(trimmed.rlike(_ISO_DATE), F.upper(trimmed).try_cast("timestamp"))


def parse_mail_date(text: ColumnOrName) -> Column:
    """RFC 822 / 2822 date text to a timestamp; null if it is not one.

    A missing zone means UTC; an unknown one, or text after the date other than a comment in
    parentheses, gives null.

    The text is rewritten to ISO form and cast, which needs no per-row exception handling.
    """
    return bind(trim_space(text), _mail_date)


def parse_iso_date(text: ColumnOrName) -> Column:
    """ISO 8601 / RFC 3339 text to a timestamp; a missing zone means UTC."""
    return bind(trim_space(text), _iso_date)


def parse_feed_date(text: ColumnOrName) -> Column:
    """Any date form feeds use, else null."""
    return bind(trim_space(text), lambda v: F.coalesce(_iso_date(v), _mail_date(v)))


def rfc3339(ts: ColumnOrName) -> Column:
    """Second precision with a trailing ``Z`` (the session time zone is UTC)."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def effective_ts(published: ColumnOrName, updated: ColumnOrName) -> Column:
    """The instant an item is ordered and filtered by."""
    return F.coalesce(col(published), col(updated))


def parse_duration(text: ColumnOrName) -> Column:
    """Seconds of ``30s``, ``15m``, ``2h``, ``7d``, ``1w``; null for anything else."""
    pattern = r"^([0-9]+)([smhdw])\z"
    units = F.create_map(*[F.lit(x) for kv in DURATION_UNITS.items() for x in kv])
    return bind(
        trim_space(text),
        lambda v: F.when(
            v.rlike(pattern),
            F.try_multiply(
                F.regexp_extract(v, pattern, 1).try_cast("bigint"),
                units[F.regexp_extract(v, pattern, 2)].cast("bigint"),
            ),
        ),
    )


def parse_since(text: ColumnOrName, as_of: ColumnOrName) -> Column:
    """A duration back from ``as_of``, an RFC 3339 instant, or a bare date; null if none of them."""
    instant = r"^\d{4}-\d{2}-\d{2}(?:[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2}))?\z"
    # Durations too large for a timestamp, which counts microseconds in 64 bits, give null rather than an overflow.
    back = lambda s: F.try_subtract(F.unix_micros(col(as_of)), F.try_multiply(s, F.lit(1_000_000).cast("bigint")))
    return bind(
        trim_space(text),
        lambda v: F.coalesce(
            F.timestamp_micros(back(parse_duration(v))),
            F.when(v.rlike(instant), F.upper(v).try_cast("timestamp")),
        ),
    )


def retry_after_seconds(header: ColumnOrName, as_of: ColumnOrName) -> Column:
    """Seconds to wait from a ``Retry-After`` header: a count or a date; null if past or garbage."""
    return bind(
        trim_space(header),
        lambda v: F.when(v.rlike(r"^[+]?[0-9]+\z"), v.try_cast("bigint").cast("double")).otherwise(
            bind(
                (F.unix_micros(parse_mail_date(v)) - F.unix_micros(col(as_of))) / 1e6,
                lambda wait: F.when(wait >= 0, wait),
            )
        ),
    )

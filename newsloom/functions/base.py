"""Small helpers shared by the column functions."""

from __future__ import annotations

import functools
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

ColumnOrName = Column | str

# The Unicode White_Space characters, as the body of a regular-expression class.
UNICODE_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


_BUILT: WeakKeyDictionary = WeakKeyDictionary()


def per_session(make: Callable) -> Callable:
    """Build the columns of a function once per Spark session and argument list.

    Columns are immutable descriptions, so they can be used in any number of plans. Building the
    larger ones takes a second of calls into the JVM. Arguments that are columns are not cached.
    """

    @functools.wraps(make)
    def cached(*args):
        context = SparkContext._active_spark_context
        if context is None or any(isinstance(a, Column) for a in args):
            return make(*args)
        built = _BUILT.setdefault(context, {})
        key = (make.__module__, make.__qualname__, args)
        if key not in built:
            built[key] = make(*args)
        return built[key]

    return cached


def bind(value: ColumnOrName, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may mention it many times.

    Without this an expression that repeats its argument is copied, and recomputed, at every
    mention.
    """
    return F.get(F.transform(F.array(col(value)), body), F.lit(0))


def replace_all(value: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(value, F.lit(pattern), F.lit(replacement))


def trim_space(value: ColumnOrName) -> Column:
    """Trim Unicode white space on both ends."""
    return replace_all(col(value), f"^[{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+\\z", "")


def is_blank(value: ColumnOrName) -> Column:
    """True for null, empty, or white-space-only text."""
    return F.coalesce(~col(value).rlike(f"[^{UNICODE_SPACE}]"), F.lit(True))


def none_if_empty(value: ColumnOrName) -> Column:
    return F.nullif(col(value), F.lit(""))

"""The published contract: record types, closed value sets, and checks against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from newsloom.errors import UsageError

SCHEMA_VERSION = "1"

# The closed sets of the contract.
FEED_STATUSES = ("ok", "not_modified", "error")
ID_SOURCES = ("link", "guid", "hash")
CONTENT_FORMATS = ("markdown", "text", "html", "none")
FEED_TYPES = ("rss", "atom", "json", "unknown")
ERROR_CODES = (
    "USAGE_ERROR",
    "INVALID_URL",
    "NETWORK_ERROR",
    "FEED_FETCH_FAILED",
    "RATE_LIMITED",
    "FEED_PARSE_FAILED",
    "NOT_FOUND",
    "CACHE_ERROR",
    "RESPONSE_TOO_LARGE",
    "IO_ERROR",
    "INTERNAL_ERROR",
)
WARNING_CODES = ("CONTENT_EXTRACTION_FALLBACK", "UNDATED_ITEMS")


def _s(name: str, nullable: bool = True) -> T.StructField:
    return T.StructField(name, T.StringType(), nullable)


def _n(name: str, nullable: bool = False) -> T.StructField:
    return T.StructField(name, T.LongType(), nullable)


def _b(name: str) -> T.StructField:
    return T.StructField(name, T.BooleanType(), False)


ENCLOSURE = T.StructType([_s("url", False), _s("mime"), _n("length", True)])

ITEM = T.StructType(
    [
        _s("id", False),
        _s("id_source", False),
        _s("feed_url", False),
        _s("title"),
        _s("url"),
        T.StructField("authors", T.ArrayType(T.StringType()), False),
        _s("published"),
        _s("updated"),
        _s("summary"),
        _s("content"),
        _s("content_format", False),
        _n("content_tokens_est"),
        _b("content_truncated"),
        _s("content_hash"),
        T.StructField("categories", T.ArrayType(T.StringType()), False),
        T.StructField("enclosures", T.ArrayType(ENCLOSURE), False),
        _s("guid"),
    ]
)

ERROR = T.StructType([_s("feed_url"), _s("code", False), _s("message", False), _s("details", False)])

WARNING = T.StructType([_s("feed_url"), _s("code", False), _s("message", False)])

TRUNCATION = T.StructType(
    [
        _n("applied_limit", True),
        _n("items_content_truncated"),
        _n("items_omitted"),
        _n("estimated_tokens", True),
        _s("suggestion"),
    ]
)

FEED = T.StructType(
    [
        _s("feed_url", False),
        _s("status", False),
        _b("from_cache"),
        _s("title"),
        _s("site_url"),
        _s("updated"),
        _n("item_count"),
        _n("content_tokens_est_total"),
        T.StructField("items", T.ArrayType(ITEM), False),
        T.StructField("error", ERROR, True),
    ]
)

FETCH = T.StructType(
    [
        _s("schema_version", False),
        _s("fetched_at", False),
        _n("total_items"),
        _n("total_content_tokens_est"),
        T.StructField("feeds", T.ArrayType(FEED), False),
        T.StructField("errors", T.ArrayType(ERROR), False),
        T.StructField("warnings", T.ArrayType(WARNING), False),
        T.StructField("truncation", TRUNCATION, True),
    ]
)

DISCOVERED_FEED = T.StructType([_s("url", False), _s("feed_type", False), _s("title")])

DISCOVER = T.StructType(
    [
        _s("schema_version", False),
        _s("site_url", False),
        T.StructField("feeds", T.ArrayType(DISCOVERED_FEED), False),
    ]
)

_CONTRACTS = {"fetch": FETCH, "discover": DISCOVER}
# Flat record types that data frames are checked against.
_RECORDS = {
    "item": ITEM,
    "feed": T.StructType([f for f in FEED.fields if f.name not in ("items", "error")]),
    "error": ERROR,
    "warning": WARNING,
    "discovered_feed": DISCOVERED_FEED,
}
_ENUMS = {
    "item": {"id_source": ID_SOURCES, "content_format": CONTENT_FORMATS},
    "feed": {"status": FEED_STATUSES},
    "error": {"code": ERROR_CODES},
    "warning": {"code": WARNING_CODES},
    "discovered_feed": {"feed_type": FEED_TYPES},
}


def contract(name: str) -> T.StructType:
    """The schema of a published document: ``fetch`` or ``discover``."""
    try:
        return _CONTRACTS[name]
    except KeyError:
        raise UsageError(f"unknown schema '{name}' (expected fetch|discover)") from None


def record_type(name: str) -> T.StructType:
    """The schema of one flat record kind."""
    try:
        return _RECORDS[name]
    except KeyError:
        raise UsageError(f"unknown record type '{name}' (expected {'|'.join(_RECORDS)})") from None


def _violations(have: T.StructType, name: str, at: str = "") -> Column:
    """``array<struct<field, rule, rows>>`` over all rows, of the columns of ``have``, or the fields of a struct ``at.``"""
    want = record_type(name)
    types = {f.name: f.dataType for f in have.fields}
    static = []
    checks = []
    for field in want.fields:
        if field.name not in types:
            static.append((field.name, "missing"))
            continue
        if types[field.name].simpleString() != field.dataType.simpleString():
            static.append((field.name, "type"))
        if not field.nullable:
            checks.append((field.name, "null", F.col(at + field.name).isNull()))
    for column, allowed in _ENUMS.get(name, {}).items():
        if column in types:
            bad = F.col(at + column).isNotNull() & ~F.col(at + column).isin(*allowed)
            checks.append((column, "value", bad))
    found = [
        F.struct(F.lit(c).alias("field"), F.lit(r).alias("rule"), F.count_if(bad).alias("rows"))
        for c, r, bad in checks
    ]
    found += [
        F.struct(F.lit(c).alias("field"), F.lit(r).alias("rule"), F.lit(None).cast("bigint").alias("rows"))
        for c, r in static
    ]
    return F.array(*found)


def check_contract(df: DataFrame, name: str) -> DataFrame:
    """Violations of a record type in one scan: one row per (field, rule) with its row count.

    Type mismatches and missing fields are found from the schema alone and carry a null count.
    """
    found = df.agg(_violations(df.schema, name).alias("found")).select(F.inline_outer("found"))
    return found.where(F.col("rows").isNull() | (F.col("rows") > 0))


def check_contracts(df: DataFrame, name: str) -> DataFrame:
    """The same for every struct column of ``df``, all in one scan: ``(form, field, rule, rows)``, ``form`` its name."""
    checked = [_violations(f.dataType, name, f"{f.name}.").alias(f.name) for f in df.schema.fields]
    rows = [F.struct(F.lit(f.name).alias("form"), F.col(f.name).alias("found")) for f in df.schema.fields]
    forms = df.agg(*checked).select(F.inline(F.array(*rows))).select("form", F.inline_outer("found"))
    return forms.where(F.col("rows").isNull() | (F.col("rows") > 0))

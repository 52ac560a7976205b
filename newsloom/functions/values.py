"""Small value rules: links, enclosures, people, lenient integers, error objects."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom.functions.base import ColumnOrName, bind, col, is_blank, none_if_empty, trim_space
from newsloom.schemas import CONTENT_FORMATS, ERROR_CODES

_NO_STRINGS = "array<string>"
_ENCLOSURES = "array<struct<url:string,mime:string,length:bigint>>"


def pick_link(links: ColumnOrName) -> Column:
    """Href of the first link whose rel is exactly ``alternate``, else of the first link."""
    first = F.get(col(links), F.lit(0))
    alternate = F.get(F.filter(col(links), lambda l: l["rel"] == "alternate"), F.lit(0))
    return F.coalesce(alternate, first)["href"]


def collect_enclosures(media: ColumnOrName, links: ColumnOrName) -> Column:
    """Media entries with a URL first, then non-empty links with rel ``enclosure``."""

    def shape(entry: Column, url: str) -> Column:
        return F.struct(
            entry[url].alias("url"),
            none_if_empty(entry["type"]).alias("mime"),
            F.trim(entry["length"]).try_cast("bigint").alias("length"),
        )

    from_media = F.transform(
        F.filter(col(media), lambda m: m["url"].isNotNull()), lambda m: shape(m, "url")
    )
    from_links = F.transform(
        F.filter(col(links), lambda l: (l["rel"] == "enclosure") & (F.length(l["href"]) > 0)),
        lambda l: shape(l, "href"),
    )
    none = F.array().cast(_ENCLOSURES)
    return F.concat(F.coalesce(from_media, none), F.coalesce(from_links, none))


def person_name(text: ColumnOrName) -> Column:
    """``mail (Name)`` gives ``Name``; anything else is the name itself."""
    return bind(
        text,
        lambda v: F.coalesce(
            none_if_empty(F.trim(F.regexp_extract(v, r"(?s)^\s*\S+@\S+\s*\((.*)\)\s*\z", 1))), v
        ),
    )


def names(people: ColumnOrName) -> Column:
    """Names in document order, ``[]`` if there are none."""
    return F.coalesce(F.transform(col(people), person_name), F.array().cast(_NO_STRINGS))


def terms(categories: ColumnOrName) -> Column:
    """Category terms in document order, ``[]`` if there are none."""
    return F.coalesce(
        F.filter(col(categories), lambda c: c.isNotNull()), F.array().cast(_NO_STRINGS)
    )


def null_if_empty(guid: ColumnOrName) -> Column:
    return none_if_empty(guid)


def lenient_int(text: ColumnOrName) -> Column:
    """``struct(value, is_error)`` of a JSON scalar given as its JSON text.

    Whole non-negative numbers and their quoted form are accepted; null, ``null`` and the empty
    string mean "not given"; everything else is an error.
    """

    def build(v: Column) -> Column:
        quoted = v.startswith('"')
        inner = trim_space(F.regexp_extract(v, r'(?s)^"(.*)"\z', 1))
        plain = F.when(quoted, inner).otherwise(v)
        absent = v.isNull() | (v == "null") | (quoted & (inner == ""))
        integer = F.when(plain.rlike(r"^\+?[0-9]+\z") & (quoted | ~v.startswith("+")), plain.try_cast("bigint"))
        number = v.try_cast("double")
        whole = F.when(
            ~quoted
            & v.rlike(r"^-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z")
            & (number >= 0)
            & (number == F.floor(number))
            & (number < 9.2e18),
            number.try_cast("bigint"),
        )
        value = F.coalesce(integer, whole)
        return F.struct(
            F.when(~absent, value).alias("value"),
            (~absent & value.isNull()).alias("is_error"),
        )

    return bind(F.trim(col(text)), build)


def parse_content_format(text: ColumnOrName) -> Column:
    """A content format in any case and padding; null if unknown."""
    return bind(F.lower(trim_space(text)), lambda v: F.when(v.isin(*CONTENT_FORMATS), v))


def http_details(status: ColumnOrName, retry_after: ColumnOrName) -> Column:
    return F.to_json(
        F.struct(
            col(status).cast("bigint").alias("http_status"), col(retry_after).alias("retry_after")
        ),
        {"ignoreNullFields": "false"},
    )


def wait_details(wait_ms: ColumnOrName) -> Column:
    ms = col(wait_ms).cast("bigint")
    return F.to_json(
        F.struct(
            F.floor(ms / 1000).cast("bigint").alias("retry_after_seconds"),
            ms.alias("retry_after_ms"),
        )
    )


def error_object(
    code: str | Column,
    message: ColumnOrName,
    feed_url: ColumnOrName,
    details: Column | None = None,
) -> Column:
    """The error record; ``details`` is JSON text, ``{}`` when there is nothing to add."""
    if isinstance(code, str):
        assert code in ERROR_CODES, code
        code = F.lit(code)
    return F.struct(
        col(feed_url).alias("feed_url"),
        code.alias("code"),
        col(message).alias("message"),
        F.coalesce(details if details is not None else F.lit(None), F.lit("{}")).alias("details"),
    )


def present(text: ColumnOrName) -> Column:
    return ~is_blank(text)

"""Feeds advertised by web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.base import bind, is_blank, per_session, trim_space
from newsloom.functions.text import unescape_entities
from newsloom.functions.urls import classify_feed_link, is_absolute_url, resolve_url
from newsloom.session import spread

_LINK_TAG = r"""(?is)<link(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*+>"""


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute (double-quoted, single-quoted or bare), null if absent."""
    quoted = r"""(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
    # Walk over whole attributes so that a name inside another attribute's value does not match.
    lead = rf"""(?is)^<\w+(?:\s+[^\s=>"'/]+(?:\s*=\s*{quoted})?|[\s/]+)*?[\s/]"""
    value = rf"""{lead}{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    found = F.concat(*[F.regexp_extract(tag, value, group) for group in (1, 2, 3)])
    return F.when(tag.rlike(value), unescape_entities(found))


def page_links(html: Column) -> Column:
    """All ``<link>`` tags outside comments, in document order."""
    return F.regexp_extract_all(
        F.regexp_replace(html, r"(?s)<!--.*?-->", ""), F.lit(_LINK_TAG), F.lit(0)
    )


def _candidate(tag: Column, base: Column) -> Column:
    """A feed reference of one tag, or null where the tag is not one."""
    read = F.struct(
        *[attribute(tag, name).alias(name) for name in ("rel", "href", "type", "title")]
    )

    def build(a: Column) -> Column:
        kind = classify_feed_link(a["type"], a["href"])
        wanted = F.lower(a["rel"]).contains("alternate") & ~is_blank(a["href"]) & kind.isNotNull()
        url = F.when(is_absolute_url(base), resolve_url(base, trim_space(a["href"]))).otherwise(
            trim_space(a["href"])
        )
        return F.when(
            wanted,
            F.struct(url.alias("url"), kind.alias("feed_type"), a["title"].alias("title")),
        )

    return bind(read, build)


@per_session
def feeds_of_page(url: str, html: str) -> Column:
    """``array<struct<url, feed_type, title>>`` of a page, given the names of its columns.

    Links are resolved against the page URL and repeated URLs keep their first occurrence.
    """
    base = F.col(url)
    found = F.transform(page_links(F.col(html)), lambda tag: _candidate(tag, base))
    found = F.filter(found, lambda c: c["url"].isNotNull())

    def first_of_each(rows: Column) -> Column:
        urls = F.transform(rows, lambda c: c["url"])
        return F.filter(rows, lambda c, i: F.array_position(urls, c["url"]) == i + 1)

    return bind(found, first_of_each)


def page_feeds(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row per page with its ``feeds`` array, empty where it advertises none. No shuffle."""
    keep = [c for c in pages.columns if c not in (url, html)]
    return spread(pages).select(
        *keep, F.col(url).alias("site_url"), feeds_of_page(url, html).alias("feeds")
    )


def discover_feeds(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(site_url, pos, url, feed_type, title)`` per feed link of each page, in page order."""
    found = page_feeds(pages, url, html)
    keep = [c for c in found.columns if c != "feeds"]
    return found.select(*keep, F.posexplode("feeds").alias("pos", "_f")).select(
        *keep, F.col("pos").cast("bigint").alias("pos"), "_f.*"
    )

"""Deterministic keys: item id, its source, content hash, snapshot key."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom.functions.base import ColumnOrName, col, none_if_empty, per_session


def _hex16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


@per_session
def item_id(
    feed_url: ColumnOrName,
    link: ColumnOrName,
    guid: ColumnOrName,
    title: ColumnOrName,
    published: ColumnOrName,
) -> Column:
    """16 hex characters naming an item within its feed.

    ``published`` is RFC 3339 text. The key is the first non-empty one of link and guid, else
    ``title|published``; when both of those are missing the key is empty.
    """
    pair = F.concat(
        F.coalesce(col(title), F.lit("")), F.lit("|"), F.coalesce(col(published), F.lit(""))
    )
    fallback = F.coalesce(F.nullif(pair, F.lit("|")), F.lit(""))
    key = F.coalesce(none_if_empty(link), none_if_empty(guid), fallback)
    return _hex16(F.concat(col(feed_url), F.lit("\n"), key))


def id_source(link: ColumnOrName, guid: ColumnOrName) -> Column:
    """Which field named the item: ``link``, ``guid`` or ``hash``."""
    return (
        F.when(F.length(col(link)) > 0, F.lit("link"))
        .when(F.length(col(guid)) > 0, F.lit("guid"))
        .otherwise(F.lit("hash"))
    )


def content_hash(text: ColumnOrName) -> Column:
    """16 hex characters of the whole extracted body; null without a body."""
    return _hex16(col(text))


def snapshot_key(feed_url: ColumnOrName) -> Column:
    """Full SHA-256 of a feed URL, usable as a bucketing key."""
    return F.sha2(col(feed_url), 256)

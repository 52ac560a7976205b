"""Filters, lookups and comparisons of item tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.dates import rfc3339
from newsloom.functions.values import error_object
from newsloom.operators.ranking import CHUNK_ROWS, keep_first, newest_first, position_in_group, top_per_group
from newsloom.schemas import ITEM

ITEM_COLUMNS = ITEM.fieldNames()


def contract_items(items: DataFrame, *extra: str | Column) -> DataFrame:
    """The published item record, instants as RFC 3339 text, then any ``extra`` columns."""
    types = {f.name: f.dataType.typeName() for f in items.schema.fields}
    return items.select(
        *[
            rfc3339(name).alias(name) if types[name].startswith("timestamp") else F.col(name)
            for name in ITEM_COLUMNS
        ],
        *extra,
    )


def since_filter(items: DataFrame, since: datetime | Column | None, ts: str = "ts") -> DataFrame:
    """Drop items known to be older than ``since``; undated items stay."""
    if since is None:
        return items
    bound = since if isinstance(since, Column) else F.lit(since)
    return items.where(F.col(ts).isNull() | (F.col(ts) >= bound))


def newest_n(
    items: DataFrame,
    n: int | None,
    keys: tuple[str, ...] = ("feed_url",),
    ties: tuple[str, ...] = ("pos",),
    rank: str | None = None,
) -> DataFrame:
    """The newest ``n`` items per feed; all of them for None, none for 0."""
    if n is None:
        return items
    return top_per_group(items, keys, newest_first(*ties), n, rank, spread_by=ties)


def in_report_order(items: DataFrame) -> DataFrame:
    """Sort for output: feeds in request order, items newest first.

    A range-partitioned sort on the whole key, so a big feed spreads over many tasks.
    """
    return items.orderBy("request_pos", *newest_first("pos"))


def in_request_order(feeds: DataFrame) -> DataFrame:
    """Sort feeds or errors for output: whatever finished first, result i belongs to request i."""
    return feeds.orderBy("request_pos")


def item_positions(items: DataFrame, chunk_rows: int = CHUNK_ROWS, name: str = "item_pos") -> DataFrame:
    """Newest-first position of every item in its feed, without gathering a feed in one task."""
    rank = [F.col("ts").isNull(), -F.unix_micros("ts"), F.col("pos")]
    return position_in_group(items, ["feed_url"], rank, name, chunk_rows)


def item_keys(items: DataFrame) -> DataFrame:
    """One row per item and distinct non-null key (id, guid, url) it can be found by."""
    keys = F.array_distinct(F.array_compact(F.array("id", "guid", "url")))
    return items.withColumn("key", F.explode(keys))


def find_items(items: DataFrame, keys: DataFrame, ties: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Look up ``keys(feed_url, key)``: the first item, newest first, with that id, guid or URL.

    Keys without an item come back once each, item columns null, with a ``NOT_FOUND`` error. The
    keys of each item are exploded so that the join is on equality.
    """
    wanted = keys.select("feed_url", "key").distinct()
    return first_hits(item_keys(items).join(wanted, ["feed_url", "key"]), wanted, ties)


def first_hits(hits: DataFrame, wanted: DataFrame, ties: tuple[str, ...] = ("pos",)) -> DataFrame:
    """The first of the ``hits`` on each of the ``wanted`` keys, or a ``NOT_FOUND`` error."""
    first = keep_first(hits, ["feed_url", "key"], newest_first(*ties))
    message = F.concat(
        F.lit("item '"), F.col("key"), F.lit("' not found in "), F.col("feed_url")
    )
    return wanted.join(first, ["feed_url", "key"], "left").withColumn(
        "error",
        F.when(F.col("id").isNull(), error_object("NOT_FOUND", message, "feed_url")),
    )


def cross_feed_matches(items: DataFrame) -> DataFrame:
    """Posts carried by several feeds: ``(guid, n_feeds, feed_url, ids)`` per guid and feed.

    The guid is the portable key; ids differ because they are namespaced by feed. Items collapse
    to (guid, feed) before the guids are counted, so copies of one post do not pile up. The answer
    has one row per feed rather than one array per guid, so that no guid needs gathering.
    """
    per_feed = (
        items.where(F.col("guid").isNotNull())
        .groupBy("guid", "feed_url")
        .agg(F.min("id").alias("id"))
    )
    spread = per_feed.groupBy("guid").agg(F.count("*").alias("n_feeds")).where(F.col("n_feeds") > 1)
    return per_feed.join(spread, "guid").select("guid", "n_feeds", "feed_url", "id")


def _latest_hash(items: DataFrame, order: Column, name: str) -> DataFrame:
    """One content hash per (feed, id): partial aggregation, so repeated ids cost nothing extra."""
    return items.groupBy("feed_url", "id").agg(
        F.min_by(F.struct("content_hash"), order)["content_hash"].alias(name)
    )


def diff_snapshots(old: DataFrame, new: DataFrame, order: str = "pos") -> DataFrame:
    """``added`` / ``removed`` / ``changed`` / ``unchanged`` per (feed, id), by content hash.

    Both sides must hold bodies in the same format. An id occurring twice in a feed counts once,
    with its first item. The join is on (feed, id), which spreads a big feed by its ids.
    """
    a = _latest_hash(old, F.col(order), "old_hash").withColumn("_old", F.lit(True))
    b = _latest_hash(new, F.col(order), "new_hash").withColumn("_new", F.lit(True))
    return a.join(b, ["feed_url", "id"], "full_outer").select(
        "feed_url",
        "id",
        F.when(F.col("_old").isNull(), F.lit("added"))
        .when(F.col("_new").isNull(), F.lit("removed"))
        .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
        .alias("change"),
        "old_hash",
        "new_hash",
    )


def unseen_items(items: DataFrame, seen: DataFrame) -> DataFrame:
    """Items whose (feed, id) the caller has not processed yet."""
    return items.join(seen.select("feed_url", "id"), ["feed_url", "id"], "left_anti")

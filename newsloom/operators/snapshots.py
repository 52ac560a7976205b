"""Fetch outcomes against stored snapshots, and the snapshot table itself."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.errors import UsageError
from newsloom.functions.values import error_object, http_details
from newsloom.operators.ranking import keep_first
from newsloom.params import POLICIES

# Response codes that mean "slow down".
THROTTLE_CODES = (403, 429)

SNAPSHOT_COLUMNS = ["feed_url", "etag", "last_modified", "fetched_at", "content_type", "body"]


def is_throttled(status: Column) -> Column:
    return F.coalesce(status.isin(*THROTTLE_CODES), F.lit(False))


def is_success(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def is_fresh(fetched_at: Column, max_age: timedelta, as_of: datetime | Column) -> Column:
    """Strictly younger than ``max_age``; an unreadable time is not fresh."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    age = F.unix_micros(now) - F.unix_micros(fetched_at.try_cast("timestamp"))
    return F.coalesce(age < int(max_age / timedelta(microseconds=1)), F.lit(False))


def fresh(snapshots: DataFrame, max_age: timedelta, as_of: datetime | Column) -> DataFrame:
    return snapshots.where(is_fresh(F.col("fetched_at"), max_age, as_of))


def latest_responses(responses: DataFrame) -> DataFrame:
    """The newest response per feed, for logs that hold several."""
    return keep_first(responses, ["feed_url"], [F.col("fetched_at").desc_nulls_last()])


def resolve_fetch(
    requests: DataFrame,
    responses: DataFrame,
    snapshots: DataFrame | None,
    policy: str = "revalidate",
    max_age: timedelta | None = None,
    as_of: datetime | Column | None = None,
) -> DataFrame:
    """What each request ends up with: a body and where it came from, or an error.

    ``requests(request_pos, feed_url)``, at most one response and one snapshot per feed. Adds
    ``body``, ``content_type``, ``status`` (ok / not_modified / error), ``from_cache`` and
    ``fetch_error``. Under ``no_cache`` snapshots are not read at all.
    """
    if policy not in POLICIES:
        raise UsageError(f"unknown policy '{policy}' (expected {'|'.join(POLICIES)})")
    if policy == "max_age" and (max_age is None or as_of is None):
        raise UsageError("policy max_age needs max_age and as_of")
    answers = responses.select(
        "feed_url",
        F.col("http_status").alias("_code"),
        F.col("body").alias("_new_body"),
        F.col("content_type").alias("_new_type"),
        F.col("retry_after").alias("_retry_after"),
    )
    joined = requests.join(answers, "feed_url", "left")
    if policy == "no_cache" or snapshots is None:
        joined = joined.withColumns(
            {
                "_held": F.lit(False),
                "_old_body": F.lit(None).cast("string"),
                "_old_type": F.lit(None).cast("string"),
                "_fetched_at": F.lit(None).cast("timestamp"),
            }
        )
    else:
        stored = snapshots.select(
            "feed_url",
            F.lit(True).alias("_held"),
            F.col("body").alias("_old_body"),
            F.col("content_type").alias("_old_type"),
            F.col("fetched_at").alias("_fetched_at"),
        )
        joined = joined.join(stored, "feed_url", "left")
    held = F.coalesce(F.col("_held"), F.lit(False))
    if policy == "cache_first":
        hit = held
    elif policy == "max_age":
        hit = held & is_fresh(F.col("_fetched_at"), max_age, as_of)
    else:
        hit = F.lit(False)
    code = F.col("_code")
    unchanged = F.coalesce(code == 304, F.lit(False)) & (policy != "no_cache")
    cached = hit | (unchanged & held)
    served = cached | is_success(code)
    url = F.col("feed_url")
    failure = (
        F.when(served, F.lit(None))
        .when(
            code.isNull(),
            error_object("NETWORK_ERROR", F.concat(F.lit("network error: no response for "), url), url),
        )
        .when(
            unchanged,
            error_object(
                "NETWORK_ERROR",
                F.concat(
                    F.lit("network error: server returned 304 but no cache entry exists for "), url
                ),
                url,
            ),
        )
        .otherwise(
            error_object(
                "FEED_FETCH_FAILED",
                F.concat(F.lit("HTTP status "), code.cast("string"), F.lit(": "), url),
                url,
                http_details(code, F.col("_retry_after")),
            )
        )
    )
    keep = [c for c in requests.columns if c != "feed_url"]
    return joined.select(
        *keep,
        "feed_url",
        F.when(cached, F.col("_old_body")).when(served, F.col("_new_body")).alias("body"),
        F.when(cached, F.col("_old_type")).when(served, F.col("_new_type")).alias("content_type"),
        F.when(cached, F.lit("not_modified"))
        .when(served, F.lit("ok"))
        .otherwise(F.lit("error"))
        .alias("status"),
        cached.alias("from_cache"),
        failure.alias("fetch_error"),
    )


def upsert_snapshots(snapshots: DataFrame | None, responses: DataFrame) -> DataFrame:
    """The snapshot table after a batch of responses, last writer wins.

    A 2xx replaces body and validators; a 304 keeps them and only refreshes ``fetched_at``; other
    responses write nothing, and neither does a 304 of a feed never stored. One partial
    aggregation: each map task sends at most one body per feed.
    """
    code = F.col("http_status")
    payload = ["etag", "last_modified", "content_type", "body"]
    events = responses.where(is_success(code) | (code == 304)).select(
        "feed_url", "fetched_at", is_success(code).alias("_writes"), F.lit(1).alias("_new"), *payload
    )
    if snapshots is not None:
        events = snapshots.select(
            "feed_url", "fetched_at", F.lit(True).alias("_writes"), F.lit(0).alias("_new"), *payload
        ).unionByName(events)
    writes = F.col("_writes")
    merged = events.groupBy("feed_url").agg(
        F.max_by(
            F.when(writes, F.struct(*payload)), F.when(writes, F.struct("fetched_at", "_new"))
        ).alias("_kept"),
        F.max(F.when(writes, F.col("fetched_at"))).alias("_written_at"),
        F.min(F.when(writes, F.col("fetched_at"))).alias("_first_write"),
        F.max(F.when(~writes, F.col("fetched_at"))).alias("_confirmed_at"),
    )
    confirmed = F.when(
        F.col("_confirmed_at") >= F.col("_first_write"), F.col("_confirmed_at")
    )
    return merged.where(F.col("_written_at").isNotNull()).select(
        "feed_url",
        "_kept.etag",
        "_kept.last_modified",
        F.greatest(F.col("_written_at"), confirmed).alias("fetched_at"),
        "_kept.content_type",
        "_kept.body",
    )


def list_snapshots(snapshots: DataFrame) -> DataFrame:
    """``(feed_url, fetched_at, size_bytes, etag)``; rows without a URL or time are skipped."""
    return snapshots.where(F.col("feed_url").isNotNull() & F.col("fetched_at").isNotNull()).select(
        "feed_url",
        "fetched_at",
        F.coalesce(F.octet_length("body"), F.lit(0)).cast("bigint").alias("size_bytes"),
        "etag",
    )

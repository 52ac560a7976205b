"""Look up single items in stored snapshots by id, guid or URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.functions.identity import content_hash
from newsloom.functions.text import estimate_tokens, extract_content, is_over, truncate_chars
from newsloom.operators.items import first_hits
from newsloom.params import FeedParams
from newsloom.plans.fetch import fetch

#: Keys that travel with a snapshot; a feed asked for more of them is parsed once per so many.
KEYS_PER_ROW = 1_000


def _wanted_of_feeds(wanted: DataFrame) -> DataFrame:
    """``(feed_url, wanted)``: the keys of each feed in arrays of about ``KEYS_PER_ROW`` at most."""
    sizes = wanted.groupBy("feed_url").agg(F.ceil(F.count("*") / KEYS_PER_ROW).cast("int").alias("_slots"))
    slot = F.pmod(F.xxhash64("key"), F.col("_slots"))
    dealt = wanted.join(sizes, "feed_url").withColumn("_slot", slot)
    return dealt.groupBy("feed_url", "_slot").agg(F.collect_list("key").alias("wanted")).drop("_slot")


def show_items(
    snapshots: DataFrame, keys: DataFrame, max_content_chars: int | None = None, content_format: str = "markdown"
) -> DataFrame:
    """First matching item per ``keys(feed_url, key)``, from the snapshot bodies of those feeds.

    Only the snapshots the keys name are parsed, each with its own keys beside it, so that items are
    matched where they are parsed: the rest of a feed is neither shuffled nor converted. No since
    filter and no limit apply.
    """
    params = FeedParams(max_content_chars=max_content_chars, content_format=content_format)
    wanted = keys.select("feed_url", "key").distinct()
    named = snapshots.join(_wanted_of_feeds(wanted), "feed_url")
    documents = named.select(F.lit(0).cast("bigint").alias("request_pos"), "feed_url", "body", "wanted")
    items = fetch(documents, FeedParams(content_format="html")).items()
    own = F.array_intersect(F.array_compact(F.array("id", "guid", "url")), F.col("wanted"))
    hits = items.withColumn("key", F.explode(own)).drop("wanted").withColumn("_x", extract_content("content", params.content_format))
    whole = F.col("_x")["content"]
    shown = hits.withColumns(
        {
            "content": truncate_chars(whole, max_content_chars),
            "content_format": F.lit(params.content_format),
            "content_truncated": is_over(whole, max_content_chars),
            "content_hash": content_hash(whole),
            "fell_back": F.coalesce(F.col("_x")["fell_back"], F.lit(False)),
        }
    ).drop("_x")
    return first_hits(shown.withColumn("content_tokens_est", estimate_tokens("content")), wanted)

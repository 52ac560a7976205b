"""Request lists merged from several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.errors import UsageError
from newsloom.operators.ranking import keep_first
from newsloom.sources.tables import seeds


def dedupe_keep_first(urls: DataFrame, order: tuple[str, ...] = ("source_rank", "pos")) -> DataFrame:
    """Exact-text dedupe of ``url``, keeping the first by source and position."""
    return keep_first(urls, ["url"], [F.col(c) for c in order])


def merge_sources(*sources: DataFrame) -> DataFrame:
    """``(source_rank, pos, url)`` of URL lists given in order of precedence.

    Each has ``pos`` and ``url``; blanks and comments are dropped, repeats keep the first.
    """
    if not sources:
        raise UsageError("no feed URLs provided")
    merged = None
    for rank, source in enumerate(sources):
        part = source.select(
            F.lit(rank).alias("source_rank"), F.col("pos").cast("bigint").alias("pos"), "url"
        )
        merged = part if merged is None else merged.unionByName(part)
    return dedupe_keep_first(seeds(merged))


def require_any(urls: DataFrame) -> DataFrame:
    """Raise a usage error when the list is empty (runs a one-row job)."""
    if urls.isEmpty():
        raise UsageError("no feed URLs provided")
    return urls


def as_requests(urls: DataFrame, stride: int = 1 << 40) -> DataFrame:
    """``(request_pos, feed_url)`` in merge order; positions rise but need not be consecutive."""
    return urls.select(
        (F.col("source_rank").cast("bigint") * F.lit(stride) + F.col("pos")).alias("request_pos"),
        F.col("url").alias("feed_url"),
    )

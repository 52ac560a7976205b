"""Feed and run totals, warnings, errors, status. All aggregate partially before shuffling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.schemas import SCHEMA_VERSION

# Run status numbers.
STATUS_OK, STATUS_PARTIAL, STATUS_ALL_FAILED = 0, 3, 4

# Warning texts, with the count in place of %d.
FALLBACK_TEXT = (
    "HTML conversion failed for %d item(s); fell back to a plain tag strip "
    "(content may be lower fidelity)"
)
UNDATED_TEXT = (
    "all %d returned item(s) lack a published/updated date; newest-first ordering falls back to "
    "the feed's original order"
)


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def feed_totals(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """``feeds`` with ``item_count`` and ``content_tokens_est_total``; 0 for feeds without items."""
    per_feed = items.groupBy("feed_url").agg(
        F.count("*").alias("item_count"),
        _total(F.col("content_tokens_est")).alias("content_tokens_est_total"),
    )
    return feeds.join(per_feed, "feed_url", "left").na.fill(
        0, ["item_count", "content_tokens_est_total"]
    )


def run_totals(items: DataFrame) -> DataFrame:
    """One row: ``total_items`` and ``total_content_tokens_est``."""
    return items.agg(
        F.count("*").alias("total_items"),
        _total(F.col("content_tokens_est")).alias("total_content_tokens_est"),
    )


def warnings_of(items: DataFrame) -> DataFrame:
    """``(feed_url, code, message)``: at most one warning of each code per feed."""
    counts = items.groupBy("feed_url").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("fell_back")).alias("n_fell_back"),
        F.count_if(F.col("ts").isNotNull()).alias("n_dated"),
    )
    return warnings_from_counts(counts)


def warnings_from_counts(counts: DataFrame) -> DataFrame:
    """Warnings of feeds that already carry ``n``, ``n_fell_back`` and ``n_dated``."""

    def warning(code: str, text: str, n: Column) -> Column:
        return F.struct(
            F.lit(code).alias("code"), F.format_string(text, n.cast("bigint")).alias("message")
        )

    found = F.array_compact(
        F.array(
            F.when(
                F.col("n_fell_back") > 0,
                warning("CONTENT_EXTRACTION_FALLBACK", FALLBACK_TEXT, F.col("n_fell_back")),
            ),
            F.when(
                (F.col("n") > 0) & (F.col("n_dated") == 0),
                warning("UNDATED_ITEMS", UNDATED_TEXT, F.col("n")),
            ),
        )
    )
    keep = [c for c in ("request_pos",) if c in counts.columns]
    return counts.select(*keep, "feed_url", F.explode(found).alias("w")).select(
        *keep, "feed_url", "w.code", "w.message"
    )


def truncation_marker(
    items: DataFrame, applied_limit: int | None = None, suggestion: str | None = None
) -> DataFrame:
    """One row with a nullable ``truncation`` struct: null unless some body was cut."""
    return items.agg(
        truncation_struct(
            F.count_if(F.col("content_truncated")),
            F.lit(applied_limit),
            F.lit(None),
            F.lit(suggestion),
        ).alias("truncation")
    )


def truncation_struct(n_cut: Column, limit: Column, tokens: Column, suggestion: Column) -> Column:
    return F.when(
        n_cut > 0,
        F.struct(
            limit.cast("bigint").alias("applied_limit"),
            n_cut.cast("bigint").alias("items_content_truncated"),
            F.lit(0).cast("bigint").alias("items_omitted"),
            tokens.cast("bigint").alias("estimated_tokens"),
            suggestion.cast("string").alias("suggestion"),
        ),
    )


def run_status(feeds: DataFrame) -> DataFrame:
    """One row ``(feeds, failed, status)``: 0 without failures, 4 if all failed, else 3."""
    counts = feeds.agg(
        F.count("*").alias("feeds"), F.count_if(F.col("status") == "error").alias("failed")
    )
    return counts.withColumn(
        "status",
        F.when(F.col("failed") == 0, STATUS_OK)
        .when(F.col("failed") == F.col("feeds"), STATUS_ALL_FAILED)
        .otherwise(STATUS_PARTIAL),
    )


def errors_of(feeds: DataFrame) -> DataFrame:
    """Feed errors as run-level records; ``request_pos`` keeps the order for the sink."""
    return feeds.where(F.col("error").isNotNull()).select(
        "request_pos", "error.feed_url", "error.code", "error.message", "error.details"
    )


def run_summary(feeds: DataFrame, fetched_at: Column) -> DataFrame:
    """The one-row run record: version, time, totals, counts."""
    return feeds.agg(
        F.count("*").alias("feeds"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        _total(F.col("item_count")).alias("total_items"),
        _total(F.col("content_tokens_est_total")).alias("total_content_tokens_est"),
        _total(F.col("n_cut")).alias("n_cut"),
    ).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        fetched_at.alias("fetched_at"),
        "*",
    )

"""JSON report documents, their size estimate, and the bounded single-feed report.

Reports are written in fragments (one per item, feed, error, warning), so that sizes are sums over
fragments and no more than one bounded feed is ever held in a row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.errors import UsageError
from newsloom.functions.base import bind, per_session
from newsloom.functions.dates import rfc3339
from newsloom.functions.jsontext import (
    json_number,
    json_value,
    json_word,
    list_layout,
    object_layout,
    pretty_details,
    pretty_list,
    pretty_object,
)
from newsloom.functions.text import CHARS_PER_TOKEN
from newsloom.functions.values import error_object
from newsloom.operators.items import ITEM_COLUMNS
from newsloom.operators.totals import (
    FALLBACK_TEXT,
    UNDATED_TEXT,
    errors_of,
    run_summary,
    truncation_struct,
    warnings_from_counts,
)
from newsloom.params import DEFAULT_TOKEN_BUDGET, FeedParams
from newsloom.plans.fetch import FeedRun, described, rendered_items
from newsloom.schemas import SCHEMA_VERSION
from newsloom.session import scratch_path

# Wording of the bounded report.
TRUNCATION_HINT = "content was truncated; call get_item for the full body of a specific item"
TOO_LARGE_TEXT = (
    "response too large: ~%d tokens exceeds the %d-token budget; "
    "retry with limit=%d or max_content_chars=%d"
)
SUMMARY_FAILED = "fetch_feed: %s returned an error (%s); see structuredContent."
SUMMARY_FETCHED = 'Fetched %d item(s) (~%d content tokens) from "%s".'
SUMMARY_CUT = " Content truncated (see structuredContent.truncation)."
SUMMARY_END = " Full data in structuredContent."
SUMMARY_ITEM = 'Item %s: "%s".'
UNTITLED = "(untitled)"
# Share of the budget for bodies (tenths), safety factor, least body size.
CONTENT_TENTHS, LIMIT_MARGIN, LEAST_CHARS = 7, 0.9, 200

_ITEM_INDENT, _FEED_INDENT = 8, 4


def item_json(indent: int, columns: Mapping[str, Column] | None = None) -> Column:
    """One item of the contract, laid out at ``indent``, from ``columns``, by default those of ``FeedRun.rows``."""
    of = {name: F.col(name) for name in ITEM_COLUMNS} if columns is None else columns

    def strings(name: str) -> Column:
        return pretty_list(of[name], json_value, indent + 2)

    def enclosure(e: Column) -> Column:
        fields = [("url", json_value(e["url"])), ("mime", json_value(e["mime"])), ("length", json_number(e["length"]))]
        return pretty_object(fields, indent + 4)

    special = {
        **{name: json_word(of[name]) for name in ("id", "id_source", "content_format", "content_hash")},
        **{name: json_number(of[name]) for name in ("content_tokens_est", "content_truncated")},
        "published": json_word(rfc3339(of["published"])),
        "updated": json_word(rfc3339(of["updated"])),
        "authors": strings("authors"),
        "categories": strings("categories"),
        "enclosures": pretty_list(of["enclosures"], enclosure, indent + 2),
    }
    return pretty_object(
        [(name, special[name] if name in special else json_value(of[name])) for name in ITEM_COLUMNS], indent
    )


def item_length(indent: int) -> Column:
    """Length of ``item_json``: that of the item as one line of JSON, and what the layout adds to it."""
    instants = ("published", "updated")
    line = F.to_json(
        F.struct(*[rfc3339(c).alias(c) if c in instants else F.col(c) for c in ITEM_COLUMNS]), {"ignoreNullFields": "false"}
    )
    lists = [list_layout(F.size(name), indent + 2) for name in ("authors", "categories", "enclosures")]
    enclosures = F.size("enclosures") * object_layout(3, indent + 4)
    return F.length(line) + object_layout(len(ITEM_COLUMNS), indent) + lists[0] + lists[1] + lists[2] + enclosures


def error_json(error: Column, indent: int) -> Column:
    fields = [(f, json_value(error[f])) for f in ("feed_url", "code", "message")]
    return pretty_object([*fields, ("details", pretty_details(error["details"], indent + 2))], indent)


def feed_json(items: Column, indent: int = _FEED_INDENT) -> Column:
    """One feed of ``FeedRun.feeds`` around an already rendered item list."""
    plain = [
        "feed_url", "status", "from_cache", "title", "site_url", "updated",
        "item_count", "content_tokens_est_total",
    ]
    error = F.when(F.col("error").isNull(), F.lit("null")).otherwise(
        error_json(F.col("error"), indent + 2)
    )
    return pretty_object([*[(c, json_value(c)) for c in plain], ("items", items), ("error", error)], indent)


def warnings_json(indent: int) -> Column:
    """The rendered warning list of one feed row."""

    def one(code: str, text: str, n: str) -> Column:
        values = [
            ("feed_url", json_value("feed_url")),
            ("code", json_value(F.lit(code))),
            ("message", json_value(F.format_string(text, F.col(n)))),
        ]
        return pretty_object(values, indent + 2)

    found = F.array_compact(
        F.array(
            F.when(F.col("n_fell_back") > 0, one("CONTENT_EXTRACTION_FALLBACK", FALLBACK_TEXT, "n_fell_back")),
            F.when((F.col("item_count") > 0) & (F.col("n_dated") == 0), one("UNDATED_ITEMS", UNDATED_TEXT, "item_count")),
        )
    )
    return pretty_list(found, lambda w: w, indent)


def truncation_json(truncation: Column | None, indent: int) -> Column:
    if truncation is None:
        return F.lit("null")
    names = ["applied_limit", "items_content_truncated", "items_omitted", "estimated_tokens", "suggestion"]
    return F.when(truncation.isNull(), F.lit("null")).otherwise(
        pretty_object([(n, json_value(truncation[n])) for n in names], indent)
    )


def tokens_of_chars(chars: Column) -> Column:
    return F.floor((chars + 3) / 4).cast("bigint")


def _one_feed_document(fetched_at: Column, feed: Column, truncation: Column | None) -> Column:
    """A whole report document holding a single feed row."""
    errors = F.when(F.col("error").isNull(), F.lit("[]")).otherwise(
        F.concat(F.lit("[\n    "), error_json(F.col("error"), 4), F.lit("\n  ]"))
    )
    return pretty_object(
        [
            ("schema_version", json_value(F.lit(SCHEMA_VERSION))),
            ("fetched_at", json_value(fetched_at)),
            ("total_items", json_value("item_count")),
            ("total_content_tokens_est", json_value("content_tokens_est_total")),
            ("feeds", F.concat(F.lit("[\n    "), feed, F.lit("\n  ]"))),
            ("errors", errors),
            ("warnings", warnings_json(2)),
            ("truncation", truncation_json(truncation, 2)),
        ],
        0,
    )


def _items_length(n: Column, chars: Column) -> Column:
    """Length of a rendered item list from the summed lengths of its items."""
    pad = 1 + _ITEM_INDENT
    return F.when(n > 0, chars + n * pad + (n - 1) + len("[\n]") + _FEED_INDENT + 2).otherwise(
        len("[]")
    )


def estimate_response_tokens(run: FeedRun, fetched_at: Column) -> DataFrame:
    """``(feed_url, item_count, estimated_tokens)`` of each feed's own report document.

    Item texts are measured where they are and only their lengths are summed, so this holds for
    feeds of any size; so is the document around them, in the feed's own row, which leaves nothing but
    numbers to gather. The documents carry no truncation marker yet when they are measured.
    """
    measured = run.rows.select(
        "request_pos", "feed_url", "pos", F.when(F.col("pos") > 0, item_length(_ITEM_INDENT)).alias("_chars"), *described()
    )
    around = F.length(_one_feed_document(fetched_at, feed_json(F.lit("")), None))
    sizes = measured.select(
        "request_pos", "feed_url", "item_count", "_chars", F.when(F.col("pos") == 0, around).alias("_frame")
    )
    feeds = sizes.groupBy("request_pos", "feed_url").agg(
        F.max("item_count").alias("item_count"), F.sum("_chars").alias("_chars"), F.max("_frame").alias("_frame")
    )
    n, chars, frame = F.col("item_count"), F.coalesce("_chars", F.lit(0)), F.col("_frame")
    return feeds.select(
        "feed_url",
        "item_count",
        tokens_of_chars(frame + _items_length(n, chars)).alias("estimated_tokens"),
    )


def _content_chars(budget: int) -> int:
    """Characters of body text a token budget leaves room for."""
    return budget * CONTENT_TENTHS // 10 * CHARS_PER_TOKEN


def budget_error(tokens: Column, n_items: Column, feed_url: Column, budget: int) -> Column:
    """``RESPONSE_TOO_LARGE`` with retry suggestions when the estimate is over budget, else null."""
    n = F.greatest(n_items, F.lit(1))
    limit = F.greatest(
        F.lit(1),
        F.floor(
            n.cast("double") * F.lit(float(budget)) / tokens.cast("double") * LIMIT_MARGIN
        ).cast("bigint"),
    ).cast("bigint")
    chars = F.greatest(
        F.lit(LEAST_CHARS), F.floor(F.lit(_content_chars(budget)) / n).cast("bigint")
    ).cast("bigint")
    return _too_large(tokens, feed_url, budget, limit, chars)


def item_budget_error(tokens: Column, feed_url: Column, budget: int = DEFAULT_TOKEN_BUDGET) -> Column:
    """The same for a single item's document."""
    chars = max(_content_chars(budget), LEAST_CHARS)
    return _too_large(
        tokens, feed_url, budget, F.lit(1).cast("bigint"), F.lit(chars).cast("bigint")
    )


def _too_large(tokens: Column, feed_url: Column, budget: int, limit: Column, chars: Column) -> Column:
    details = F.to_json(
        F.struct(
            tokens.alias("estimated_tokens"),
            F.lit(budget).cast("bigint").alias("budget_tokens"),
            limit.alias("suggested_limit"),
            chars.alias("suggested_max_content_chars"),
        )
    )
    message = F.format_string(TOO_LARGE_TEXT, tokens, F.lit(budget), limit, chars)
    return F.when(
        tokens > budget, error_object("RESPONSE_TOO_LARGE", message, feed_url, details)
    )


def check_budget(estimates: DataFrame, budget: int = DEFAULT_TOKEN_BUDGET) -> DataFrame:
    """``estimates(feed_url, item_count, estimated_tokens)`` with the budget ``error`` of each."""
    return estimates.withColumn(
        "error",
        budget_error(F.col("estimated_tokens"), F.col("item_count"), F.col("feed_url"), budget),
    )


def item_documents(items: DataFrame, budget: int = DEFAULT_TOKEN_BUDGET) -> DataFrame:
    """``(feed_url, id, document, error, summary)`` per item; over budget gives the error instead."""
    rendered = items.select("feed_url", "id", "title", item_json(0).alias("document"))
    sized = rendered.withColumn("_tokens", tokens_of_chars(F.length("document")))
    checked = sized.withColumn("error", item_budget_error(F.col("_tokens"), F.col("feed_url"), budget))
    summary = F.format_string(SUMMARY_ITEM, "id", F.coalesce("title", F.lit(UNTITLED)))
    ok = F.col("error").isNull()
    return checked.select(
        "feed_url",
        "id",
        F.when(ok, F.col("document")).alias("document"),
        "error",
        F.when(ok, summary).alias("summary"),
    )


def _require_limit(run: FeedRun) -> None:
    if run.params.limit is None:
        raise UsageError(
            "a nested report holds a whole feed in one row and needs a limit; "
            "use the NDJSON outputs for unlimited runs"
        )


@per_session
def _items_text(params: FeedParams) -> Column:
    texts = rendered_items(params, lambda columns: item_json(_ITEM_INDENT, columns))
    return bind(texts, lambda made: pretty_list(made, lambda text: text, _FEED_INDENT + 2))


def feeds_with_items(run: FeedRun) -> DataFrame:
    """``run.feeds()`` plus ``items_text``, the rendered item list, newest first. Needs a limit.

    The limit bounds what a feed's list holds. It is written inside the feed's own row; for a saved run, whose items
    are rows of their own, it comes out of the same aggregation as the totals.
    """
    _require_limit(run)
    if run.own is not None:
        return run.own.select("request_pos", "feed_url", *described(), _items_text(run.params).alias("items_text"))
    item = F.struct(
        F.col("ts").isNull().alias("undated"),
        (-F.unix_micros("ts")).alias("age"),
        F.col("pos").alias("pos"),
        item_json(_ITEM_INDENT).alias("text"),
    )
    feeds = run.feeds(_items=F.collect_list(F.when(F.col("pos") > 0, item)))
    in_order = F.transform(F.array_sort("_items"), lambda i: i["text"])
    return feeds.withColumn(
        "items_text", pretty_list(in_order, lambda text: text, _FEED_INDENT + 2)
    ).drop("_items")


def feed_reports(run: FeedRun, fetched_at: Column) -> DataFrame:
    """``(request_pos, feed_url, document)``: one report document per feed. Needs a limit."""
    return feeds_with_items(run).select(
        "request_pos",
        "feed_url",
        _one_feed_document(fetched_at, feed_json(F.col("items_text")), None).alias("document"),
    )


def bounded_reports(
    run: FeedRun, fetched_at: Column, budget: int = DEFAULT_TOKEN_BUDGET
) -> DataFrame:
    """``(request_pos, feed_url, document, error, summary)``: reports within a token budget.

    Made for runs with ``limit=DEFAULT_ITEM_CAP``. A report over budget is replaced by the
    error; one with cut bodies gets the truncation marker.
    """
    feeds = feeds_with_items(run)
    # The size is that of the document without items plus theirs, so a document is only written once.
    frame = F.length(_one_feed_document(fetched_at, feed_json(F.lit("")), None))
    sized = feeds.withColumn("_tokens", tokens_of_chars(frame + F.length("items_text")))
    marker = truncation_struct(
        F.col("n_cut"), F.lit(run.params.limit), F.col("_tokens"), F.lit(TRUNCATION_HINT)
    )
    full = _one_feed_document(fetched_at, feed_json(F.col("items_text")), marker)
    sized = sized.withColumn(
        "_over", budget_error(F.col("_tokens"), F.col("item_count"), F.col("feed_url"), budget)
    )
    ok = F.col("_over").isNull()
    return sized.select(
        "request_pos",
        "feed_url",
        F.when(ok, full).alias("document"),
        F.col("_over").alias("error"),
        F.when(ok, report_summary()).alias("summary"),
    )


def report_summary() -> Column:
    """One line about a feed row of ``FeedRun.feeds``."""
    failed = F.format_string(SUMMARY_FAILED, F.col("feed_url"), F.col("error")["code"])
    fetched = F.concat(
        F.format_string(
            SUMMARY_FETCHED,
            F.col("item_count"),
            F.col("content_tokens_est_total"),
            F.coalesce("title", "feed_url"),
        ),
        F.when(F.col("n_cut") > 0, F.lit(SUMMARY_CUT)).otherwise(F.lit("")),
        F.lit(SUMMARY_END),
    )
    return F.when(F.col("error").isNotNull(), failed).otherwise(fetched)


def _stored(df: DataFrame) -> DataFrame:
    """Write a table that several outputs read, and continue from it."""
    path = scratch_path(df.sparkSession, "report")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def report_lines(run: FeedRun, fetched_at: Column, applied_limit: int | None = None) -> DataFrame:
    """The whole run as one JSON document in ordered text fragments ``(section, request_pos, seq, text)``.

    Sorted by the first three columns and written as text, the fragments are the nested document:
    feeds in request order, items newest first. No row holds more than one (bounded) feed.
    """
    feeds = _stored(feeds_with_items(run))
    head_pos = feeds.agg(F.max("request_pos")).scalar()

    def comma(is_last: Column) -> Column:
        return F.when(is_last, F.lit("")).otherwise(F.lit(","))

    def fragment(df: DataFrame, section: int, seq: Column | int, text: Column, pos: Column | None = None) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"),
            (pos if pos is not None else F.lit(0)).cast("bigint").alias("request_pos"),
            (seq if isinstance(seq, Column) else F.lit(seq)).cast("bigint").alias("seq"),
            text.alias("text"),
        )

    summary = run_summary(feeds, fetched_at)
    heads = F.concat(
        F.lit("{\n  \"schema_version\": "), json_value("schema_version"),
        F.lit(',\n  "fetched_at": '), json_value("fetched_at"),
        F.lit(',\n  "total_items": '), json_value("total_items"),
        F.lit(',\n  "total_content_tokens_est": '), json_value("total_content_tokens_est"),
        F.lit(',\n  "feeds": ['),
    )
    feed_text = F.concat(
        F.lit("    "), feed_json(F.col("items_text")), comma(F.col("request_pos") == head_pos)
    )
    errors = errors_of(feeds)
    last_error = errors.agg(F.max("request_pos")).scalar()
    error = F.struct("feed_url", "code", "message", "details")
    error_text = F.concat(
        F.lit("    "), bind(error, lambda e: error_json(e, 4)), comma(F.col("request_pos") == last_error)
    )
    warnings = warnings_from_counts(feeds.withColumnRenamed("item_count", "n")).withColumn("_seq", F.col("code").eqNullSafe("UNDATED_ITEMS").cast("bigint"))
    warn_order = F.struct("request_pos", "_seq")
    last_warning = warnings.agg(F.max(warn_order)).scalar()
    warning_text = F.concat(
        F.lit("    "),
        pretty_object([(c, json_value(c)) for c in ("feed_url", "code", "message")], 4),
        comma(warn_order == last_warning),
    )
    marker = truncation_struct(F.col("n_cut"), F.lit(applied_limit), F.lit(None), F.lit(None))
    tail = F.concat(F.lit("  ],\n  \"truncation\": "), truncation_json(marker, 2), F.lit("\n}"))
    parts = [
        fragment(summary, 0, 0, heads),
        fragment(feeds, 1, 0, feed_text, F.col("request_pos")),
        fragment(summary, 2, 0, F.lit('  ],\n  "errors": [')),
        fragment(errors, 3, 0, error_text, F.col("request_pos")),
        fragment(summary, 4, 0, F.lit('  ],\n  "warnings": [')),
        fragment(warnings, 5, F.col("_seq"), warning_text, F.col("request_pos")),
        fragment(summary, 6, 0, tail),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_report(run: FeedRun, fetched_at: Column, path: str) -> None:
    """Write ``report_lines`` as ordered text files that concatenate to the document."""
    lines = report_lines(run, fetched_at).orderBy("section", "request_pos", "seq")
    lines.select("text").write.mode("overwrite").text(path)


"""The main job: captured feed documents to items, feeds, warnings, errors and totals.

A feed is one document, so everything about its items can be decided inside its row: the since
filter, the newest-first order and the limit work on the parsed array before it is exploded, and so do the bodies
and the totals over them. The job is therefore a single narrow stage (scan, parse once, select, bodies
and totals of the survivors, explode, then links and ids), with no shuffle at all. The same plan runs
on a stream.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.base import bind, per_session
from newsloom.functions.dates import effective_ts, parse_feed_date, rfc3339
from newsloom.functions.identity import content_hash, id_source, item_id
from newsloom.functions.text import (
    content_source,
    estimate_tokens,
    extract_content,
    is_over,
    truncate_chars,
)
from newsloom.functions.urls import resolve_or_keep
from newsloom.functions.values import error_object
from newsloom.operators import totals
from newsloom.operators.items import ITEM_COLUMNS
from newsloom.params import FeedParams
from newsloom.schemas import ERROR
from newsloom.session import scratch_path, spread
from newsloom.sources.feeds import parse_documents

ERROR_DDL = ERROR.simpleString()


@per_session
def _feed_updated() -> Column:
    return parse_feed_date(F.col("feed")["updated_text"])


@per_session
def select_entries(entries: str, params: FeedParams) -> Column:
    """Since filter and newest-N of one document's entries (the name of their column).

    Gives ``array<struct<undated, age, pos, published, updated, entry>>``: newest first when a
    limit is set, else in document order.
    """

    def dated(entry: Column, index: Column) -> Column:
        instants = F.struct(
            parse_feed_date(entry["published_text"]).alias("published"),
            parse_feed_date(entry["updated_text"]).alias("updated"),
        )

        def build(at: Column) -> Column:
            ts = effective_ts(at["published"], at["updated"])
            return F.struct(
                ts.isNull().alias("undated"),
                (-F.unix_micros(ts)).alias("age"),
                (index + 1).cast("bigint").alias("pos"),
                at["published"].alias("published"),
                at["updated"].alias("updated"),
                entry.alias("entry"),
            )

        return bind(instants, build)

    rows = F.transform(F.col(entries), dated)
    if params.since is not None:
        newest_age = -F.unix_micros(F.lit(params.since))
        rows = F.filter(rows, lambda r: r["undated"] | (r["age"] <= newest_age))
    if params.limit is not None:
        # Sorting on (undated, age, pos): newest first, undated last, ties in document order.
        rows = F.slice(F.array_sort(rows), 1, params.limit)
    return rows


#: Columns of documents that their rows keep.
CARRIED = ("fetched_at", "wanted")
#: What the own row of a feed (position 0) knows of its items.
FEED_COUNTS = ("n_items", "n_dated", "n_fell_back", "n_cut", "n_tokens")


def with_bodies(rows: Column, params: FeedParams) -> Column:
    """The selected entries with ``whole``, their body in the wanted format, and ``fell_back``."""

    def one(row: Column) -> Column:
        entry = row["entry"]
        if params.content_format == "none":
            source = F.lit(None).cast("string")
        else:
            source = content_source(entry["body"], entry["summary"])
        kept = [row[f].alias(f) for f in ("undated", "age", "pos", "published", "updated", "entry")]
        return bind(
            bind(source, lambda s: extract_content(s, params.content_format)),
            lambda x: F.struct(*kept, x["content"].alias("whole"), F.coalesce(x["fell_back"], F.lit(False)).alias("fell_back")),
        )

    return F.transform(rows, one)


def counted(rows: Column, params: FeedParams) -> Column:
    """``struct(rows, FEED_COUNTS)``: the entries of a feed and the totals over them."""
    cut = params.max_content_chars
    tokens = F.aggregate(
        F.transform(rows, lambda r: estimate_tokens(truncate_chars(r["whole"], cut))), F.lit(0).cast("bigint"), lambda n, t: n + t
    )

    def n(test) -> Column:
        return F.size(F.filter(rows, test)).cast("bigint")

    counts = [
        F.size(rows).cast("bigint"), n(lambda r: ~r["undated"]), n(lambda r: r["fell_back"]), n(lambda r: is_over(r["whole"], cut)), tokens,
    ]
    return F.struct(rows.alias("rows"), *[c.alias(name) for c, name in zip(counts, FEED_COUNTS, strict=True)])


@per_session
def _items(entries: str, params: FeedParams) -> Column:
    return bind(with_bodies(select_entries(entries, params), params), lambda rows: counted(rows, params))


def _n_items(params: FeedParams) -> Column:
    """Number of selected entries; without a since filter it is known before any entry is looked at."""
    if params.since is not None:
        return F.col("_items")["n_items"]
    return F.col("n_entries") if params.limit is None else F.least("n_entries", F.lit(params.limit).cast("bigint"))


def parsed_requests(documents: DataFrame, params: FeedParams) -> DataFrame:
    """One row per request: its error, status, feed and selected entries with the totals over them."""
    have = documents.columns
    carried = [c for c in CARRIED if c in have]
    fetch_error = F.col("fetch_error") if "fetch_error" in have else F.lit(None).cast(ERROR_DDL)
    parse_error = F.when(
        F.col("parse_error").isNotNull(),
        error_object(
            "FEED_PARSE_FAILED",
            F.concat(F.lit("feed parse error: "), F.col("parse_error")),
            "feed_url",
        ),
    )
    return parse_documents(documents).select(
        F.col("request_pos") if "request_pos" in have else F.lit(0).cast("bigint").alias("request_pos"),
        "feed_url",
        *carried,
        F.coalesce(fetch_error, parse_error).alias("error"),
        (F.col("status") if "status" in have else F.lit("ok")).alias("status"),
        (F.col("from_cache") if "from_cache" in have else F.lit(False)).alias("from_cache"),
        _items("entries", params).alias("_items"),
        "n_entries",
        _feed_updated().alias("_updated"),
        F.col("feed").alias("_entry"),
    )


def _counts(params: FeedParams) -> list[Column]:
    """``FEED_COUNTS`` of the rows of ``parsed_requests``."""
    return [_n_items(params).alias("n_items"), *[F.col("_items")[name].alias(name) for name in FEED_COUNTS[1:]]]


def feed_rows(parsed: DataFrame, params: FeedParams) -> DataFrame:
    """The own rows of the feeds (``pos`` 0 of ``FeedRun.rows``), without the entries that rows hold beside them."""
    failed = F.col("error").isNotNull()
    return parsed.select(
        "request_pos",
        "feed_url",
        "error",
        F.when(failed, F.lit("error")).otherwise(F.col("status")).alias("status"),
        (F.col("from_cache") & ~failed).alias("from_cache"),
        *_counts(params),
        F.col("_entry")["title"].alias("title"),
        F.col("_entry")["link"].alias("url"),
        F.col("_updated").alias("updated"),
        F.col("_items")["rows"].alias("_rows"),
    )


def rendered_items(params: FeedParams, render: Callable[[dict[str, Column]], Column]) -> Column:
    """What ``render`` makes of the item columns of each selected entry of ``feed_rows``, as an array.

    The columns are those of ``complete_records``, made inside the feed's row.
    """
    feed_url, cut = F.col("feed_url"), params.max_content_chars

    def one(row: Column) -> Column:
        entry, whole = row["entry"], row["whole"]

        def build(made: Column) -> Column:
            url = made["url"]
            return render(
                {
                    **{name: entry[name] for name in ("title", "guid", "authors", "categories", "summary", "enclosures")},
                    **{name: row[name] for name in ("published", "updated")},
                    "feed_url": feed_url,
                    "url": url,
                    "id": item_id(feed_url, url, entry["guid"], entry["title"], rfc3339(row["published"])),
                    "id_source": id_source(url, entry["guid"]),
                    "content": made["content"],
                    "content_hash": content_hash(whole),
                    "content_truncated": is_over(whole, cut),
                    "content_tokens_est": estimate_tokens(made["content"]),
                    "content_format": F.lit(params.content_format),
                }
            )

        made = F.struct(resolve_or_keep(feed_url, entry["link"]).alias("url"), truncate_chars(whole, cut).alias("content"))
        return bind(made, build)

    return F.transform(F.col("_rows"), one)


def feed_records(parsed: DataFrame, params: FeedParams) -> DataFrame:
    """Selected rows with instants: row 0 of a feed carries its status and error, the rest entries."""
    carried = [c for c in CARRIED if c in parsed.columns]
    own = F.struct(
        F.lit(False).alias("undated"),
        F.lit(None).cast("bigint").alias("age"),
        F.lit(0).cast("bigint").alias("pos"),
        F.lit(None).cast("timestamp").alias("published"),
        F.col("_updated").alias("updated"),
        F.col("_entry").alias("entry"),
        F.lit(None).cast("string").alias("whole"),
        F.lit(False).alias("fell_back"),
    )
    # The outer form keeps the optimizer from adding a size filter that would parse bodies twice.
    rows = parsed.select(
        *[c for c in parsed.columns if not c.startswith("_") and c != "n_entries"],
        *_counts(params),
        F.explode_outer(F.concat(F.array(own), F.col("_items")["rows"])).alias("_r"),
    )
    is_feed = F.col("_r")["pos"] == 0
    failed = F.col("error").isNotNull()
    entry = F.col("_r")["entry"]
    return rows.select(
        "request_pos",
        "feed_url",
        *carried,
        F.col("_r")["pos"].alias("pos"),
        F.when(is_feed, F.col("error")).alias("error"),
        F.when(is_feed, F.when(failed, F.lit("error")).otherwise(F.col("status"))).alias("status"),
        F.when(is_feed, F.col("from_cache") & ~failed).alias("from_cache"),
        *[F.when(is_feed, F.col(name)).alias(name) for name in FEED_COUNTS],
        *[
            entry[name].alias(name)
            for name in ("title", "link", "guid", "authors", "categories", "summary", "enclosures")
        ],
        F.col("_r")["whole"].alias("whole"),
        F.col("_r")["fell_back"].alias("fell_back"),
        F.col("_r")["published"].alias("published"),
        F.col("_r")["updated"].alias("updated"),
        effective_ts(F.col("_r")["published"], F.col("_r")["updated"]).alias("ts"),
    )


def complete_records(records: DataFrame, params: FeedParams) -> DataFrame:
    """Permalink, identity and body columns. Row 0 keeps the raw site link and gets no identity."""
    is_item = F.col("pos") > 0
    linked = records.withColumns(
        {
            "url": F.when(is_item, resolve_or_keep("feed_url", "link")).otherwise(F.col("link")),
            "content_hash": content_hash("whole"),
        }
    ).drop("link")
    cut = params.max_content_chars
    bodied = linked.withColumns(
        {
            "_published": rfc3339("published"),
            "content": truncate_chars("whole", cut),
            "content_truncated": is_over("whole", cut),
        }
    ).drop("whole")
    return bodied.withColumns(
        {
            "content_tokens_est": estimate_tokens("content"),
            "content_format": F.lit(params.content_format),
            "id": F.when(is_item, item_id("feed_url", "url", "guid", "title", "_published")),
            "id_source": F.when(is_item, id_source("url", "guid")),
        }
    ).drop("_published")


def described() -> list[Column]:
    """What ``FeedRun.feeds`` tells of a feed, from its own row."""
    return [
        F.col("status"),
        F.col("from_cache"),
        F.col("title"),
        F.col("url").alias("site_url"),
        rfc3339("updated").alias("updated"),
        F.col("n_items").alias("item_count"),
        F.col("n_tokens").alias("content_tokens_est_total"),
        F.col("error"),
        F.col("n_cut"),
        F.col("n_fell_back"),
        F.col("n_dated"),
    ]


@dataclass(frozen=True)
class FeedRun:
    """One run over a set of feeds, all outputs derived from ``rows``.

    Every output is a lazy DataFrame; using several of them would parse the documents again, so
    :meth:`saved` writes the rows once and continues from that table.
    """

    rows: DataFrame
    params: FeedParams
    is_saved: bool = False
    #: ``feed_rows`` of the same documents, for outputs without items; by default they are taken from ``rows``.
    own: DataFrame | None = None

    def saved(self, path: str | None = None) -> "FeedRun":
        """Write the rows as a table (by default in the shared folder) and continue from it."""
        if self.is_saved:
            return self
        spark = self.rows.sparkSession
        path = path or scratch_path(spark, "feed-rows")
        self.rows.write.mode("overwrite").parquet(path)
        return FeedRun(spark.read.schema(self.rows.schema).parquet(path), self.params, True)

    def items(self) -> DataFrame:
        """Item columns plus ``request_pos``, ``pos``, ``ts``, ``fell_back`` for ordering and warnings."""
        carried = [c for c in CARRIED if c in self.rows.columns]
        return self.rows.where(F.col("pos") > 0).select(
            *ITEM_COLUMNS, "request_pos", "pos", "ts", "fell_back", *carried
        )

    def own_rows(self) -> DataFrame:
        """The feeds' own rows. Unless the run is saved, the entries are not laid out beside them."""
        return self.rows.where(F.col("pos") == 0) if self.own is None else self.own

    def feeds(self, **extra: Column) -> DataFrame:
        """One row per request: its description, error, totals and the counts warnings need.

        All of that stands in the feed's own row, so nothing is grouped; only ``extra`` aggregates over the
        feed's rows are.
        """
        own = self.own_rows()
        head = ["status", "from_cache", "title", "url", "updated", "error", *FEED_COUNTS]
        if extra:
            is_own = F.col("pos") == 0
            own = self.rows.groupBy("request_pos", "feed_url").agg(
                F.max_by(F.when(is_own, F.struct(*head)), F.when(is_own, F.lit(1))).alias("_head"),
                *[aggregate.alias(name) for name, aggregate in extra.items()],
            )
            own = own.select("request_pos", "feed_url", "_head.*", *extra)
        return own.select("request_pos", "feed_url", *described(), *extra)

    def errors(self) -> DataFrame:
        """Feed errors, straight from the feed rows (no aggregation)."""
        return totals.errors_of(self.own_rows())

    def warnings(self) -> DataFrame:
        return totals.warnings_from_counts(self.feeds().withColumnRenamed("item_count", "n"))

    def summary(self, fetched_at: Column) -> DataFrame:
        return totals.run_summary(self.feeds(), fetched_at)

    def status(self) -> DataFrame:
        return totals.run_status(self.own_rows())


def fetch(documents: DataFrame, params: FeedParams = FeedParams()) -> FeedRun:
    """Run over ``documents(request_pos, feed_url, body, …)``, one document per request; several
    requests of one feed are kept apart.

    The output of ``operators.snapshots.resolve_fetch`` fits as it is: its status, cache flag and
    error columns are carried through.
    """
    parsed = parsed_requests(spread(documents), params)
    return FeedRun(complete_records(feed_records(parsed, params), params), params, own=feed_rows(parsed, params))

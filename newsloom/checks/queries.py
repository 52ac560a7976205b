"""One query per operator, each over whole supplied tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.checks import fixtures as fx
from newsloom.functions import dates, identity, text, urls, values
from newsloom.operators import discovery, hosts, items as item_ops, seeds, snapshots, totals
from newsloom.params import DEFAULT_ITEM_CAP, FeedParams
from newsloom.plans.fetch import FeedRun, fetch
from newsloom.plans.lookup import show_items
from newsloom.schemas import check_contracts, contract
from newsloom.session import apply_runtime_conf, scratch_path, spread
from newsloom.sinks import records, report
from newsloom.sinks.tables import ChangeTable, SnapshotTable
from newsloom.sources.feeds import parse_feeds
from newsloom.sources import tables
from newsloom.sources.tables import opml_urls
from newsloom.streaming import pipelines

MID_JANUARY = datetime(2024, 1, 15, tzinfo=timezone.utc)
MONTH_END = datetime(2024, 1, 31, tzinfo=timezone.utc)
STAMP = "2024-01-31T00:00:00Z"

Query = Callable[[SparkSession, str], DataFrame]


# --- columns ---------------------------------------------------------------------------------


def item_identity(spark: SparkSession, sf: str) -> DataFrame:
    items = fx.identified(fx.document_items(spark, sf))
    return items.select("doc_id", "id", "id_source", identity.snapshot_key("feed_url").alias("feed_key"))


def content_columns(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.document_items(spark, sf)
    body = F.when(F.col("lang") == "de", F.lit(" \n ")).otherwise(F.col("text"))
    picked = docs.select("doc_id", text.content_source(body, "source").alias("whole"))
    cut = picked.select(
        "doc_id",
        text.truncate_chars("whole", 200).alias("content"),
        text.is_over("whole", 200).alias("content_truncated"),
        identity.content_hash("whole").alias("content_hash"),
    )
    return cut.withColumn("content_tokens_est", text.estimate_tokens("content"))


def feed_dates(spark: SparkSession, sf: str) -> DataFrame:
    kind, ts = F.col("event_type"), F.col("ts")
    mail = F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss")
    shown = (
        F.when(kind == "view", F.concat(mail, F.lit(" GMT")))
        .when(kind == "click", F.concat(mail, F.lit(" +0200")))
        .when(kind == "error", F.concat(F.date_format(ts, "d MMM yy HH:mm"), F.lit(" EST")))
        .when(kind == "signup", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .otherwise(F.concat(F.lit("not a date "), mail))
    )
    parsed = fx.table(spark, sf, "events").select(
        "event_id",
        dates.parse_feed_date(shown).alias("p"),
        dates.parse_feed_date(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'-01:00'")).alias("u"),
    )
    return parsed.select(
        "event_id",
        dates.rfc3339("p").alias("published"),
        dates.rfc3339(dates.effective_ts("p", "u")).alias("effective"),
    )


def enclosures_links(spark: SparkSession, sf: str) -> DataFrame:
    lang, doc = F.col("lang"), F.col("doc_id").cast("string")

    def link(href: Column, rel: str | None, kind: str | None = None, size: Column | None = None) -> Column:
        return F.struct(
            href.alias("href"),
            F.lit(rel).cast("string").alias("rel"),
            F.lit(kind).cast("string").alias("type"),
            (size if size is not None else F.lit(None)).cast("string").alias("length"),
        )

    links = F.array(
        link(F.concat(F.lit("/self/"), doc), "self"),
        link(F.concat(F.lit("/alt/"), doc), None),
        link(F.concat(F.lit("/page/"), doc), "alternate"),
        link(F.when(lang == "de", F.lit("")).otherwise(F.concat(F.lit("/a/"), doc)), "enclosure", "audio/mpeg", F.col("n_chars")),
    )
    links = F.when(lang == "fr", F.slice(links, 1, 2)).when(lang == "es", F.slice(links, 1, 0)).otherwise(links)
    media = F.array(
        F.struct(
            F.when(lang != "fr", F.concat(F.lit("/m/"), doc)).alias("url"),
            F.lit("video/mp4").alias("type"),
            F.lit("many").alias("length"),
        )
    )
    people = F.array(F.concat(F.col("source"), F.lit("@x.org ("), F.col("source"), F.lit(")")), F.col("lang"))
    shaped = fx.table(spark, sf, "documents").select(
        "doc_id",
        values.pick_link(links).alias("link"),
        F.array_join(values.names(F.when(lang != "es", people)), "|").alias("authors"),
        F.array_join(values.terms(F.when(lang != "es", F.array("lang", "source"))), "|").alias("categories"),
        F.posexplode_outer(values.collect_enclosures(media, links)).alias("pos", "e"),
    )
    return shaped.select("doc_id", "link", "authors", "categories", "pos", "e.url", "e.mime", "e.length")


def strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    return spread(fx.table(spark, sf, "pages")).select("page_id", text.strip_tags("html").alias("content"))


def to_text(spark: SparkSession, sf: str) -> DataFrame:
    return spread(fx.table(spark, sf, "pages")).select("page_id", text.to_text("html").alias("content"))


def to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    made = text.extract_content("html", "markdown")
    return spread(fx.table(spark, sf, "pages")).select("page_id", made.alias("x")).select("page_id", "x.content", "x.fell_back")


def nested_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Every text as a quote around a numbered list of its lines, each with a list of its own."""
    item = lambda line, i: F.concat(
        F.lit("<li>"), fx.xml_escape(line), F.lit("<ul><li>n"), (i + 1).cast("string"), F.lit("</li></ul></li>")
    )
    html = F.concat(
        F.lit("<blockquote>\ue000"), F.col("source"), F.lit("<ol>"), F.array_join(F.transform(F.split("text", "\n"), item), ""), F.lit("</ol></blockquote>")
    )
    return spread(fx.table(spark, sf, "documents")).select("doc_id", text.to_markdown(html).alias("content"))


def resolve_links(spark: SparkSession, sf: str) -> DataFrame:
    hrefs = F.regexp_extract_all("html", F.lit(r'<a\b[^>]*?\bhref="([^"]*)"'), F.lit(1))
    anchors = spread(fx.table(spark, sf, "pages")).select("page_id", "url", F.posexplode(hrefs).alias("pos", "href"))
    return anchors.select("page_id", "pos", "href", urls.resolve_or_keep("url", "href").alias("resolved"))


def authority(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "pages").select(
        "page_id",
        urls.authority("url").alias("authority"),
        urls.authority(F.regexp_replace("url", "^https?://", "")).alias("bare"),
    )


def durations(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    unit = F.when(kind == "view", "s").when(kind == "click", "m").when(kind == "error", "h").when(kind == "signup", "d").otherwise("x")
    spelled = F.concat(F.lit(" "), F.col("event_id").cast("string"), unit)
    since = F.when(kind == "purchase", F.date_format("ts", "yyyy-MM-dd")).otherwise(spelled)
    return fx.table(spark, sf, "events").select(
        "event_id",
        dates.parse_duration(spelled).alias("seconds"),
        dates.rfc3339(dates.parse_since(since, F.lit(MONTH_END))).alias("since"),
    )


def lenient_int(spark: SparkSession, sf: str) -> DataFrame:
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    given = (
        F.when(kind == "view", k)
        .when(kind == "click", F.concat(F.lit('" '), k, F.lit(' "')))
        .when(kind == "error", F.concat(k, F.lit(".0")))
        .when(kind == "signup", F.concat(F.lit("-"), k, F.lit(".5")))
        .otherwise(F.lit('""'))
    )
    return fx.table(spark, sf, "events").select("event_id", values.lenient_int(given).alias("i")).select(
        "event_id", "i.value", "i.is_error"
    )


def content_format(spark: SparkSession, sf: str) -> DataFrame:
    given = F.concat(
        F.lit(" "),
        F.when(F.col("event_type") == "view", F.lit("Markdown"))
        .when(F.col("event_type") == "click", F.lit("TEXT"))
        .otherwise(F.col("event_type")),
        F.lit("\t"),
    )
    return fx.table(spark, sf, "events").select("event_id", values.parse_content_format(given).alias("content_format"))


def retry_after(spark: SparkSession, sf: str) -> DataFrame:
    kind, ts = F.col("event_type"), F.col("ts")
    header = (
        F.when(kind == "view", F.floor(F.col("value")).cast("string"))
        .when(kind == "click", F.date_format(hosts.plus_seconds(ts, F.lit(90)), "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(kind == "signup", F.date_format(hosts.plus_seconds(ts, F.lit(-90)), "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(kind == "error", F.lit("soon"))
    )
    whole = F.date_trunc("second", ts)
    return fx.table(spark, sf, "events").select("event_id", dates.retry_after_seconds(header, whole).alias("seconds"))


# --- parsing ---------------------------------------------------------------------------------


def _parsed(spark: SparkSession, sf: str, form: str) -> DataFrame:
    entries = parse_feeds(spread(fx.feed_documents(spark, sf, form))).where(F.col("pos") > 0)
    return entries.select(
        F.col("request_pos").alias("doc_id"),
        "pos",
        "title",
        "link",
        "guid",
        dates.rfc3339(dates.parse_feed_date(F.coalesce("published_text", "updated_text"))).alias("dated"),
        F.array_join("authors", "|").alias("authors"),
        F.array_join("categories", "|").alias("categories"),
        F.coalesce("body", "summary", F.lit("")).alias("body"),
        F.get("enclosures", F.lit(0))["url"].alias("enclosure"),
        F.get("enclosures", F.lit(0))["length"].alias("length"),
    )


def parse_rss(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf, "rss")


def parse_atom(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf, "atom")


def parse_jsonfeed(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf, "json")


def parse_namespaces(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies under a prefix that only their own element binds, with the like of it inside CDATA."""
    docs = fx.feed_documents(spark, sf, "rss")
    opened = '<x1:encoded xmlns:x1="http://purl.org/rss/1.0/modules/content/"><![CDATA[<x1:b>'
    body = F.replace(F.replace("body", F.lit("<description>"), F.lit(opened)), F.lit("</description>"), F.lit("]]></x1:encoded>"))
    entries = parse_feeds(docs.withColumn("body", body)).where(F.col("pos") > 0)
    return entries.select(F.col("request_pos").alias("doc_id"), "pos", "body")


def parse_errors(spark: SparkSession, sf: str) -> DataFrame:
    run = fetch(fx.feed_documents(spark, sf, "mixed"), FeedParams(content_format="none"))
    return run.errors().select("feed_url", "code", "details")


# --- the whole job -----------------------------------------------------------------------------


def _run(spark: SparkSession, sf: str, **params) -> FeedRun:
    settings = {"content_format": "html", **params}
    return fetch(fx.feed_documents(spark, sf, "mixed"), FeedParams(**settings))


def _shown_items(run: FeedRun) -> DataFrame:
    items = run.items()
    return item_ops.contract_items(items).select(
        "feed_url", "id", "id_source", "title", "url", "guid", "published", "updated", "content",
        "content_tokens_est", "content_truncated", "content_hash",
    )


def fetch_items(spark: SparkSession, sf: str) -> DataFrame:
    return _shown_items(_run(spark, sf))


def fetch_truncated(spark: SparkSession, sf: str) -> DataFrame:
    return _shown_items(_run(spark, sf, max_content_chars=2000))


def fetch_since(spark: SparkSession, sf: str) -> DataFrame:
    run = _run(spark, sf, since=MID_JANUARY, limit=None, content_format="none")
    return run.items().select("feed_url", "guid", "content")


def fetch_feeds(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).feeds().select(
        "request_pos", "feed_url", "status", "from_cache", "title", "site_url", "item_count",
        "content_tokens_est_total", F.col("error")["code"].alias("error_code"), "n_cut",
    )


def fetch_captures(spark: SparkSession, sf: str) -> DataFrame:
    """Two captures of every feed in one run: a row for each request, none merged."""
    docs = fx.feed_documents(spark, sf, "mixed")
    twice = F.explode(F.array(F.col("request_pos"), F.col("request_pos") + 1_000_000_000))
    run = fetch(docs.withColumn("request_pos", twice), FeedParams(content_format="none"))
    return run.feeds().select("request_pos", "feed_url", "item_count", F.col("error")["code"].alias("error_code"))


def fetch_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).summary(F.lit(STAMP))


def fetch_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """The default job: newest 25 items per feed with markdown bodies, totals per feed."""
    run = fetch(fx.feed_documents(spark, sf, "rss"), FeedParams(limit=DEFAULT_ITEM_CAP))
    return run.feeds().select("feed_url", "status", "item_count", "content_tokens_est_total")


# --- readers ---------------------------------------------------------------------------------


def read_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Feed documents through the reader of captured documents."""
    path = scratch_path(spark, "feed-documents")
    docs = fx.feed_documents(spark, sf, "mixed")
    docs.withColumns({"content_type": F.lit("text/xml"), "fetched_at": F.lit(MID_JANUARY)}).write.parquet(path)
    run = fetch(tables.read_feed_documents(spark, path), FeedParams(content_format="none"))
    shown = run.items().groupBy("request_pos", "feed_url", "fetched_at").agg(F.count("*").alias("n"))
    return shown.select("request_pos", "feed_url", dates.rfc3339("fetched_at").alias("fetched_at"), "n")


def read_body_files(spark: SparkSession, sf: str) -> DataFrame:
    """One file per source, an RSS feed of its documents' guids, through the reader of raw files."""
    docs = fx.table(spark, sf, "documents")
    lines = docs.select(
        "source",
        "doc_id",
        F.concat(F.lit("<item><guid>g"), F.col("doc_id").cast("string"), F.lit("</guid><title>"), fx.xml_escape(F.col("text")), F.lit("</title></item>")).alias("line"),
    )
    ends = docs.select("source").distinct()
    first = ends.select("source", F.lit(-1 << 62).alias("doc_id"), F.lit("<rss><channel>").alias("line"))
    last = ends.select("source", F.lit(1 << 62).alias("doc_id"), F.lit("</channel></rss>").alias("line"))
    path = scratch_path(spark, "body-files")
    whole = lines.unionByName(first).unionByName(last).repartition("source").sortWithinPartitions("source", "doc_id")
    whole.select("source", "line").write.partitionBy("source").text(path)
    bodies = tables.read_body_files(spark, f"{path}/source=*")
    run = fetch(bodies, FeedParams(content_format="none"))
    source = F.regexp_extract("feed_url", "source=([^/]*)/", 1)
    return run.items().select("request_pos", source.alias("source"), "pos", "guid")


def read_url_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Page urls in seven lists with comments and blank lines, through the list reader."""
    pages = fx.table(spark, sf, "pages").select("page_id", F.pmod("page_id", F.lit(7)).alias("list"), "url")
    line = F.when(F.col("url").contains("?"), F.concat(F.lit(" # "), "url")).otherwise(F.concat(F.lit("\t"), "url", F.lit("\n")))
    path = scratch_path(spark, "url-lists")
    in_order = pages.repartition("list").sortWithinPartitions("list", "page_id")
    in_order.select("list", line.alias("line")).write.partitionBy("list").text(path)
    listed = tables.read_url_list(spark, f"{path}/list=*")
    return listed.select(F.regexp_extract("file", "list=([0-9]+)", 1).cast("bigint").alias("list"), F.col("pos").cast("bigint").alias("pos"), "url")


def read_pages_query(spark: SparkSession, sf: str) -> DataFrame:
    """Pages through their reader, in the order of a report, with their feeds."""
    path = scratch_path(spark, "pages")
    fx.pages_with_links(spark, sf).select("url", "html").write.parquet(path)
    return discovery.discover_feeds(tables.read_pages(spark, path)).select("site_url", "pos", "url", "feed_type")


# --- filters, order, joins -------------------------------------------------------------------


def _event_items(spark: SparkSession, sf: str) -> DataFrame:
    events = fx.table(spark, sf, "events")
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("feed_url"),
        "event_id",
        F.col("event_id").alias("pos"),
        F.when(F.col("event_type") != "signup", F.col("ts")).alias("ts"),
    )


def since(spark: SparkSession, sf: str) -> DataFrame:
    return item_ops.since_filter(_event_items(spark, sf), MID_JANUARY).select("event_id")


def newest_n(spark: SparkSession, sf: str) -> DataFrame:
    return item_ops.newest_n(_event_items(spark, sf), 5, rank="item_pos").select(
        "feed_url", "event_id", F.col("item_pos").cast("bigint").alias("item_pos")
    )


def item_positions(spark: SparkSession, sf: str) -> DataFrame:
    return item_ops.item_positions(_event_items(spark, sf)).select("feed_url", "event_id", "item_pos")


def merge_sources(spark: SparkSession, sf: str) -> DataFrame:
    pages = fx.table(spark, sf, "pages")
    pos = F.col("page_id").alias("pos")
    direct = pages.where(F.col("url").startswith("https://")).select(pos, F.concat(F.lit(" "), F.col("url")).alias("url"))
    kind = F.when(F.col("url").contains("?"), F.concat(F.lit("# "), F.col("url"))).otherwise(F.concat(F.col("url"), F.lit("\r")))
    listed = pages.select(pos, kind.alias("url"))
    outline = F.concat(
        F.lit('<opml version="2.0"><body><outline text="a"><!-- <outline xmlUrl="x"/> --><outline type="rss" text="b > c" xmlUrl="'),
        fx.xml_escape(F.col("url")),
        F.lit('"/></outline></body></opml>'),
    )
    opml = opml_urls(pages.select("page_id", outline.alias("body"))).select(
        F.col("page_id").alias("pos"), "url"
    )
    merged = seeds.merge_sources(direct, listed, opml)
    return merged.select("url", F.col("source_rank").cast("bigint").alias("source_rank"), "pos")


def find_items(spark: SparkSession, sf: str) -> DataFrame:
    items = fx.identified(fx.document_items(spark, sf))
    labels = fx.table(spark, sf, "labels")
    named = labels.join(items.select("doc_id", "feed_url", "url", "guid", "id"), "doc_id")
    key = (
        F.when(F.col("toxic") == 1, F.concat(F.lit("missing-"), F.col("doc_id").cast("string")))
        .when(F.col("quality") == 1, F.col("id"))
        .otherwise(F.coalesce("url", "guid", "id"))
    )
    keys = named.select("feed_url", key.alias("key"))
    found = item_ops.find_items(items, keys)
    return found.select("feed_url", "key", "doc_id", "id", F.col("error")["code"].alias("error_code"), F.col("error")["message"].alias("message"))


def show_items_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.feed_documents(spark, sf, "rss")
    stored = docs.select("feed_url", "body")
    keys = fx.table(spark, sf, "labels").join(docs, F.col("doc_id") == F.col("request_pos"))
    keys = keys.select("feed_url", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-1")).alias("key"))
    return show_items(stored, keys).select("feed_url", "key", "title", "guid", "url")


def get_item(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of single items within a small budget, or the error that says how to ask again."""
    docs = fx.feed_documents(spark, sf, "mixed")
    keys = fx.table(spark, sf, "labels").join(docs, F.col("doc_id") == F.col("request_pos"))
    keys = keys.select("feed_url", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-1")).alias("key"))
    found = show_items(docs.select("feed_url", "body"), keys, content_format="html").where(F.col("id").isNotNull())
    shown = report.item_documents(found, 500).withColumnRenamed("id", "_id")
    named = found.select(F.col("feed_url").alias("_feed"), "key", "id")
    error = F.col("error")
    return shown.join(named, (F.col("_feed") == F.col("feed_url")) & (F.col("_id") == F.col("id"))).select(
        "feed_url", "key", "id", error["code"].alias("code"), error["message"].alias("message"), error["details"].alias("details"), "summary"
    )


def empty_guids(spark: SparkSession, sf: str) -> DataFrame:
    """Feeds whose guids or links are there but empty."""
    docs = fx.feed_documents(spark, sf, "rss")
    no_link = F.regexp_replace("body", "<link>/d/[^<]*</link>", "<link></link>")
    no_guid = F.regexp_replace(no_link, '<guid isPermaLink="false">[^<]*</guid>', '<guid isPermaLink="false"></guid>')
    lang = F.regexp_extract("body", "<category>([a-z]*)</category>", 1)
    body = F.when(lang == "fr", no_guid).when(lang == "de", no_link).otherwise(F.col("body"))
    run = fetch(docs.withColumn("body", body), FeedParams(content_format="none"))
    return run.items().select("feed_url", "pos", "guid", "url", "id_source", "id")


def cross_feed(spark: SparkSession, sf: str) -> DataFrame:
    items = fx.identified(fx.document_items(spark, sf).withColumn("guid", F.sha2("text", 256)))
    return item_ops.cross_feed_matches(items)


def diff_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    items = fx.document_items(spark, sf)
    old = fx.identified(items.where(F.col("lang") != "de"))
    changed = F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = fx.identified(items.where(F.col("lang") != "es").withColumn("text", changed))
    return item_ops.diff_snapshots(old, new)


def unseen(spark: SparkSession, sf: str) -> DataFrame:
    items = fx.identified(fx.document_items(spark, sf))
    seen = items.join(fx.table(spark, sf, "labels"), "doc_id", "left_semi")
    return item_ops.unseen_items(items, seen).select("doc_id", "feed_url", "id")


# --- aggregates --------------------------------------------------------------------------------


def feed_totals(spark: SparkSession, sf: str) -> DataFrame:
    items = fx.identified(fx.document_items(spark, sf))
    feeds = items.select("feed_url").distinct()
    without_items = feeds.select(F.concat("feed_url", F.lit("#none")).alias("feed_url"))
    return totals.feed_totals(items, feeds.unionByName(without_items))


def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    return totals.run_totals(fx.identified(fx.document_items(spark, sf)))


def run_status(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, content_format="none").status().select(
        "feeds", "failed", F.col("status").cast("bigint").alias("status")
    )


def warnings(spark: SparkSession, sf: str) -> DataFrame:
    items = fx.document_items(spark, sf)
    per_language = items.select(
        F.concat("feed_url", F.lit("#"), "lang").alias("feed_url"),
        "ts",
        ((F.col("lang") == "fr") & (F.length("text") > 2000)).alias("fell_back"),
    )
    return totals.warnings_of(per_language)


def fetch_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """Warnings of a real run: bodies of French feeds stand where no converter looks for text."""
    docs = fx.feed_documents(spark, sf, "rss")
    opened = F.replace("body", F.lit("<description>"), F.lit("<description>&lt;head&gt;&lt;p&gt;"))
    hidden = F.replace(opened, F.lit("</description>"), F.lit("&lt;/p&gt;&lt;/head&gt;</description>"))
    docs = docs.withColumn("body", F.when(F.col("body").contains("<category>fr</category>"), hidden).otherwise(F.col("body")))
    return fetch(docs, FeedParams()).warnings().select("request_pos", "feed_url", "code", "message")


def truncation(spark: SparkSession, sf: str) -> DataFrame:
    items = fx.document_items(spark, sf).select(text.is_over("text", 1000).alias("content_truncated"))
    marker = totals.truncation_marker(items, DEFAULT_ITEM_CAP, report.TRUNCATION_HINT)
    return marker.select("truncation.*")


def response_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return report.estimate_response_tokens(_run(spark, sf), F.lit(STAMP))


def budget(spark: SparkSession, sf: str) -> DataFrame:
    items = fx.identified(fx.document_items(spark, sf))
    sizes = items.groupBy("feed_url").agg(
        F.count("*").alias("item_count"), F.sum("content_tokens_est").alias("estimated_tokens")
    )
    checked = report.check_budget(sizes, 9000)
    return checked.select("feed_url", F.col("error")["code"].alias("code"), F.col("error")["message"].alias("message"), F.col("error")["details"].alias("details"))


def bounded_report(spark: SparkSession, sf: str) -> DataFrame:
    made = report.bounded_reports(_run(spark, sf, limit=DEFAULT_ITEM_CAP, max_content_chars=2000), F.lit(STAMP))
    shape = "total_items bigint, feeds array<struct<items:array<struct<id:string>>>>, truncation struct<items_content_truncated:bigint>"
    read = made.select("request_pos", "feed_url", "error", "summary", F.from_json("document", shape).alias("doc"))
    return read.select(
        "request_pos",
        "feed_url",
        F.col("error").isNotNull().alias("over"),
        F.col("doc.total_items").alias("total_items"),
        F.get(F.get("doc.feeds", F.lit(0))["items"], F.lit(0))["id"].alias("first_id"),
        F.col("doc.truncation.items_content_truncated").alias("n_cut"),
        "summary",
    )


def report_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).feeds().select("feed_url", report.report_summary().alias("summary"))


# --- snapshots ---------------------------------------------------------------------------------


def _resolve(policy: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        log = fx.event_responses(spark, sf)
        early = log.where(F.col("fetched_at") < F.lit(MID_JANUARY))
        stored = snapshots.upsert_snapshots(None, early)
        answers = snapshots.latest_responses(log.where(F.col("fetched_at") >= F.lit(MID_JANUARY)))
        requests = log.groupBy("feed_url").agg(F.min("etag").alias("first")).select(
            F.xxhash64("feed_url").alias("request_pos"), "feed_url"
        )
        out = snapshots.resolve_fetch(
            requests, answers, stored, policy, timedelta(days=17), MONTH_END
        )
        return out.select(
            "feed_url", "body", "status", "from_cache",
            F.col("fetch_error")["code"].alias("code"), F.col("fetch_error")["message"].alias("message"),
            F.col("fetch_error")["details"].alias("details"),
        )

    return query


def snapshots_upsert(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.event_responses(spark, sf)
    early, late = F.col("fetched_at") < F.lit(MID_JANUARY), F.col("fetched_at") >= F.lit(MID_JANUARY)
    stored = snapshots.upsert_snapshots(None, log.where(early))
    merged = snapshots.upsert_snapshots(stored, log.where(late))
    return merged.select("feed_url", "etag", "body", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fetched_at"))


def snapshot_list(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.event_responses(spark, sf)
    listed = snapshots.list_snapshots(snapshots.upsert_snapshots(None, log))
    return listed.select("feed_url", "size_bytes", "etag", dates.rfc3339("fetched_at").alias("fetched_at"))


def snapshots_fresh(spark: SparkSession, sf: str) -> DataFrame:
    stored = snapshots.upsert_snapshots(None, fx.event_responses(spark, sf))
    return snapshots.fresh(stored, timedelta(hours=6), datetime(2024, 1, 30, 23, 0, tzinfo=timezone.utc)).select("feed_url")


# --- hosts -------------------------------------------------------------------------------------


def throttle_streaks(spark: SparkSession, sf: str) -> DataFrame:
    rows = hosts.throttle_streaks(fx.event_log(spark, sf), ("ts", "event_id"))
    return rows.select("authority", "event_id", "streak")


def throttle_streaks_one_host(spark: SparkSession, sf: str) -> DataFrame:
    """The whole log as one host whose rows share a few minutes: its chunks follow the row counts."""
    log = fx.event_log(spark, sf).withColumns({"authority": F.lit("one:443"), "ts": F.date_trunc("month", "ts")})
    return hosts.throttle_streaks(log, ("ts", "event_id"), chunk_rows=500).select("authority", "event_id", "streak")


def item_positions_one_feed(spark: SparkSession, sf: str) -> DataFrame:
    items = _event_items(spark, sf).withColumns({"feed_url": F.lit("u"), "ts": F.date_trunc("day", "ts")})
    return item_ops.item_positions(items, chunk_rows=500).select("event_id", "item_pos")


def _host_state(spark: SparkSession, sf: str) -> DataFrame:
    return hosts.host_cooldowns(fx.event_log(spark, sf), ("ts", "event_id"))


def host_cooldowns(spark: SparkSession, sf: str) -> DataFrame:
    us = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return _host_state(spark, sf).select(
        "authority", "streak",
        F.date_format("next_allowed", us).alias("next_allowed"),
        F.date_format("warm_until", us).alias("warm_until"),
    )


def polite_schedule(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.event_log(spark, sf)
    pending = log.select(
        F.col("event_id").alias("request_pos"),
        F.concat(F.lit("https://"), F.regexp_replace("authority", ":443", ""), F.lit("/f/"), F.col("event_id").cast("string")).alias("feed_url"),
    )
    # Per host, ask shortly after its last throttle, so that hosts differ in how warm they are.
    as_of = F.lit("2024-01-30 23:00:00").cast("timestamp")
    plan = hosts.polite_schedule(pending, _host_state(spark, sf), as_of)
    return plan.select(
        "request_pos", "authority", "wait_ms",
        F.col("error")["code"].alias("code"), F.col("error")["details"].alias("details"),
    )


# --- outputs -----------------------------------------------------------------------------------


def discover(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.discover_feeds(fx.pages_with_links(spark, sf))


def discovery_report(spark: SparkSession, sf: str) -> DataFrame:
    made = records.discovery_reports(fx.pages_with_links(spark, sf))
    return made.select(
        "site_url",
        F.get_json_object("document", "$.feeds[0].url").alias("first_url"),
        F.json_array_length(F.get_json_object("document", "$.feeds")).cast("bigint").alias("n_feeds"),
    )


def discovery_text(spark: SparkSession, sf: str) -> DataFrame:
    return records.discovery_text(fx.pages_with_links(spark, sf))


def discovery_ndjson(spark: SparkSession, sf: str) -> DataFrame:
    lines = records.discovery_ndjson(fx.pages_with_links(spark, sf))
    field = lambda path: F.get_json_object("line", path)
    return lines.select("site_url", "pos", field("$.url").alias("url"), field("$.title").alias("title"))


def ndjson_items(spark: SparkSession, sf: str) -> DataFrame:
    lines = records.ndjson_lines(_run(spark, sf).items())
    field = lambda path: F.get_json_object("line", path)
    return lines.select(
        "feed_url", "id", field("$.title").alias("title"), field("$.guid").alias("guid"),
        field("$.authors[0]").alias("author"), field("$.enclosures[0].length").cast("bigint").alias("length"),
    )


def tagged_records(spark: SparkSession, sf: str) -> DataFrame:
    lines = records.tagged_records(_run(spark, sf), F.lit(STAMP), warning_lines=False)
    field = lambda path: F.get_json_object("line", path)
    return lines.select(
        F.col("kind_rank").cast("bigint").alias("kind_rank"),
        "request_pos",
        "pos",
        field("$.type").alias("type"),
        F.when(F.col("kind_rank") == 3, F.col("line")).otherwise(F.coalesce(field("$.guid"), field("$.code"))).alias("what"),
    )


def tagged_warning_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The form for runs over very many feeds: warnings as records, counted in the summary."""
    lines = records.tagged_records(_run(spark, sf, content_format="none"), F.lit(STAMP), warning_lines=True)
    field = lambda path: F.get_json_object("line", path)
    return lines.select(
        F.col("kind_rank").cast("bigint").alias("kind_rank"),
        "request_pos",
        "pos",
        field("$.type").alias("type"),
        F.coalesce(field("$.guid"), field("$.code"), field("$.warnings")).alias("what"),
    )


def text_summary(spark: SparkSession, sf: str) -> DataFrame:
    return records.text_summary(_run(spark, sf)).select(
        F.col("part").cast("bigint").alias("part"), "request_pos", F.col("row").cast("bigint").alias("row"), "pos", "line"
    )


def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = report.report_lines(_run(spark, sf, limit=DEFAULT_ITEM_CAP), F.lit(STAMP))
    feed = F.regexp_replace("text", r",\z", "")
    is_feed = F.col("section") == 1
    return lines.select(
        F.col("section").cast("bigint").alias("section"),
        "request_pos",
        "seq",
        F.when(is_feed, F.get_json_object(feed, "$.feed_url")).alias("feed_url"),
        F.when(is_feed, F.json_array_length(F.get_json_object(feed, "$.items"))).cast("bigint").alias("n_items"),
        F.when(is_feed, F.get_json_object(feed, "$.items[0].guid")).alias("first_guid"),
        F.when(is_feed, ~F.col("text").endswith(",")).alias("is_last"),
    )


def contract_check(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of the item contract: a real run has none, so some are planted in it."""
    items = item_ops.contract_items(_run(spark, sf).items())
    assert contract("fetch")["feeds"].dataType.elementType["items"].dataType.elementType.fieldNames() == items.columns
    planted = {
        "id": F.when(F.col("title") != "Line 1", F.col("id")),
        "id_source": F.when(F.array_contains("categories", "es"), F.lit("luck")).otherwise(F.col("id_source")),
        "content_tokens_est": F.col("content_tokens_est").cast("int"),
    }
    spoiled = [planted.get(c, F.col(c)).alias(c) for c in items.columns if c != "guid"]
    forms = items.select(F.struct(*items.columns).alias("clean"), F.struct(*spoiled).alias("spoiled"))
    found = check_contracts(forms, "item")
    return found.select("field", "rule", "rows", (F.col("form") == "spoiled").alias("planted"))


# --- streams -----------------------------------------------------------------------------------


def _documents_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The documents table as a stream. A stream source takes a folder or a pattern, not one file."""
    apply_runtime_conf(spark)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]")


def _events_stream(spark: SparkSession, sf: str) -> DataFrame:
    apply_runtime_conf(spark)
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")


class _StreamTables:
    """Lets the fixtures read a table as a stream: same columns, ``readStream`` underneath."""

    def __init__(self, spark: SparkSession, **tables: DataFrame) -> None:
        self._tables = tables
        self.conf = spark.conf
        self.read = self

    def parquet(self, path: str) -> DataFrame:
        return self._tables[path.rsplit("/", 1)[1].removesuffix(".parquet")]


def _to_parquet(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    out = scratch_path(spark, label)
    pipelines.run_available(
        df.writeStream.format("parquet").option("path", f"{out}/data"), f"{out}/checkpoint"
    )
    return spark.read.schema(df.schema).parquet(f"{out}/data")


def stream_items(spark: SparkSession, sf: str) -> DataFrame:
    source = _StreamTables(spark, documents=_documents_stream(spark, sf))
    # One file is one task; deal its rows out before the parsing.
    cores = spark.sparkContext.defaultParallelism
    docs = fx.feed_documents(source, sf, "mixed").repartition(cores)
    items = pipelines.stream_items(docs, FeedParams(content_format="html"))
    landed = items.select("feed_url", "id", "guid", "content_hash")
    return _to_parquet(landed, "stream-items")


def _stream_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as item versions: the user is the feed, the kind of event the item."""
    source = _StreamTables(spark, events=_events_stream(spark, sf))
    return fx.table(source, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("feed_url"),
        F.col("event_type").alias("id"),
        F.col("ts").alias("fetched_at"),
        "event_id",
        F.when(F.col("value") > 5, F.lit("long")).otherwise(F.lit("short")).alias("content_hash"),
    )


def stream_unseen(spark: SparkSession, sf: str) -> DataFrame:
    fresh = pipelines.stream_unseen(_stream_versions(spark, sf), "90 days").select("feed_url", "id")
    return _to_parquet(fresh, "stream-unseen")


def _changes_of(versions: DataFrame, label: str) -> DataFrame:
    spark = versions.sparkSession
    out = scratch_path(spark, label)
    table = ChangeTable(spark, f"{out}/table")
    pipelines.run_available(pipelines.stream_changes(versions, table, tie="event_id"), f"{out}/checkpoint")
    return table.changes()


def stream_changes(spark: SparkSession, sf: str) -> DataFrame:
    landed = _changes_of(_stream_versions(spark, sf), "stream-changes")
    us = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return landed.select("feed_url", "id", "change", "content_hash", F.date_format("fetched_at", us).alias("fetched_at"))


SLICES, SLICE_FILES = 4, 4


def _events_in_slices(spark: SparkSession, sf: str, unit: str) -> DataFrame:
    """The events as a stream of ``SLICES`` micro-batches, with times cut to whole units.

    Slices are ranges of event_id, so many rows before and after a cut have equal times.
    """
    events = fx.table(spark, sf, "events").withColumn("ts", F.date_trunc(unit, "ts"))
    ids = events.agg(F.min("event_id").alias("low"), F.max("event_id").alias("high")).first()
    path = scratch_path(spark, "event-slices")
    low, step = ids["low"] or 0, ((ids["high"] or 0) - (ids["low"] or 0)) // SLICES + 1
    for k in range(SLICES):
        part = events.where(F.col("event_id").between(low + k * step, low + (k + 1) * step - 1))
        part.repartition(SLICE_FILES).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", SLICE_FILES).parquet(path)


def stream_changes_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Changes over several batches whose rows share times across the cuts."""
    source = _StreamTables(spark, events=_events_in_slices(spark, sf, "day"))
    versions = fx.table(source, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("feed_url"),
        F.col("event_type").alias("id"),
        F.col("ts").alias("fetched_at"),
        "event_id",
        F.when(F.col("value") > 5, F.lit("long")).otherwise(F.lit("short")).alias("content_hash"),
    )
    landed = _changes_of(versions, "stream-changes-ties")
    return landed.groupBy("feed_url", "id", "change", "content_hash", F.date_format("fetched_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def stream_host_state_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Host state over several batches whose rows share times across the cuts."""
    source = _StreamTables(spark, events=_events_in_slices(spark, sf, "hour"))
    out = scratch_path(spark, "stream-hosts-ties")
    table = pipelines.host_state_table(spark, f"{out}/table")
    pipelines.run_available(
        pipelines.stream_host_state(fx.event_log(source, sf), table, ("ts", "event_id")), f"{out}/checkpoint"
    )
    us = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return table.read().select(
        "authority", "streak", F.date_format("next_allowed", us).alias("next_allowed"), F.date_format("warm_until", us).alias("warm_until")
    )


def stream_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    source = _StreamTables(spark, events=_events_stream(spark, sf))
    out = scratch_path(spark, "stream-snapshots")
    table = SnapshotTable(spark, f"{out}/table")
    pipelines.run_available(
        pipelines.stream_snapshots(fx.event_responses(source, sf), table), f"{out}/checkpoint"
    )
    return table.read().select("feed_url", "etag", "body", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fetched_at"))


def stream_host_state(spark: SparkSession, sf: str) -> DataFrame:
    source = _StreamTables(spark, events=_events_stream(spark, sf))
    out = scratch_path(spark, "stream-hosts")
    table = pipelines.host_state_table(spark, f"{out}/table")
    log = fx.event_log(source, sf)
    pipelines.run_available(pipelines.stream_host_state(log, table, ("ts", "event_id")), f"{out}/checkpoint")
    us = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return table.read().select(
        "authority", "streak", F.date_format("next_allowed", us).alias("next_allowed"), F.date_format("warm_until", us).alias("warm_until")
    )


QUERIES: dict[str, Query] = {
    "item_identity": item_identity,
    "content_columns": content_columns,
    "feed_dates": feed_dates,
    "enclosures_links": enclosures_links,
    "strip_tags": strip_tags,
    "to_text": to_text,
    "to_markdown": to_markdown,
    "nested_markdown": nested_markdown,
    "resolve_links": resolve_links,
    "authority": authority,
    "durations": durations,
    "lenient_int": lenient_int,
    "content_format": content_format,
    "retry_after": retry_after,
    "parse_rss": parse_rss,
    "parse_atom": parse_atom,
    "parse_jsonfeed": parse_jsonfeed,
    "parse_namespaces": parse_namespaces,
    "parse_errors": parse_errors,
    "fetch_items": fetch_items,
    "fetch_truncated": fetch_truncated,
    "fetch_since": fetch_since,
    "fetch_feeds": fetch_feeds,
    "fetch_summary": fetch_summary,
    "fetch_markdown": fetch_markdown,
    "read_documents": read_documents,
    "read_body_files": read_body_files,
    "read_url_lists": read_url_lists,
    "read_pages": read_pages_query,
    "since": since,
    "newest_n": newest_n,
    "item_positions": item_positions,
    "merge_sources": merge_sources,
    "find_items": find_items,
    "show_items": show_items_query,
    "get_item": get_item,
    "empty_guids": empty_guids,
    "cross_feed": cross_feed,
    "diff_snapshots": diff_snapshots,
    "unseen": unseen,
    "feed_totals": feed_totals,
    "run_totals": run_totals,
    "run_status": run_status,
    "warnings": warnings,
    "fetch_warnings": fetch_warnings,
    "truncation": truncation,
    "response_tokens": response_tokens,
    "budget": budget,
    "bounded_report": bounded_report,
    "report_summary": report_summary,
    "resolve_fetch_revalidate": _resolve("revalidate"),
    "resolve_fetch_max_age": _resolve("max_age"),
    "resolve_fetch_cache_first": _resolve("cache_first"),
    "resolve_fetch_no_cache": _resolve("no_cache"),
    "snapshots_upsert": snapshots_upsert,
    "snapshot_list": snapshot_list,
    "snapshots_fresh": snapshots_fresh,
    "throttle_streaks": throttle_streaks,
    "throttle_streaks_one_host": throttle_streaks_one_host,
    "item_positions_one_feed": item_positions_one_feed,
    "host_cooldowns": host_cooldowns,
    "polite_schedule": polite_schedule,
    "discover": discover,
    "discovery_report": discovery_report,
    "discovery_text": discovery_text,
    "discovery_ndjson": discovery_ndjson,
    "ndjson_items": ndjson_items,
    "tagged_records": tagged_records,
    "tagged_warning_lines": tagged_warning_lines,
    "text_summary": text_summary,
    "report_lines": report_lines,
    "contract_check": contract_check,
    "stream_items": stream_items,
    "stream_unseen": stream_unseen,
    "stream_changes": stream_changes,
    "stream_changes_ties": stream_changes_ties,
    "stream_snapshots": stream_snapshots,
    "stream_host_state": stream_host_state,
    "stream_host_state_ties": stream_host_state_ties,
    "fetch_captures": fetch_captures,
}

"""Parsing and the whole job on small documents."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from newsloom.errors import UsageError
from newsloom.operators.items import contract_items
from newsloom.params import FeedParams
from newsloom.plans.fetch import fetch
from newsloom.plans.lookup import show_items
from newsloom.schemas import check_contract, contract
from newsloom.sinks import records, report
from newsloom.sources.feeds import parse_feeds

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<!-- made for the tests -->
<rss version="2.0" xmlns:content="c" xmlns:media="m">
 <channel>
  <title>Garden Notes</title><link>https://garden.example/</link>
  <lastBuildDate>Sat, 02 May 2026 08:00:00 GMT</lastBuildDate>
  <item><title>Older</title><link>/p/older</link><guid isPermaLink="false">tag:1</guid>
   <pubDate>Fri, 01 May 2026 08:00:00 GMT</pubDate><author>ann@garden.example (Ann)</author>
   <category>soil</category><category domain="d">worms</category>
   <description>short</description>
   <content:encoded><![CDATA[<p>The <strong>long</strong> body</p>]]></content:encoded>
   <enclosure url="https://cdn.example/1.mp3" type="audio/mpeg" length="1234"/></item>
  <item><title>Newer</title><link>https://garden.example/p/newer</link>
   <pubDate>Sat, 02 May 2026 08:00:00 GMT</pubDate><description>&lt;i&gt;sum&lt;/i&gt;</description>
   <media:content url="https://cdn.example/2.mp4" type="video/mp4" fileSize="5000"/></item>
  <item><title>Undated</title><guid></guid><description></description></item>
 </channel>
</rss>"""

ATOM = """<feed xmlns="http://www.w3.org/2005/Atom">
 <title>Stars</title><link rel="self" href="https://stars.example/atom"/>
 <link rel="alternate" href="https://stars.example/"/><updated>2026-05-03T00:00:00Z</updated>
 <entry><title>One</title><id>urn:1</id><link href="/one"/><link rel="alternate" href="/articles/one"/>
  <link rel="enclosure" href="/one.ogg" type="audio/ogg" length="9"/>
  <published>2026-05-01T10:00:00Z</published><updated>2026-05-01T12:00:00+02:00</updated>
  <author><name>Bo</name></author><category term="sky"/><summary>s</summary>
  <content type="html">&lt;p&gt;Atom &lt;b&gt;body&lt;/b&gt;&lt;/p&gt;</content></entry>
 <entry><title>Two</title><id>urn:2</id><updated>2026-05-02T10:00:00Z</updated>
  <content type="xhtml"><div>in <em>place</em></div></content></entry>
</feed>"""

JSON_FEED = json.dumps(
    {
        "version": "https://jsonfeed.org/version/1.1",
        "title": "Tides",
        "home_page_url": "https://tides.example/",
        "items": [
            {"id": "a", "url": "https://tides.example/a", "title": "A", "content_html": "<p>a</p>",
             "date_published": "2026-05-01T00:00:00Z", "authors": [{"name": "Cy"}], "tags": ["x", "y"]},
            {"id": 7, "content_text": "plain", "date_modified": "2026-05-04T00:00:00Z"},
        ],
    }
)

RDF = """<rdf:RDF xmlns:rdf="r" xmlns="http://purl.org/rss/1.0/" xmlns:dc="d">
<channel><title>Old style</title><link>https://old.example/</link></channel>
<item><title>I</title><link>https://old.example/i</link><dc:creator>Di</dc:creator><dc:date>2026-01-02</dc:date></item>
</rdf:RDF>"""

BAD = "<rss><channel><title>x</title><item><title>cut"

FEEDS = {
    "https://garden.example/feed": RSS,
    "https://stars.example/atom": ATOM,
    "https://tides.example/feed.json": JSON_FEED,
    "https://old.example/rdf": RDF,
    "https://bad.example/feed": BAD,
}
AT = "2026-06-01T00:00:00Z"


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, url, body) for i, (url, body) in enumerate(FEEDS.items())]
    return spark.createDataFrame(rows, "request_pos bigint, feed_url string, body string")


def items_of(run, feed):
    found = run.items().where(F.col("feed_url") == feed).orderBy(F.col("ts").desc_nulls_last(), "pos")
    return [r.asDict(recursive=True) for r in contract_items(found).collect()]


def test_rss(documents):
    newer, older, undated = items_of(fetch(documents), "https://garden.example/feed")
    assert [newer["title"], older["title"], undated["title"]] == ["Newer", "Older", "Undated"]
    assert older["url"] == "https://garden.example/p/older"
    assert older["published"] == "2026-05-01T08:00:00Z" and older["updated"] is None
    assert older["authors"] == ["Ann"] and older["categories"] == ["soil", "worms"]
    assert older["content"] == "The **long** body" and older["summary"] == "short"
    assert older["enclosures"] == [{"url": "https://cdn.example/1.mp3", "mime": "audio/mpeg", "length": 1234}]
    assert older["guid"] == "tag:1" and older["id_source"] == "link"
    assert newer["content"] == "*sum*" and newer["guid"] is None
    assert newer["enclosures"] == [{"url": "https://cdn.example/2.mp4", "mime": "video/mp4", "length": 5000}]
    assert undated["guid"] is None and undated["url"] is None and undated["id_source"] == "hash"
    assert undated["content"] is None and undated["content_hash"] is None and undated["content_tokens_est"] == 0


def test_atom(documents):
    two, one = items_of(fetch(documents, FeedParams(content_format="text")), "https://stars.example/atom")
    assert one["url"] == "https://stars.example/articles/one"
    assert (one["published"], one["updated"]) == ("2026-05-01T10:00:00Z", "2026-05-01T10:00:00Z")
    assert one["content"] == "Atom body" and one["authors"] == ["Bo"] and one["categories"] == ["sky"]
    assert one["enclosures"] == [{"url": "/one.ogg", "mime": "audio/ogg", "length": 9}]
    assert two["published"] is None and two["content"] == "in place" and two["id_source"] == "guid"


def test_prefixed_atom(spark):
    body = ATOM.replace("<", "<a:").replace("<a:/", "</a:").replace("</a:", "</a:")
    docs = spark.createDataFrame([("u", body)], "feed_url string, body string")
    titles = [r.title for r in parse_feeds(docs).orderBy("pos").collect()]
    assert titles == ["Stars", "One", "Two"]


def test_json_feed(documents):
    b, a = items_of(fetch(documents, FeedParams(content_format="html")), "https://tides.example/feed.json")
    assert a["content"] == "<p>a</p>" and a["authors"] == ["Cy"] and a["categories"] == ["x", "y"]
    assert b["guid"] == "7" and b["content"] == "plain" and b["updated"] == "2026-05-04T00:00:00Z"


def test_rss_1(documents):
    (item,) = items_of(fetch(documents), "https://old.example/rdf")
    assert item["authors"] == ["Di"] and item["published"] == "2026-01-02T00:00:00Z"


def test_feeds_and_status(documents):
    run = fetch(documents)
    feeds = {r.feed_url: r for r in run.feeds().collect()}
    assert feeds["https://garden.example/feed"].site_url == "https://garden.example/"
    assert feeds["https://garden.example/feed"].updated == "2026-05-02T08:00:00Z"
    assert feeds["https://stars.example/atom"].site_url == "https://stars.example/"
    assert [feeds[u].item_count for u in FEEDS] == [3, 2, 2, 1, 0]
    bad = feeds["https://bad.example/feed"]
    assert bad.status == "error" and bad.error.code == "FEED_PARSE_FAILED" and bad.error.details == "{}"
    assert run.status().first().status == 3
    only_bad = documents.where(F.col("feed_url").startswith("https://bad"))
    assert fetch(only_bad).status().first().status == 4
    assert fetch(documents.limit(0)).status().first().status == 0
    assert [r.code for r in run.errors().collect()] == ["FEED_PARSE_FAILED"]


def test_unreadable_bodies_are_data(spark):
    bodies = ["plain text", "", None, "<html><body/></html>", '{"a": 1', '{"a": 1}', "<rss></rss>", "<feed>"]
    docs = spark.createDataFrame([(f"u{i}", b) for i, b in enumerate(bodies)], "feed_url string, body string")
    rows = fetch(docs).feeds().collect()
    assert len(rows) == len(bodies)
    assert all(r.status == "error" and r.error.code == "FEED_PARSE_FAILED" and r.item_count == 0 for r in rows)


def test_since_limit_and_order(documents):
    garden = "https://garden.example/feed"
    since = datetime(2026, 5, 2, tzinfo=timezone.utc)
    assert [i["title"] for i in items_of(fetch(documents, FeedParams(since=since)), garden)] == ["Newer", "Undated"]
    assert [i["title"] for i in items_of(fetch(documents, FeedParams(limit=1)), garden)] == ["Newer"]
    assert items_of(fetch(documents, FeedParams(limit=0)), garden) == []
    # A feed without surviving items still reports.
    assert fetch(documents, FeedParams(limit=0)).feeds().count() == len(FEEDS)


def test_truncation_keeps_the_hash(documents):
    garden = "https://garden.example/feed"
    whole = items_of(fetch(documents), garden)[1]
    cut = items_of(fetch(documents, FeedParams(max_content_chars=5)), garden)[1]
    assert cut["content"] == "The *" + " …[truncated]" and cut["content_truncated"]
    assert cut["content_hash"] == whole["content_hash"] and not whole["content_truncated"]
    assert cut["content_tokens_est"] == (len(cut["content"]) + 3) // 4


def test_undated_warning_only_when_all_are(spark, documents):
    body = "<rss><channel><title>t</title><item><title>a</title></item><item><title>b</title></item></channel></rss>"
    docs = spark.createDataFrame([(0, "u", body)], "request_pos bigint, feed_url string, body string")
    (warning,) = fetch(docs).warnings().collect()
    assert warning.code == "UNDATED_ITEMS" and warning.message.startswith("all 2 returned item(s) lack")
    assert fetch(documents).warnings().count() == 0
    assert [i["title"] for i in items_of(fetch(docs, FeedParams(limit=1)), "u")] == ["a"]


def pretty(text: str) -> str:
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False)


def test_feed_reports_are_pretty_json(documents):
    run = fetch(documents, FeedParams(limit=2))
    made = {r.feed_url: r.document for r in report.feed_reports(run, F.lit(AT)).collect()}
    assert all(pretty(d) == d for d in made.values())
    garden = json.loads(made["https://garden.example/feed"])
    assert list(garden) == contract("fetch").fieldNames()
    assert list(garden["feeds"][0]) == contract("fetch")["feeds"].dataType.elementType.fieldNames()
    assert [i["title"] for i in garden["feeds"][0]["items"]] == ["Newer", "Older"]
    assert garden["total_items"] == 2 and garden["truncation"] is None
    tokens = {r.feed_url: r.estimated_tokens for r in report.estimate_response_tokens(run, F.lit(AT)).collect()}
    assert tokens == {u: (len(d) + 3) // 4 for u, d in made.items()}
    bad = json.loads(made["https://bad.example/feed"])
    assert bad["errors"] == [bad["feeds"][0]["error"]] and bad["errors"][0]["details"] == {}


def test_nested_reports_need_a_limit(documents):
    with pytest.raises(UsageError):
        report.feed_reports(fetch(documents), F.lit(AT))


def test_whole_run_report(documents, tmp_path):
    run = fetch(documents, FeedParams(limit=25, max_content_chars=5))
    report.write_report(run, F.lit(AT), str(tmp_path / "r"))
    parts = sorted((tmp_path / "r").glob("part-*.txt"))
    doc = json.loads("".join(p.read_text(encoding="utf8") for p in parts))
    assert [f["feed_url"] for f in doc["feeds"]] == list(FEEDS)
    assert doc["total_items"] == 8 and len(doc["errors"]) == 1
    assert doc["truncation"]["items_content_truncated"] == 3 and doc["truncation"]["items_omitted"] == 0


def test_budget_and_bounded_reports(documents):
    run = fetch(documents, FeedParams(limit=25, max_content_chars=5))
    rows = {r.feed_url: r for r in report.bounded_reports(run, F.lit(AT), budget=600).collect()}
    over = rows["https://garden.example/feed"]
    assert over.document is None and over.error.code == "RESPONSE_TOO_LARGE"
    details = json.loads(over.error.details)
    est, n = details["estimated_tokens"], 3
    assert details["suggested_limit"] == max(1, int(n * 600 / est * 0.9))
    assert details["suggested_max_content_chars"] == max(200, 600 * 7 // 10 * 4 // n)
    ok = rows["https://old.example/rdf"]
    assert ok.summary == 'Fetched 1 item(s) (~0 content tokens) from "Old style". Full data in structuredContent.'
    cut = json.loads(rows["https://tides.example/feed.json"].document or "null")
    assert cut is None or cut["truncation"] is None or cut["truncation"]["applied_limit"] == 25
    assert "FEED_PARSE_FAILED" in rows["https://bad.example/feed"].summary


def test_item_documents(documents):
    run = fetch(documents)
    (doc,) = [r for r in report.item_documents(run.items()).collect() if r.summary and '"Newer"' in r.summary]
    assert pretty(doc.document) == doc.document and json.loads(doc.document)["title"] == "Newer"
    assert all(r.error.code == "RESPONSE_TOO_LARGE" for r in report.item_documents(run.items(), budget=10).collect())


def test_ndjson_and_tagged_records(documents, tmp_path):
    run = fetch(documents, FeedParams(limit=2))
    records.write_ndjson(run.items(), str(tmp_path / "n"))
    lines = [json.loads(x) for p in (tmp_path / "n").glob("part-*") for x in p.read_text(encoding="utf8").splitlines()]
    assert len(lines) == 7 and all(list(x) == contract("fetch")["feeds"].dataType.elementType["items"].dataType.elementType.fieldNames() for x in lines)
    records.write_tagged_records(run, F.lit(AT), str(tmp_path / "t"))
    parts = sorted((tmp_path / "t").glob("part-*"))
    tagged = [json.loads(x) for p in parts for x in p.read_text(encoding="utf8").splitlines()]
    assert [t["type"] for t in tagged] == ["item"] * 7 + ["error", "summary"]
    assert tagged[-1]["total_items"] == 7 and tagged[-1]["errors"] == 1 and tagged[-2]["details"] == {}


def test_text_summary(documents, tmp_path):
    run = fetch(documents, FeedParams(limit=1))
    records.write_text_summary(run, str(tmp_path / "x"))
    parts = sorted((tmp_path / "x").glob("part-*"))
    lines = [x for p in parts for x in p.read_text(encoding="utf8").splitlines()]
    assert lines[:2] == [
        "Garden Notes  [ok]  1 item(s)",
        "  - 2026-05-02T08:00:00Z  Newer  https://garden.example/p/newer",
    ]
    assert lines[-2:] == [
        "1 error(s):",
        "  ! [FEED_PARSE_FAILED] https://bad.example/feed: feed parse error: malformed XML",
    ]


def test_show_items(documents):
    keys = [("https://garden.example/feed", "tag:1"), ("https://garden.example/feed", "nope"), ("https://tides.example/feed.json", "https://tides.example/a")]
    spark = documents.sparkSession
    found = show_items(documents, spark.createDataFrame(keys, "feed_url string, key string")).collect()
    by_key = {r.key: r for r in found}
    assert by_key["tag:1"].title == "Older" and by_key["https://tides.example/a"].title == "A"
    assert by_key["nope"].error.code == "NOT_FOUND" and by_key["nope"].id is None


def test_contract(documents):
    items = contract_items(fetch(documents).items())
    assert check_contract(items, "item").count() == 0
    broken = items.withColumn("id_source", F.lit("guess")).withColumn("id", F.lit(None).cast("string")).drop("guid")
    found = {(r.field, r.rule) for r in check_contract(broken, "item").collect()}
    assert found == {("id_source", "value"), ("id", "null"), ("guid", "missing")}
    with pytest.raises(UsageError):
        contract("nope")


def test_bodies_are_parsed_once_and_nothing_is_shuffled(documents):
    run = fetch(documents.coalesce(1).repartition(64), FeedParams(limit=5))
    plan = run.items().where(F.col("title") == "Newer")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_xml(") == 1
    assert plan.count("Exchange") == 1  # the repartition of this test


def test_namespaces_by_address_and_requests_apart(spark):
    body = (
        '<rss xmlns:c="http://purl.org/rss/1.0/modules/content/" xmlns:m=\'http://search.yahoo.com/mrss/\' '
        'xmlns:d="http://purl.org/dc/elements/1.1/"><channel><title>t</title><item><title>a</title><link>/x</link>'
        "<pubDate>01 Jan 2026 08:00:00 CEST</pubDate><d:creator>Bo</d:creator><description>short</description>"
        '<c:encoded>long &amp;#00000038; &amp;lbrace;</c:encoded><m:content url="http://v/1.mp4" type="video/mp4" fileSize="5"/></item></channel></rss>'
    )
    schema = "request_pos bigint, feed_url string, body string, content_type string, fetched_at timestamp"
    docs = spark.createDataFrame([(k, "https://a/f", body, "x", None) for k in range(2)], schema)
    run = fetch(docs, FeedParams(content_format="text"))
    items = run.items().collect()
    assert [(i.content, i.authors, i.enclosures[0].length, i.published) for i in items] == [("long & {", ["Bo"], 5, None)] * 2
    assert sorted((f.request_pos, f.item_count) for f in run.feeds().collect()) == [(0, 1), (1, 1)]


def test_namespaces_below_the_root_and_cdata(spark):
    body = (
        "<rss><channel><title>t</title>"
        '<item xmlns:k="http://purl.org/rss/1.0/modules/content/"><title>a</title><k:encoded><![CDATA[<k:b>&amp; <m:content/>]]></k:encoded></item>'
        '<item><title>b</title><q.r:encoded xmlns:q.r="http://purl.org/rss/1.0/modules/content">own</q.r:encoded>'
        '<m:content xmlns:m="http://search.yahoo.com/mrss/" url="http://v/2.mp4"/></item>'
        '<item><title>c</title><k:encoded xmlns:k="http://other.example/">not ours</k:encoded></item></channel></rss>'
    )
    rows = parse_feeds(spark.createDataFrame([("u", body)], "feed_url string, body string")).where("pos > 0").orderBy("pos").collect()
    assert [r.body for r in rows][:2] == ["<k:b>&amp; <m:content/>", "own"] and rows[1].enclosures[0].url == "http://v/2.mp4"


def test_forms_of_a_record_are_checked_in_one_parse(spark):
    """The contract query judges two forms of its items; the documents are parsed once for both."""
    from conftest import SF_SMALL

    from newsloom.checks.queries import contract_check

    plan = contract_check(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(") == 1


def test_feed_rows_are_the_same_with_and_without_items(documents):
    """Totals and errors come from the feeds' own rows; a saved run takes them from the rows of all items."""
    settings = [FeedParams(limit=2, max_content_chars=5), FeedParams(content_format="none"), FeedParams(since=datetime(2026, 4, 1, tzinfo=timezone.utc))]
    for params in settings:
        run = fetch(documents, params)
        feeds, saved = run.feeds(), run.saved().feeds()
        assert feeds.columns == saved.columns
        assert sorted(map(str, feeds.collect())) == sorted(map(str, saved.collect()))


def test_feeds_without_items_are_not_laid_out(spark):
    """Two captures of a feed are rendered once, and their numbers of items need no entry to be shaped or exploded."""
    from conftest import SF_SMALL

    from newsloom.checks.queries import fetch_captures

    plan = fetch_captures(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(") == 1 and plan.count("Generate ") == 1


def test_item_lengths_without_their_text(documents):
    """Sizes of reports come from the one-line form of an item; only numbers are gathered, without a sort."""
    items = fetch(documents, FeedParams(content_format="html")).rows.where("pos > 0")
    sizes = items.select(F.length(report.item_json(8)).alias("text"), report.item_length(8).alias("sum")).collect()
    assert len(sizes) == 8 and all(r.text == r.sum for r in sizes)
    tokens = report.estimate_response_tokens(fetch(documents), F.lit(AT))
    assert "SortAggregate" not in tokens._jdf.queryExecution().executedPlan().toString()


def test_bounded_reports_are_written_in_the_row_of_their_feed(documents):
    run = fetch(documents, FeedParams(limit=2, max_content_chars=5))
    made = report.bounded_reports(run, F.lit(AT))
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, made.collect())) == sorted(map(str, report.bounded_reports(run.saved(), F.lit(AT)).collect()))

"""The supplied tables recast as feed data. Everything is derived in Spark, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.functions.base import per_session
from newsloom.session import apply_runtime_conf, spread

# 2024-01-01T00:00:00Z, the first day of the events table.
EPOCH = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_runtime_conf(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Zoneless times in the files mean UTC.
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def text(value: Column) -> Column:
    return value.cast("string")


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an item of the feed of its source.

    Spanish documents are undated; German ones have no link and are known by guid; Spanish ones
    have neither link nor guid.
    """
    doc = text(F.col("doc_id"))
    lang = F.col("lang")
    dated = F.when(lang != "es", F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id") * 97 * 60))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/feed.xml")).alias("feed_url"),
        F.col("doc_id").alias("pos"),
        F.lit(0).cast("bigint").alias("request_pos"),
        F.concat(F.lit("Post "), doc).alias("title"),
        F.when(
            lang.isin("en", "fr"),
            F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/p/"), doc),
        ).alias("url"),
        F.when(lang != "es", F.concat(F.lit("g"), doc)).alias("guid"),
        dated.alias("ts"),
        F.col("text"),
        F.col("source"),
    )


def identified(items: DataFrame) -> DataFrame:
    from newsloom.functions.dates import rfc3339
    from newsloom.functions.identity import content_hash, id_source, item_id
    from newsloom.functions.text import estimate_tokens

    return items.withColumns(
        {
            "id": item_id("feed_url", "url", "guid", "title", rfc3339("ts")),
            "id_source": id_source("url", "guid"),
            "content_hash": content_hash("text"),
            "content_tokens_est": estimate_tokens("text"),
        }
    )


def xml_escape(value: Column) -> Column:
    amp = F.replace(value, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _line_ts(i: Column) -> Column:
    minutes = F.col("doc_id") * 97 + (i + 1) * 61
    return F.timestamp_seconds(F.lit(EPOCH) + minutes * 60)


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@per_session
def _rss(end: Column | str = "</rss>") -> Column:
    def item(line: Column, i: Column) -> Column:
        n = text(i + 1)
        date = F.when(
            F.col("lang") != "es",
            _join("<pubDate>", F.date_format(_line_ts(i), "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), "</pubDate>"),
        ).otherwise(F.lit(""))
        return _join(
            "<item><title>Line ", n, "</title><link>/d/", text(F.col("doc_id")), "/", n, "</link>",
            '<guid isPermaLink="false">d', text(F.col("doc_id")), "-", n, "</guid>", date,
            "<author>", F.col("source"), "@example.com (", F.col("source"), ")</author>",
            "<category>", F.col("lang"), "</category><category>line</category>",
            '<enclosure url="https://cdn.example.com/', text(F.col("doc_id")), "/", n, '.mp3" type="audio/mpeg" length="', text(F.length(line)), '"/>',
            "<description>", xml_escape(line), "</description></item>",
        )

    return _join(
        '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>Feed ',
        text(F.col("doc_id")), "</title><link>https://", F.col("source"), ".example.com/</link>",
        F.array_join(F.transform(F.split("text", "\n"), item), ""),
        "</channel>", end,
    )


@per_session
def _atom() -> Column:
    def entry(line: Column, i: Column) -> Column:
        n = text(i + 1)
        date = F.when(
            F.col("lang") != "es",
            _join("<updated>", F.date_format(_line_ts(i), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "</updated>"),
        ).otherwise(F.lit(""))
        return _join(
            "<entry><title>Line ", n, '</title><link rel="self" href="/self"/><link rel="alternate" href="/d/',
            text(F.col("doc_id")), "/", n, '"/>',
            '<link rel="enclosure" href="https://cdn.example.com/', text(F.col("doc_id")), "/", n, '.mp3" type="audio/mpeg" length="', text(F.length(line)), '"/>',
            "<id>d", text(F.col("doc_id")), "-", n, "</id>", date,
            "<author><name>", F.col("source"), "</name></author>",
            '<category term="', F.col("lang"), '"/><category term="line"/>',
            '<content type="html">', xml_escape(line), "</content></entry>",
        )

    return _join(
        '<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Feed ',
        text(F.col("doc_id")), '</title><link rel="self" href="https://', F.col("source"),
        '.example.com/self"/><link rel="alternate" href="https://', F.col("source"), '.example.com/"/>',
        F.array_join(F.transform(F.split("text", "\n"), entry), ""),
        "</feed>",
    )


@per_session
def _json() -> Column:
    def item(line: Column, i: Column) -> Column:
        n = text(i + 1)
        return F.struct(
            _join("d", text(F.col("doc_id")), "-", n).alias("id"),
            _join("/d/", text(F.col("doc_id")), "/", n).alias("url"),
            _join("Line ", n).alias("title"),
            line.alias("content_text"),
            F.when(
                F.col("lang") != "es", F.date_format(_line_ts(i), "yyyy-MM-dd'T'HH:mm:ss'Z'")
            ).alias("date_published"),
            F.array(F.struct(F.col("source").alias("name"))).alias("authors"),
            F.array(F.col("lang"), F.lit("line")).alias("tags"),
            F.array(
                F.struct(
                    _join("https://cdn.example.com/", text(F.col("doc_id")), "/", n, ".mp3").alias("url"),
                    F.lit("audio/mpeg").alias("mime_type"),
                    F.length(line).alias("size_in_bytes"),
                )
            ).alias("attachments"),
        )

    return F.to_json(
        F.struct(
            F.lit("https://jsonfeed.org/version/1.1").alias("version"),
            _join("Feed ", text(F.col("doc_id"))).alias("title"),
            _join("https://", F.col("source"), ".example.com/").alias("home_page_url"),
            F.transform(F.split("text", "\n"), item).alias("items"),
        )
    )


_BODIES = {"rss": _rss, "atom": _atom, "json": _json}


def feed_documents(spark: SparkSession, sf_dir: str, form: str = "rss") -> DataFrame:
    """Each document as a feed of its own, its lines the entries. Spanish feeds are undated.

    ``form`` is ``rss``, ``atom``, ``json``, or ``mixed``: RSS for English, Atom for French, JSON
    for Spanish, and RSS whose last tag is missing for German.
    """
    docs = spread(table(spark, sf_dir, "documents"))
    if form == "mixed":
        lang = F.col("lang")
        body = (
            F.when(lang == "fr", _atom())
            .when(lang == "es", _json())
            .otherwise(_rss(F.when(lang == "de", F.lit("")).otherwise(F.lit("</rss>"))))
        )
    else:
        body = _BODIES[form]()
    return docs.select(
        F.col("doc_id").alias("request_pos"),
        _join("https://", F.col("source"), ".example.com/", text(F.col("doc_id")), "/feed.xml").alias("feed_url"),
        body.alias("body"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a fetch log: the user is the host, errors are throttled responses."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        _join("h", text(F.col("user_id")), ".example.com:443").alias("authority"),
        F.col("ts"),
        F.when(kind == "error", 429).when(kind == "signup", 304).when(kind == "purchase", 500).otherwise(200).alias("http_status"),
        F.when((kind == "error") & (F.col("value") < 20), text(F.floor(F.col("value") * 10))).alias("retry_after"),
    )


def event_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as responses per feed (one feed per user)."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        _join("https://h", text(F.col("user_id")), ".example.com/feed").alias("feed_url"),
        F.when(kind == "error", 429).when(kind == "signup", 304).when(kind == "purchase", 500).otherwise(200).alias("http_status"),
        F.col("props").alias("body"),
        _join("e", text(F.col("event_id"))).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.lit("application/json").alias("content_type"),
        F.when(kind == "error", F.lit("30")).alias("retry_after"),
        F.col("ts").alias("fetched_at"),
    )


def pages_with_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with feed links put into their heads, since the supplied ones have none."""
    page = text(F.col("page_id"))
    links = _join(
        "<!-- <link rel=\"alternate\" type=\"application/rss+xml\" href=\"/hidden\"> -->",
        '<link rel="stylesheet" type="text/css" href="/s.css">',
        '<link rel="alternate" type="application/rss+xml" title="News &amp; more" href="/feed/', page, '.xml">',
        "<LINK REL='Alternate nofollow' TYPE='application/atom+xml; charset=utf-8' HREF='../é/", page, ".atom'/>",
        '<link rel=alternate type=application/feed+json href="https://JSON.example.com:443/', page, '">',
        '<link rel="alternate" type="application/rss+xml" title="again" href="/feed/', page, '.xml">',
        '<link rel="alternate" hreflang="de" type="text/html" href="/de.xml">',
        '<link rel="alternate" href="/plain/', page, '.rss?x=1">',
        '<link rel="alternate" href="  " type="application/rss+xml">',
        "</head>",
    )
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.replace("html", F.lit("</head>"), links).alias("html")
    )
